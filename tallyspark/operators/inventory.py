"""Inventory views: stock status, search, cards, alerts, report.

Each page has its own NULL rule for stock and threshold (SURVEY T5); the
rules live in ``tallyspark.functions.labels``. All views are narrow
projections and filters over the ingredients table; sorts are global
(range-partitioned).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark import schemas as S
from tallyspark.functions.labels import (
    alert_message, class_to_label, report_stock_class, stock_card_level, stock_label,
    stock_level_filter, unit_label,
)
from tallyspark.functions.numeric import fill_percent
from tallyspark.functions.text import by_name, is_blank_php, php_empty, php_trim_text, search_filter
from tallyspark.operators.common import filter_all


def _by_stock(df: DataFrame) -> DataFrame:
    # Lowest stock first, NULL stock first (as in the source); ties by id.
    return df.orderBy(F.col("stock").asc_nulls_first(), F.col("ingredient_id"))


def stock_status(ingredients: DataFrame) -> DataFrame:
    """O18 (dashboard): every ingredient with its Low/Mid/Good label; a
    missing threshold counts as the default; with the image and whether the
    page shows one."""
    thr = F.coalesce(F.col("low_stock_threshold"), F.lit(S.DEFAULT_LOW_STOCK_THRESHOLD))
    return _by_stock(ingredients).select(
        "ingredient_id", "ingredient_name", "unit", "stock", thr.alias("threshold"),
        stock_label().alias("label"), "image", (~php_empty("image")).alias("has_image"))


def ingredient_search(ingredients: DataFrame, search: str | None = None,
                      unit: str | None = None, stock_level: str | None = None) -> DataFrame:
    """Ingredients matching every supplied filter; the stock level uses
    plain SQL comparisons, so NULL stock or threshold matches no level."""
    preds = [search_filter("ingredient_name", search, trim=True)]
    if unit is not None and not is_blank_php(php_trim_text(unit)):
        preds.append(F.collate(F.col("unit"), "UNICODE_CI_AI") == F.lit(php_trim_text(unit)))
    level = php_trim_text(stock_level) if stock_level is not None else None
    preds.append(stock_level_filter(level))
    return filter_all(ingredients, preds).select(*[f.name for f in S.INGREDIENTS.fields])


def stock_cards(ingredients: DataFrame) -> DataFrame:
    """Card fields of (searched) ingredients: level, bar percent, image flag."""
    return ingredients.select(
        *[f.name for f in S.INGREDIENTS.fields],
        stock_card_level().alias("level"),
        fill_percent().alias("fill_pct"),
        (~php_empty("image")).alias("has_image"))


def low_stock_alerts(ingredients: DataFrame) -> DataFrame:
    """Ingredients at or under their threshold, by name."""
    return (ingredients.filter(F.col("stock") <= F.col("low_stock_threshold"))
            .select(F.col("ingredient_name").alias("label"), "stock", "low_stock_threshold",
                    "ingredient_id")
            .orderBy(*by_name("label"), F.col("ingredient_id"))
            .drop("ingredient_id"))


def low_stock_alert_count(ingredients: DataFrame) -> DataFrame:
    """Number of alerts and the banner headline (NULL when none)."""
    n = (ingredients.filter(F.col("stock") <= F.col("low_stock_threshold"))
         .agg(F.count(F.lit(1)).alias("alerts")))
    return n.select("alerts", alert_message("alerts").alias("message"))


def inventory_report(ingredients: DataFrame, status: str | None = None,
                     unit_label_filter: str | None = None) -> DataFrame:
    """The report's inventory table: class, unit label, effective
    ``threshold`` (the default where none is set) and Low/Mid/Good label, filtered by class and/or unit label, lowest stock first.

    The report compares filters with ``!== ''``, so only None and '' mean
    "no filter" here (a '0' filter matches nothing).
    """
    out = ingredients.select(*[f.name for f in S.INGREDIENTS.fields],
                             report_stock_class().alias("cls"), unit_label().alias("unit_label"),
                             F.coalesce("low_stock_threshold", F.lit(S.DEFAULT_LOW_STOCK_THRESHOLD)).alias("threshold"))
    preds = []
    if status not in (None, ""):
        preds.append(F.col("cls") == F.lit(status))
    if unit_label_filter not in (None, ""):
        preds.append(F.col("unit_label") == F.lit(unit_label_filter))
    out = filter_all(out, preds).withColumn("label", class_to_label("cls"))
    return _by_stock(out)


def unit_labels(ingredients: DataFrame) -> DataFrame:
    """The distinct unit labels offered by the report's filter, in the
    order the report first meets them while walking ingredients by stock
    ascending with NULL stock first (ties by label)."""
    first_seen = F.min(F.struct(F.col("stock").isNotNull().alias("has_stock"), F.col("stock")))
    return (ingredients.groupBy(unit_label().alias("unit_label"))
            .agg(first_seen.alias("_first"))
            .orderBy("_first", "unit_label")
            .select("unit_label"))
