"""Sales listing: nested add-ons per sale, the searchable list, report rows.

The source builds a PHP map ``sale_id -> [add-on rows]`` from a whole-table
fetch and looks each sale up while rendering. Here that is an aggregate by
``sale_id`` joined to the sales on the key, so no table passes through one
process. Each add-on row is listed, in insertion order, as the page does;
``addon_copies_by_sale`` is the compact form with one element per distinct
add-on and a count.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark import periods as P
from tallyspark import schemas as S
from tallyspark.functions.labels import status_badge
from tallyspark.functions.numeric import unit_price
from tallyspark.functions.text import php_empty, search_filter
from tallyspark.operators.common import drop_partition_cols, period_predicate, range_predicate

ROW_FIELDS = ("id", "addon_name", "price", "addon_id")
ADDON_FIELDS = ("first_id", "addon_name", "price", "addon_id", "n")


def addons_by_sale(sale_addons: DataFrame) -> DataFrame:
    """``(sale_id, addons array<struct<id, addon_name, price, addon_id>>)``:
    every add-on row of a sale, by row id (insertion order), then by name,
    price and add-on id. A list is as long as one sale's receipt."""
    return sale_addons.groupBy("sale_id").agg(F.sort_array(F.collect_list(F.struct(*ROW_FIELDS))).alias("addons"))


def addon_copies_by_sale(sale_addons: DataFrame) -> DataFrame:
    """``(sale_id, addons array<struct<first_id, addon_name, price, addon_id,
    n>>)``: equal add-on rows of a sale as one element with their number, by
    the smallest row id. Copies are counted before the shuffle, so this form
    also fits sales with very many copies."""
    copies = (sale_addons.groupBy("sale_id", "addon_name", "price", "addon_id")
              .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")))
    return (copies.groupBy("sale_id")
            .agg(F.sort_array(F.collect_list(F.struct(*ADDON_FIELDS))).alias("addons")))


def addons_text(col: str | Column = "addons") -> Column:
    """Render a sale's add-on rows as text: ``name +price; ...``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_join(F.transform(c, lambda a: F.concat(
        F.coalesce(a["addon_name"], F.lit("")), F.lit(" +"), F.coalesce(a["price"].cast("string"), F.lit("")))), "; ")


def _date_filter(df: DataFrame, on_date) -> Column | None:
    """``DATE(created_at) = on_date``; an empty value (PHP ``empty``) means no
    filter and a malformed date is an error, as in the database."""
    if on_date is None or on_date == "" or on_date == "0":
        return None
    if isinstance(on_date, str):
        try:
            day = dt.date.fromisoformat(on_date.strip())
        except ValueError as exc:
            raise ValueError(f"malformed date filter: {on_date!r}") from exc
    elif isinstance(on_date, dt.datetime):
        day = on_date.date()
    else:
        day = on_date
    lo = dt.datetime.combine(day, dt.time())
    return range_predicate(df, lo, lo + dt.timedelta(days=1))


def sales_list(sales: DataFrame, products: DataFrame, sale_addons: DataFrame,
               search: str | None = None, on_date=None) -> DataFrame:
    """The sales page list, newest first.

    ``sales.*`` plus the live ``product_category``, the nested ``addons``
    (empty when none), ``unit_price = total / max(quantity, 1)``, the status
    ``badge``, whether the page shows an image (``has_image``) and whether it
    offers to cancel the sale (``can_cancel``: the status is Completed). The search is not trimmed (the page does not trim it);
    NULL times sort last; ties by ``sales_id`` descending.
    """
    preds = [p for p in (search_filter("product_name", search, trim=False), _date_filter(sales, on_date))
             if p is not None]
    s = sales
    for p in preds:
        s = s.filter(p)
    s = drop_partition_cols(s)
    if preds:
        # A filtered list needs the add-ons of the listed sales only: narrow
        # the add-on rows to those ids before nesting them, instead of
        # nesting the whole add-on table.
        wanted = s.select(F.col("sales_id").alias("sale_id"))
        sale_addons = sale_addons.join(wanted, "sale_id", "left_semi")
    cat = products.select(F.col("product_id").alias("_cat_id"), F.lit(0).cast("long").alias("_cat_part"),
                          F.col("category").alias("product_category"))
    nested = addons_by_sale(sale_addons).withColumnRenamed("sale_id", "sales_id")
    empty = F.array().cast(nested.schema["addons"].dataType)
    # The sale-id join comes first: with both tables bucketed by the sale id
    # it needs no shuffle; the catalogue join follows. Sales without a product
    # match nothing: a second key spreads them over all tasks.
    part = F.when(F.col("product_id").isNull(), F.col("sales_id")).otherwise(F.lit(0).cast("long"))
    out = (s.join(nested, "sales_id", "left")
           .join(cat, (F.col("product_id") == F.col("_cat_id")) & (part == F.col("_cat_part")), "left")
           .withColumn("addons", F.coalesce(F.col("addons"), empty))
           .withColumn("unit_price", unit_price("total", "quantity"))
           .withColumn("badge", status_badge("status"))
           .withColumn("has_image", ~php_empty("product_image"))
           .withColumn("can_cancel", F.coalesce(F.col("status") == F.lit(S.STATUS_COMPLETED), F.lit(False))))
    cols = [f.name for f in S.SALES.fields] + ["product_category", "addons", "unit_price", "badge", "has_image", "can_cancel"]
    return out.select(*cols).orderBy(F.col("created_at").desc_nulls_last(),
                                     F.col("sales_id").desc_nulls_last())


def report_transactions(sales: DataFrame, as_of, filter_name: str | None = "daily") -> DataFrame:
    """Completed rows of the report period, newest first."""
    period = P.report_period(filter_name)
    pred = period_predicate(sales, period, as_of) & (F.col("status") == F.lit(S.STATUS_COMPLETED))
    # The sale id ends the sort key so that many rows with one timestamp can
    # still be split between range partitions; it is not part of the output.
    out = sales.filter(pred).orderBy(F.col("created_at").desc_nulls_last(),
                                     F.col("sales_id").desc_nulls_last())
    return out.select("product_name", "quantity", "total", "created_at", "status")


def sale_badges(sales: DataFrame) -> DataFrame:
    """O14 applied to a sales table: id, status and badge of every sale."""
    return sales.select("sales_id", "status", status_badge("status").alias("badge"))
