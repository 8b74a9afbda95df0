"""Catalogue views: sellable products and add-ons, product search.

The sale form lists available products grouped by category. A category may
hold a large share of the catalogue, so the grouping is carried by a global
sort (range-partitioned, so no category lands in one task), a per-category
summary, and a nested form split into fixed-size pages per category, instead
of one array per category built in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark import schemas as S
from tallyspark.functions.labels import availability_label
from tallyspark.functions.text import by_name, fold_accents, is_blank_php, php_trim_text, search_filter
from tallyspark.operators.common import filter_all, with_positions


def sellable_products(products: DataFrame) -> DataFrame:
    """O15 (flat): available products by category, then name (then id)."""
    return (products.filter(F.col("status") == F.lit(S.AVAILABLE))
            .select("product_id", "product_name", "category", "price")
            .orderBy(*by_name("category"), *by_name("product_name"), F.col("product_id")))


def menu_sections(products: DataFrame) -> DataFrame:
    """O15 (grouped): one row per category of the sale form's product list:
    how many products it offers and their price range, in category order."""
    return (products.filter(F.col("status") == F.lit(S.AVAILABLE))
            .groupBy("category")
            .agg(F.count(F.lit(1)).alias("items"), F.min("price").alias("min_price"),
                 F.max("price").alias("max_price"))
            .orderBy(*by_name("category")))


def menu_pages(products: DataFrame, page_size: int = 50) -> DataFrame:
    """O15 (nested): the sale form's grouped menu as ``(category, page,
    items array<struct<product_name, product_id, price>>)``, each page holding
    at most ``page_size`` products of one category in name order.

    A product's place in its category is found over ranges of its name order,
    cut where the category's own names lie, so neither a category nor a
    beginning that most names share is ranked in one task; nothing runs before
    an action.
    """
    if page_size < 1:
        raise ValueError("page_size must be at least 1")
    avail = (products.filter(F.col("status") == F.lit(S.AVAILABLE))
             .select("category", "product_name", "product_id", "price", fold_accents("product_name").alias("_key")))
    placed = with_positions(avail, ["category"], ["_key", "product_name", "product_id"], "_nth")
    items = F.sort_array(F.collect_list(F.struct("_nth", "product_name", "product_id", "price")))
    return (placed.groupBy("category", F.floor(F.col("_nth") / page_size).cast("long").alias("page")).agg(items.alias("items"))
            .withColumn("items", F.transform("items", lambda x: F.struct(
                x["product_name"].alias("product_name"), x["product_id"].alias("product_id"), x["price"].alias("price"))))
            .orderBy(*by_name("category"), "page"))


def sellable_addons(addons: DataFrame) -> DataFrame:
    """Available add-ons by name (then id)."""
    return (addons.filter(F.col("status") == F.lit(S.AVAILABLE))
            .select("addon_id", "addon_name", "price")
            .orderBy(*by_name("addon_name"), F.col("addon_id")))


def _equals_ci(col: str, value: str | None) -> Column | None:
    """Trimmed, PHP-empty-aware equality, case- and accent-insensitive as in
    the source database."""
    if value is None:
        return None
    value = php_trim_text(value)
    if is_blank_php(value):
        return None
    return F.collate(F.col(col), "UNICODE_CI_AI") == F.lit(value)


def product_search(products: DataFrame, search: str | None = None,
                   category: str | None = None, status: str | None = None) -> DataFrame:
    """Products matching every supplied filter (substring of the name,
    category, status), with the availability label. No ordering."""
    out = filter_all(products, [search_filter("product_name", search, trim=True),
                                _equals_ci("category", category), _equals_ci("status", status)])
    return out.select(*[f.name for f in S.PRODUCTS.fields],
                      (F.col("status") == F.lit(S.AVAILABLE)).alias("is_available"),
                      availability_label("status").alias("availability"))
