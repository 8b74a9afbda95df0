"""Top sellers and the category ranking.

Plans aggregate sales *before* joining the product catalogue. Grouping by
``(product_id, product_name)`` first is exact: ``product_id`` is the
catalogue's primary key, so image, price and category are functionally
dependent on it. The fact side then shrinks to one row per product (with a
map-side partial aggregate, so a product holding a third of all sales is
combined inside each task), and the join sees at most one row per product.

Ties have no order in the source; ours are broken by ``product_id`` then
``product_name`` (top sellers) and by ``category`` (category ranking), on both
the Spark side and the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark import periods as P
from tallyspark import schemas as S
from tallyspark.functions.text import fold_accents, text_present
from tallyspark.operators.common import is_ntz, period_predicate, range_predicate


def _sales_by_product(sales: DataFrame, as_of, period: str, status: str | None,
                      qty_name: str, collation: str | None = None) -> DataFrame:
    pred = period_predicate(sales, period, as_of)
    if status is not None:
        pred = pred & (F.col("status") == F.lit(status))
    out = (sales.filter(pred).groupBy("product_id", "product_name")
           .agg(F.sum("quantity").alias(qty_name), F.sum("total").alias("revenue")))
    return out if collation is None else _one_spelling(out, ["product_id"], "product_name", [qty_name, "revenue"])


def _one_spelling(sums: DataFrame, keys: list[str], name: str, columns: list[str]) -> DataFrame:
    """Rows of one name, as the source database compares text (any case, any
    accents), added up under its smallest spelling by code points.

    The sales themselves are hashed by the text as stored; only the sums, a
    row per spelling, are brought together by the folded text."""
    return (sums.groupBy(*keys, fold_accents(name).alias("_fold"))
            .agg(F.min(name).alias(name), *[F.sum(c).alias(c) for c in columns]).drop("_fold"))


def _order(df: DataFrame, qty_name: str) -> DataFrame:
    return df.orderBy(F.col(qty_name).desc_nulls_last(), F.col("product_id").asc_nulls_first(),
                      F.col("product_name").asc_nulls_first())


def _top(df: DataFrame, qty_name: str, k: int) -> DataFrame:
    # ORDER BY + LIMIT plans as TakeOrderedAndProject: each task keeps its own
    # top k and only k rows per task reach the final merge.
    return _order(df, qty_name).limit(k)


def top_products_with_image(sales: DataFrame, products: DataFrame, as_of,
                            period: str = P.DAILY, k: int = S.TOP_K,
                            collation: str | None = None) -> DataFrame:
    """O08 (dashboard): top-k products by quantity in the period, any status,
    counting only products that still exist and have a non-empty image.

    The image test rejects NULL product fields, so the left join of the source
    is an inner join here. Sale-time names group as stored; ``collation``
    (``"UNICODE_CI_AI"``) groups them as the source database compares text,
    under the smallest spelling.
    """
    agg = _sales_by_product(sales, as_of, period, None, "qty", collation)
    cat = (products.filter(text_present("image"))
           .select("product_id", "image", "price", "category"))
    joined = agg.join(cat, "product_id", "inner")
    return _top(joined, "qty", k).select(
        "product_id", "product_name", "qty", "revenue", "image", "price", "category")


def top_products_completed(sales: DataFrame, products: DataFrame, as_of,
                           period: str = P.DAILY, k: int = S.TOP_K,
                           collation: str | None = None) -> DataFrame:
    """O09 (report): top-k by quantity of Completed sales in the period.

    Sales of deleted products stay (product fields NULL), as in the source's
    left join. Because no product column takes part in the filter or the
    order, the top k is taken before the join, so at most k rows meet the
    catalogue's four columns. One lazy plan: nothing runs before an action.
    ``collation`` as in ``top_products_with_image``.
    """
    agg = _sales_by_product(sales, as_of, period, S.STATUS_COMPLETED, "qty_sold", collation)
    attrs = products.select("product_id", "image", "price", "category")
    joined = _top(agg, "qty_sold", k).join(attrs, "product_id", "left").select(
        "product_id", "product_name", "qty_sold", "revenue", "image", "price", "category")
    # Rank order again after the join; k rows, so the limit keeps the sort in
    # the top-k node and out of a sampled global sort.
    return _top(joined, "qty_sold", k)


STRIP = (P.DAILY, P.TRAILING7, P.MONTHLY)


def _strip_sums(sales: DataFrame, as_of, periods, status: str | None, qty_name: str) -> DataFrame:
    """Sums per product and period, from one scan of the periods' union."""
    ranges = [P.period_range(p, as_of) for p in periods]
    lo = None if any(r[0] is None for r in ranges) else min(r[0] for r in ranges)
    hi = None if any(r[1] is None for r in ranges) else max(r[1] for r in ranges)
    pred = range_predicate(sales, lo, hi)
    if status is not None:
        pred = pred & (F.col("status") == F.lit(status))
    inside = [P.in_range("created_at", *r, ntz=is_ntz(sales, "created_at")) for r in ranges]
    sums = sales.filter(pred).groupBy("product_id", "product_name").agg(*[a for i, x in enumerate(inside) for a in (
        F.sum(F.when(x, F.col("quantity"))).alias(f"q{i}"), F.sum(F.when(x, F.col("total"))).alias(f"t{i}"),
        F.count(F.when(x, F.lit(1))).alias(f"n{i}"))])
    rows = F.array(*[F.struct(F.lit(p).alias("period"), F.col(f"q{i}").alias(qty_name), F.col(f"t{i}").alias("revenue"),
                              F.col(f"n{i}").alias("_n")) for i, p in enumerate(periods)])
    return sums.select("product_id", "product_name", F.explode(rows).alias("_p")).select(
        "product_id", "product_name", "_p.*").filter("_n > 0").drop("_n")


def _strip_top(rows: DataFrame, qty_name: str, k: int) -> DataFrame:
    # A rank of at most k: each task keeps its own k per period before the
    # rows of a period meet.
    w = Window.partitionBy("period").orderBy(F.col(qty_name).desc_nulls_last(), F.col("product_id").asc_nulls_first(),
                                             F.col("product_name").asc_nulls_first())
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_with_image_strip(sales: DataFrame, products: DataFrame, as_of, periods=STRIP, k: int = S.TOP_K) -> DataFrame:
    """O08 for several periods at once: the lists of ``top_products_with_image``
    with ``period`` and ``rank``, from one scan of the sales."""
    cat = products.filter(text_present("image")).select("product_id", "image", "price", "category")
    joined = _strip_sums(sales, as_of, periods, None, "qty").join(cat, "product_id", "inner")
    return _strip_top(joined, "qty", k).select("period", "rank", "product_id", "product_name", "qty", "revenue", "image", "price", "category")


def top_completed_strip(sales: DataFrame, products: DataFrame, as_of, periods=STRIP, k: int = S.TOP_K) -> DataFrame:
    """O09 for several periods at once: the lists of ``top_products_completed``
    with ``period`` and ``rank``, from one scan of the sales; the catalogue
    meets at most ``k`` rows per period."""
    top = _strip_top(_strip_sums(sales, as_of, periods, S.STATUS_COMPLETED, "qty_sold"), "qty_sold", k)
    attrs = products.select("product_id", "image", "price", "category")
    return top.join(attrs, "product_id", "left").select(
        "period", "rank", "product_id", "product_name", "qty_sold", "revenue", "image", "price", "category")


def category_ranking(sales: DataFrame, products: DataFrame, collation: str | None = None) -> DataFrame:
    """All-time Completed quantity and revenue per live category, ranked
    1..n by revenue. Sales of deleted products drop out (inner join).

    Sales are reduced to one row per product before the join and to one row
    per category after it, so the ranking window (one partition by design)
    sees only as many rows as there are categories. Categories group as
    stored (binary); ``collation="UNICODE_CI_AI"`` groups them the way the
    source database compares text (case- and accent-insensitive), under the
    smallest spelling.
    """
    per_product = (sales.filter(F.col("status") == F.lit(S.STATUS_COMPLETED))
                   .groupBy("product_id")
                   .agg(F.sum("quantity").alias("q"), F.sum("total").alias("t")))
    per_cat = (per_product.join(products.select("product_id", "category"), "product_id", "inner")
               .groupBy("category")
               .agg(F.sum("q").alias("total_quantity"), F.sum("t").alias("total_sales")))
    if collation is not None:
        per_cat = _one_spelling(per_cat, [], "category", ["total_quantity", "total_sales"])
    w = Window.orderBy(F.col("total_sales").desc_nulls_last(), F.col("category").asc_nulls_first())
    # The window already runs in one partition (one row per category), so
    # ordering by rank is a local sort there, not another exchange.
    return (per_cat.select(F.row_number().over(w).alias("rank"), "category",
                           "total_quantity", "total_sales")
            .coalesce(1).sortWithinPartitions("rank"))
