"""A product that receives ~40% of all sales: results stay exact and AQE
splits the hot join partition instead of giving it to one task."""
import contextlib
import io

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import changes, rankings, sales_views
from tallyspark.sources import driver_tables as D

SF = "/root/testdata/sf0.01"

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@contextlib.contextmanager
def conf(spark, values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@pytest.fixture(scope="module")
def skewed(spark):
    sales = D.sales_b(spark, SF)
    hot = F.col("status").isin("Completed", "Pending")      # ~60% of event sales
    return sales.withColumn("product_id", F.when(hot & (F.col("sales_id") % 3 != 0), F.lit(7))
                            .otherwise(F.col("product_id")))


def test_hot_product_results_exact(spark, skewed):
    products = D.products(spark, SF)
    share = skewed.filter(F.col("product_id") == 7).count() / skewed.count()
    assert share > 0.33
    with conf(spark, SKEW_CONF):
        top = rankings.top_products_completed(skewed, products, "2024-01-17", "monthly").collect()
        listed = sales_views.sales_list(skewed, products, D.sale_addons(spark, SF))
        n = listed.count()
        cats = listed.filter(F.col("product_id") == 7).select("product_category").distinct().collect()
    # Product 7 keeps the sale-time names of its rows, so it forms one group
    # per name; the top row is the largest of those groups.
    expected = (skewed.filter((F.col("status") == "Completed") & (F.col("product_id") == 7))
                .groupBy("product_name").agg(F.sum("quantity").alias("q"))
                .agg(F.max("q")).first()[0])
    assert top[0].product_id == 7 and top[0].qty_sold == expected
    assert n == skewed.count()
    assert [r.product_category for r in cats] == [products.filter("product_id = 7").first().category]


def test_hot_join_partition_is_split(spark, skewed):
    products = D.products(spark, SF)
    with conf(spark, SKEW_CONF):
        df = skewed.join(products.select("product_id", "category"), "product_id", "left")
        rows = df.collect()            # runs this plan; explain then shows the final one
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
        plan = buf.getvalue()
    assert len(rows) == skewed.count()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan
    assert "skew=true" in plan


def test_hot_key_pricing_exact(spark):
    req = D.sale_requests(spark, SF).withColumn("product_id", F.lit(9))
    with conf(spark, SKEW_CONF):
        res = changes.price_sales(req, D.products(spark, SF), D.addons(spark, SF))
        n_acc, n_rej = res.accepted.count(), res.rejects.count()
    assert n_acc + n_rej == req.count()


def test_hot_category_menu_pages_are_bounded(spark):
    from tallyspark.operators import catalog
    products = D.products(spark, SF).withColumn(
        "category", F.when(F.col("product_id") % 10 < 8, F.lit("HOT")).otherwise(F.col("category")))
    pages = catalog.menu_pages(products, page_size=40)
    sizes = pages.select("category", "page", F.size("items").alias("n")).collect()
    assert max(r.n for r in sizes) <= 40
    hot = sorted(r.page for r in sizes if r.category == "HOT")
    assert hot == list(range(len(hot)))                      # consecutive pages from 0
    flat = pages.select("category", F.explode("items").alias("it")).select(
        "category", "it.product_id")
    avail = products.filter(F.col("status") == "Available").select("category", "product_id")
    assert flat.count() == avail.count() and flat.exceptAll(avail).count() == 0
    # Inside the hot category, pages follow name order.
    firsts = (pages.filter(F.col("category") == "HOT").orderBy("page")
              .select(F.col("items")[0]["product_name"].alias("n")).collect())
    names = [r.n for r in firsts]
    assert names == sorted(names)


def test_menu_pages_exact_over_many_shelves(spark):
    """At sf0.1 shelf sizes and numbering agree: pages equal the SQL definition."""
    import os
    import sys
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
    from compare_oracle import compare_rows, duck
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.1"
    df = E.queries()["menu_pages"](spark, sf)
    cols = sorted(df.columns)
    rows = [tuple(r[c] for c in cols) for r in df.collect()]
    rel = duck(sf).execute(E.oracle_sql()["menu_pages"])
    ocols = [d[0] for d in rel.description]
    orows = [tuple(r[ocols.index(c)] for c in cols) for r in rel.fetchall()]
    assert len(rows) == len(orows) and compare_rows(rows, orows)


def test_most_names_with_one_beginning_are_ranked_in_many_tasks(spark):
    """Nine of ten names begin alike and many are equal: ranges are of like
    size, and pages are as the definition says."""
    from pyspark.sql import functions as F
    from tallyspark.operators.common import with_positions, with_ranges
    n = 20_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 20 == 0, F.lit(None)).otherwise(F.lit("c")).alias("category"), F.col("id").alias("product_id"),
        F.when(F.col("id") % 10 < 9, F.concat(F.lit("The house blend "), (F.xxhash64("id") % 50).cast("string"))).otherwise(
            F.concat(F.lit("x"), F.col("id").cast("string"))).alias("name"))
    sizes = [r["count"] for r in with_ranges(rows, ["category"], ["name", "product_id"]).groupBy("category", "_range").count().collect()]
    assert len(sizes) > 300 and max(sizes) < n * 0.05
    tasks = with_ranges(rows, ["category"], ["name", "product_id"]).repartition(8, "category", "_range")
    per_task = sorted(r["count"] for r in tasks.groupBy(F.spark_partition_id()).count().collect())
    assert per_task[-1] < 2 * per_task[len(per_task) // 2]
    got = with_positions(rows, ["category"], ["name", "product_id"], "place").collect()
    for category in (None, "c"):
        mine = sorted((r for r in got if r.category == category), key=lambda r: (r.name, r.product_id))
        assert [r.place for r in mine] == list(range(len(mine)))
