"""Batch outputs are plain Parquet partitions, written once per batch."""
import os

from tallyspark.operators import changes
from tallyspark.plans import jobs
from tallyspark.sources import driver_tables as D
from tallyspark.sources.tables import ShopTables

SF = "/root/testdata/sf0.001"


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def shop(spark):
    return ShopTables(sales=D.sales_b(spark, SF), products=D.products(spark, SF), addons=D.addons(spark, SF))


def test_sale_batches(spark, tmp_path):
    root, t, req = str(tmp_path), shop(spark), D.sale_requests(spark, SF)
    first, second = req.filter("request_id % 2 = 0"), req.filter("request_id % 2 = 1")
    jobs.run_sale_batch(t, first, root, 1)
    jobs.run_sale_batch(t, second, root, 2)
    want = changes.price_sales(req, t.products, t.addons)
    got = {name: jobs.read_batches(spark, root, name).drop("batch") for name in ("new_sales", "new_sale_addons", "sale_rejects")}
    assert same(got["new_sales"], want.accepted) and same(got["new_sale_addons"], want.addon_rows)
    assert same(got["sale_rejects"], want.rejects)


def test_a_batch_run_again_replaces_itself_only(spark, tmp_path):
    root, t, req = str(tmp_path), shop(spark), D.sale_requests(spark, SF)
    jobs.run_sale_batch(t, req.filter("request_id % 2 = 0"), root, 1)
    jobs.run_sale_batch(t, req.filter("request_id % 2 = 1"), root, 2)
    before = jobs.read_batches(spark, root, "new_sales").groupBy("batch").count().collect()
    jobs.run_sale_batch(t, req.filter("request_id % 2 = 1"), root, 2)
    assert sorted(jobs.read_batches(spark, root, "new_sales").groupBy("batch").count().collect()) == sorted(before)


def test_a_failing_retry_leaves_the_batch(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F
    root = str(tmp_path)
    good = spark.range(5)
    jobs.write_batch(good, root, "x", 1)
    with pytest.raises(Exception):
        jobs.write_batch(good.select(F.raise_error(F.lit("no")).cast("long").alias("id")), root, "x", 1)
    assert jobs.read_batches(spark, root, "x").count() == 5 and os.listdir(os.path.join(root, "x"))


def test_status_batch_flags_apply_in_one_join(spark, tmp_path):
    root, t = str(tmp_path), shop(spark)
    cancels, voids = D.cancel_requests(spark, SF), D.void_requests(spark, SF)
    jobs.run_status_batch(t, cancels, voids, root, 7)
    flags = jobs.read_batches(spark, root, "status_flags").drop("batch")
    assert same(changes.with_status(t.sales, flags), changes.apply_status_changes(t.sales, cancels, voids))
    log = D.sales_void(spark, SF)
    assert log.count() + jobs.read_batches(spark, root, "void_log").count() == changes.apply_voids(t.sales, log, voids).sales_void.count()


def test_catalog_batch(spark, tmp_path):
    root = str(tmp_path)
    jobs.run_catalog_batch(D.products(spark, SF), D.product_changes(spark, SF), root, 3)
    want = changes.upsert_products(D.products(spark, SF), D.product_changes(spark, SF))
    assert same(jobs.read_batches(spark, root, "products").drop("batch"), want.table)


def test_a_sale_batch_is_one_pass(spark, tmp_path):
    """One scan of the feed, one of each catalogue table, for all outputs."""
    t, req = shop(spark), str(tmp_path / "req")
    D.sale_requests(spark, SF).write.parquet(req)
    plan = changes.sale_outcomes(spark.read.parquet(req), t.products, t.addons)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("/req") == 1 and plan.count("FileScan") == 3
    jobs.run_sale_batch(t, spark.read.parquet(req), str(tmp_path / "out"), 1)
    assert sorted(os.listdir(tmp_path / "out")) == ["sale_batches"]


def test_an_output_that_is_empty_clears_the_batch(spark, tmp_path):
    root, t, req = str(tmp_path), shop(spark), D.sale_requests(spark, SF)
    jobs.run_sale_batch(t, req, root, 1)
    assert jobs.read_batches(spark, root, "sale_rejects").count() > 0
    good = req.join(changes.price_sales(req, t.products, t.addons).accepted.selectExpr("sales_id AS request_id"), "request_id", "left_semi")
    jobs.run_sale_batch(t, good.select(*req.columns), root, 1)
    assert jobs.read_batches(spark, root, "sale_rejects").count() == 0
    jobs.run_sale_batch(t, req.filter("false"), root, 1)
    for name in ("new_sales", "new_sale_addons", "sale_rejects"):
        assert jobs.read_batches(spark, root, name).count() == 0
    none = D.void_requests(spark, SF).filter("false")
    jobs.run_status_batch(t, D.cancel_requests(spark, SF).filter("false"), none, root, 4)
    assert [jobs.read_batches(spark, root, n).count() for n in ("status_flags", "void_log", "void_rejects")] == [0, 0, 0]


def test_requests_without_an_id_are_rejects_of_their_own(spark):
    from tallyspark import schemas as S
    t = shop(spark)
    req = spark.createDataFrame([(None, 1, 1, [1], None), (None, 1, 1, [1], None), (5, 0, 1, None, None), (6, 1, 1, [], None), (6, 1, 2, [], None)],
                                "request_id long, product_id long, quantity int, addon_ids array<long>, created_at timestamp_ntz")
    got = changes.price_sales(req, t.products, t.addons).rejects.collect()
    assert sorted((r.request_id or 0, r.reason) for r in got) == [
        (0, changes.REJECT_MISSING_KEY), (0, changes.REJECT_MISSING_KEY), (5, S.REJECT_INVALID), (6, changes.REJECT_DUPLICATE_KEY)]
