"""Invariants of the batch change jobs on the adapted sf0.001 tables."""
from pyspark.sql import functions as F

from tallyspark.operators import changes
from tallyspark.sources import driver_tables as D

SF = "/root/testdata/sf0.001"


def test_cancellations_idempotent(spark):
    sales, ids = D.sales_b(spark, SF), D.cancel_requests(spark, SF)
    once = changes.apply_cancellations(sales, ids)
    twice = changes.apply_cancellations(once, ids)
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0
    assert once.count() == sales.count()


def test_every_request_accepted_or_rejected_once(spark):
    req = D.sale_requests(spark, SF)
    res = changes.price_sales(req, D.products(spark, SF), D.addons(spark, SF))
    acc = res.accepted.select(F.col("sales_id").alias("request_id"))
    rej = res.rejects.select("request_id")
    both = acc.unionByName(rej)
    assert both.count() == req.count()
    assert both.distinct().count() == req.count()


def test_delete_products_loses_no_sale(spark):
    sales = D.sales_b(spark, SF)
    out = changes.delete_products(D.products(spark, SF), sales, D.product_deletes(spark, SF))
    assert out.sales.count() == sales.count()
    kept = out.products.select("product_id")
    dangling = out.sales.filter(F.col("product_id").isNotNull()).join(kept, "product_id", "left_anti")
    assert dangling.filter(F.col("product_id").isin(
        [r.product_id for r in D.product_deletes(spark, SF).distinct().collect()])).count() == 0


def test_upsert_keeps_keys_unique(spark):
    out = changes.upsert_products(D.products(spark, SF), D.product_changes(spark, SF)).table
    assert out.count() == out.select("product_id").distinct().count()


def test_voids_log_grows_by_accepted_requests(spark):
    sales, log = D.sales_b(spark, SF), D.sales_void(spark, SF)
    v = D.void_requests(spark, SF)
    res = changes.apply_voids(sales, log, v)
    assert res.sales_void.count() == log.count() + v.count() - res.rejects.count()
