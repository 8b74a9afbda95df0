"""Streaming forms agree with the batch operators."""
import datetime as dt
import os
import tempfile
from decimal import Decimal

from tallyspark import schemas as S
from tallyspark.operators import changes, kpis
from tallyspark.plans import jobs
from tallyspark.sources import driver_tables as D
from tallyspark.sources.tables import ShopTables
from tallyspark.streaming import kpi_stream, sale_feed

SF = "/root/testdata/sf0.001"


def test_sale_feed_commits_one_batch_per_epoch(spark):
    base = tempfile.mkdtemp(prefix="tallyspark-stream-")
    src = os.path.join(base, "requests")
    req = D.sale_requests(spark, SF)
    req.repartition(4).write.parquet(src)
    t = ShopTables(sales=D.sales_b(spark, SF), products=D.products(spark, SF), addons=D.addons(spark, SF))
    root = os.path.join(base, "shop")
    q = sale_feed.start_sale_feed(spark, sale_feed.read_requests(spark, src, max_files=1), t, root,
                                  checkpoint=os.path.join(base, "ckpt"), available_now=True)
    q.awaitTermination(300)
    got = jobs.read_batches(spark, root, "new_sales")
    assert got.select("batch").distinct().count() >= 2
    expected = changes.price_sales(req, t.products, t.addons).accepted
    got = got.drop("batch")
    assert got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0


def test_late_sales_and_changes_reach_their_day(spark):
    """Files with sales of the 20th, 21st and then the 5th, and a later cancel
    and removal: at default settings the day table equals the batch."""
    base = tempfile.mkdtemp(prefix="tallyspark-stream-")
    src = os.path.join(base, "effects")
    sale = lambda day, total, status="Completed": (dt.datetime(2030, 1, day, 9), Decimal(total), status, 1)
    schema = "created_at timestamp_ntz, total decimal(12,2), status string, sign int"
    files = [[sale(20, "10.00")], [sale(21, "5.00"), sale(21, "7.00")], [sale(5, "99.00")],
             [(dt.datetime(2030, 1, 20, 9), Decimal("10.00"), "Completed", -1), (dt.datetime(2030, 1, 20, 9), Decimal("10.00"), "Cancelled", 1),
              (dt.datetime(2030, 1, 21, 9), Decimal("7.00"), "Completed", -1)]]
    out = os.path.join(base, "daily")
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = kpi_stream.start_daily_totals(spark, spark.readStream.schema(schema).parquet(src), out, available_now=True)
        q.awaitTermination(300)
    got = {r.day.day: (r.total, r.orders, r.completed_total, r.completed_orders) for r in kpi_stream.read_daily_totals(spark, out).collect()}
    assert got == {20: (Decimal("10.00"), 1, 0, 0), 21: (Decimal("5.00"), 1, Decimal("5.00"), 1), 5: (Decimal("99.00"), 1, Decimal("99.00"), 1)}


def test_daily_windows_match_batch_kpis(spark):
    base = tempfile.mkdtemp(prefix="tallyspark-stream-")
    src = os.path.join(base, "sales")
    sales = D.sales_b(spark, SF)
    sales.orderBy("created_at").repartition(3).write.parquet(src)
    stream = spark.readStream.schema(S.SALES).option("maxFilesPerTrigger", 1).parquet(src)
    out = os.path.join(base, "daily")
    q = kpi_stream.start_daily_totals(spark, stream, out, checkpoint=os.path.join(base, "ckpt"), available_now=True)
    q.awaitTermination(300)
    daily = {r.day.isoformat(): r for r in kpi_stream.read_daily_totals(spark, out).collect()}
    for day in ("2024-01-03", "2024-01-17"):
        b = kpis.dashboard_kpis(sales, day).first()
        r = kpis.report_kpis(sales, day, "daily").first()
        assert daily[day].total == b.daily and daily[day].orders == b.today_orders
        assert daily[day].completed_total == r.total_sales


def test_dashboard_from_stream_days_equals_batch(spark):
    sales = D.sales_b(spark, SF)
    days = kpi_stream.daily_windows(sales)       # batch form of the stream's day table
    for as_of in ("2024-01-01", "2024-01-17", "2024-01-31"):
        a = kpi_stream.dashboard_from_days(days, as_of).first()
        b = kpis.dashboard_kpis(sales, as_of).first()
        assert (a.daily, a.weekly, a.monthly, a.today_orders) == (b.daily, b.weekly, b.monthly, b.today_orders)
        assert a.forecast == b.forecast
