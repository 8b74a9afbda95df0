"""Page compositions run end to end; the export writes both tables."""
import os

import pytest

from pyspark.sql import functions as F

from tallyspark.plans import export, pages
from tallyspark.sources import driver_tables as D
from tallyspark.sources.tables import ShopTables, read_tables, write_table

SF = "/root/testdata/sf0.001"


def stored(spark, tmp_path):
    root = str(tmp_path / "shop")
    for name, build in D.TABLE_BUILDERS.items():
        write_table(build(spark, SF), root, name)
    return read_tables(spark, root)


def test_pages_run(spark, tmp_path):
    t = stored(spark, tmp_path)
    assert isinstance(t, ShopTables) and t.sales is not None
    for page in (pages.dashboard(t, D.AS_OF_A), pages.report(t, D.AS_OF_A, "weekly"),
                 pages.sales_page(t, search="ring"), pages.inventory_page(t, stock_level="low"),
                 pages.products_page(t, category="small")):
        for name, df in page.items():
            df.write.format("noop").mode("overwrite").save()
    k = pages.dashboard(t, D.AS_OF_A)["kpis"].first()
    assert k.monthly >= k.weekly >= 0 and k.today_orders >= 0


def test_export_writes_summary_and_rows(spark, tmp_path):
    sales = D.sales_a(spark, SF)
    out = export.export_report(sales, D.AS_OF_A, "monthly", str(tmp_path))
    assert os.path.basename(out) == "Report_Monthly_1998-06-17"
    summary = spark.read.option("header", True).csv(os.path.join(out, "summary")).collect()
    rows = spark.read.option("header", True).csv(os.path.join(out, "transactions"))
    assert len(summary) == 1 and summary[0].period_label == "Monthly"
    assert int(summary[0].total_transactions) == rows.count() > 0


def test_export_empty_period_still_has_summary(spark, tmp_path):
    sales = D.sales_a(spark, SF)
    out = export.export_report(sales, "1970-01-01", "daily", str(tmp_path))
    summary = spark.read.option("header", True).csv(os.path.join(out, "summary")).collect()
    assert len(summary) == 1 and summary[0].total_transactions == "0"
    assert summary[0].total_sales_text == "0.00"


def test_export_generated_stamp(spark, tmp_path):
    import datetime as dt
    out = export.export_report(D.sales_a(spark, SF), D.AS_OF_A, "weekly", str(tmp_path),
                               generated_at=dt.datetime(2030, 1, 2, 3, 4, 5))
    summary = spark.read.option("header", True).csv(os.path.join(out, "summary")).first()
    assert summary.generated_at == "2030-01-02 03:04:05" and summary.period_label == "Weekly"


def test_append_priced_sales_to_stored_table(spark, tmp_path):
    from tallyspark.operators import changes
    from tallyspark.sources.tables import read_table
    root = str(tmp_path / "shop")
    base = D.sales_b(spark, SF).filter("created_at < timestamp_ntz'2024-01-10 00:00:00'")
    write_table(base, root, "sales")
    req = D.sale_requests(spark, SF).filter("created_at >= timestamp_ntz'2024-01-10 00:00:00'")
    accepted = changes.price_sales(req, D.products(spark, SF), D.addons(spark, SF)).accepted
    write_table(accepted, root, "sales", mode="append")
    stored = read_table(spark, root, "sales")
    assert stored.count() == base.count() + accepted.count()
    assert stored.select("sale_month").distinct().count() == 1      # January 2024


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_the_summary_is_observed_while_the_rows_are_written(spark, tmp_path, fmt):
    """The figures equal those of a scan of their own, over many part files."""
    sales = D.sales_a(spark, SF).repartition(7)
    want = export.export_frames(sales, D.AS_OF_A, "monthly")[0].collect()
    out = export.export_report(sales, D.AS_OF_A, "monthly", str(tmp_path), fmt=fmt)
    read = spark.read.option("header", True)
    got = (read.csv if fmt == "csv" else read.parquet)(os.path.join(out, "summary")).collect()
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want]
    rows = (read.csv if fmt == "csv" else read.parquet)(os.path.join(out, "transactions"))
    assert rows.count() == want[0].total_transactions
