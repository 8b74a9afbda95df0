"""Physical-plan assertions: pushdown, pruning, join shapes, top-k."""
import os
import tempfile

import pytest

from tallyspark import periods as P
from tallyspark.operators import changes, kpis, rankings
from tallyspark.sources import driver_tables as D
from tallyspark.sources.tables import read_table, write_table

SF = "/root/testdata/sf0.001"


def formatted(df):
    import io
    import contextlib
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def stored(spark):
    root = tempfile.mkdtemp(prefix="tallyspark-plan-")
    write_table(D.sales_a(spark, SF), root, "sales")
    write_table(D.products(spark, SF), root, "products")
    return read_table(spark, root, "sales"), read_table(spark, root, "products")


def test_period_range_pushed_and_months_pruned(stored):
    sales, _ = stored
    text = formatted(kpis.period_sales_total(sales, D.AS_OF_A, P.MONTHLY))
    assert "GreaterThanOrEqual(created_at,1998-06-01T00:00)" in text
    assert "LessThan(created_at,1998-07-01T00:00)" in text
    assert "PartitionFilters: [isnotnull(sale_month" in text and "1998-06-01" in text


def test_dashboard_strip_is_one_scan(stored):
    sales, _ = stored
    text = formatted(kpis.dashboard_kpis(sales, D.AS_OF_A))
    import re
    assert len(re.findall(r"^\(\d+\) Scan parquet", text, flags=re.M)) == 1


def test_image_ranking_is_inner_join_and_top_k(stored):
    sales, products = stored
    text = formatted(rankings.top_products_with_image(sales, products, D.AS_OF_A, P.DAILY))
    assert "LeftOuter" not in text and "Inner" in text
    assert "TakeOrderedAndProject" in text


def scans(df, table):
    text = formatted(df)
    import re
    return len([x for x in re.findall(r"^\(\d+\) Scan parquet.*$\n.*\n.*\nLocation: .*$", text, flags=re.M) if f"/{table}" in x])


def test_completed_ranking_takes_the_top_before_the_join(stored):
    sales, products = stored
    df = rankings.top_products_completed(sales, products, D.AS_OF_A, P.MONTHLY)
    text = formatted(df)
    assert text.count("TakeOrderedAndProject") >= 2 and "LeftOuter" in text
    assert scans(df, "sales") == 1 and scans(df, "products") == 1


def test_building_pages_starts_no_job(spark, stored):
    from tallyspark.operators import catalog
    from tallyspark.plans import pages
    from tallyspark.sources.tables import ShopTables
    sales, products = stored
    t = ShopTables(sales=sales, products=products, ingredients=D.ingredients(spark, SF), sale_addons=D.sale_addons(spark, SF))
    sc = spark.sparkContext
    sc.setJobGroup("build-only", "")
    try:
        pages.report(t, D.AS_OF_A, filter_name="monthly")
        catalog.menu_pages(products)
        assert list(sc.statusTracker().getJobIdsForGroup("build-only")) == []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_status_jobs_read_and_join_sales_once(spark, stored):
    sales, _ = stored
    cancels, voids = D.cancel_requests(spark, SF), D.void_requests(spark, SF)
    log = D.sales_void(spark, SF)
    for df in (changes.apply_status_changes(sales, cancels, voids), changes.apply_voids(sales, log, voids).sales,
               changes.apply_cancellations(sales, cancels)):
        assert scans(df, "sales") == 1
        assert formatted(df).count("Join type: LeftOuter") == 1


def test_kpi_queries_read_one_table(spark):
    from tallyspark.plans.queries import REGISTRY
    for name in ("daily_total_any_status", "dashboard_kpis", "report_kpis_monthly", "report_summary_weekly", "completed_totals",
                 "sale_badges", "daily_sales_windows", "export_summary_monthly"):
        text = formatted(REGISTRY[name](spark, SF))
        assert "Join" not in text, name


def test_month_function_would_not_push(spark, stored):
    """The reason periods are literal ranges: month()/year() are not pushed."""
    from pyspark.sql import functions as F
    sales, _ = stored
    df = sales.filter((F.month("created_at") == 6) & (F.year("created_at") == 1998))
    text = formatted(df.agg(F.sum("total")))
    assert "GreaterThanOrEqual(created_at" not in text


def test_aggregate_before_join_has_partial_aggregate(stored):
    sales, products = stored
    text = formatted(rankings.category_ranking(sales, products))
    assert "partial_sum" in text


def test_lists_of_three_periods_are_one_scan(spark, stored):
    sales, products = stored
    for df in (rankings.top_with_image_strip(sales, products, D.AS_OF_A), rankings.top_completed_strip(sales, products, D.AS_OF_A)):
        text = formatted(df)
        assert scans(df, "sales") == 1 and scans(df, "products") == 1
        assert "GreaterThanOrEqual(created_at,1998-06-01T00:00)" in text and "WindowGroupLimit" in text
    alone = {p: rankings.top_products_completed(sales, products, D.AS_OF_A, p).collect() for p in rankings.STRIP}
    strip = rankings.top_completed_strip(sales, products, D.AS_OF_A).orderBy("rank").collect()
    for p, rows in alone.items():
        assert [tuple(r) for r in rows] == [tuple(r)[2:] for r in strip if r.period == p]


def test_an_upsert_reads_its_table_once(spark, stored):
    _, products = stored
    done = changes.upsert_products(products, D.product_changes(spark, SF))
    assert scans(done.table, "products") == 1 and formatted(done.table).count("Join type: FullOuter") == 1
    assert scans(done.rejects, "products") == 1


def test_grouping_by_folded_names_hashes_the_sales(stored):
    sales, products = stored
    text = formatted(rankings.top_products_completed(sales, products, D.AS_OF_A, P.MONTHLY, collation="UNICODE_CI_AI"))
    tree = [line.strip(" +-:*(0123456789)") for line in text.split("\n\n")[0].splitlines() if "Aggregate" in line]
    assert tree[-2:] == ["HashAggregate", "HashAggregate"]  # next to the scan, before and after the exchange
