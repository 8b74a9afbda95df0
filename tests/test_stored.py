"""Changes on stored tables: which files change, and what a retry does."""
import os

import pytest
from pyspark.sql import functions as F

from tallyspark import schemas as S
from tallyspark.operators import changes as CH
from tallyspark.plans import stored as ST
from tallyspark.sources import driver_tables as D
from tallyspark.sources import files
from tallyspark.sources.tables import SALE_MONTH, read_table, rows_named, write_table
from tests.conftest import money, ts

SF = "/root/testdata/sf0.001"


def same(a, b):
    a = a.select(*b.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def listing(root, table="sales"):
    """Folder -> its data files; names are new whenever Spark writes."""
    return {d[len(root):]: sorted(f for f in names if f.startswith("part-"))
            for d, _, names in os.walk(os.path.join(root, table)) if any(f.startswith("part-") for f in names)}


def month_of(text):
    return f"/sales/{SALE_MONTH}={text}"


@pytest.fixture
def shop(spark, tmp_path):
    """Sales 1 to 48, four a month of 2024, and one without a time."""
    sales = [(i, i % 5, f"p{i}", 1, money("2.00"), ts(f"2024-{(i - 1) // 4 + 1:02d}-{1 + 7 * ((i - 1) % 4):02d} 12:00:00"),
              ["Completed", "Cancelled", None, "Completed"][i % 4], None) for i in range(1, 49)] + [(99, None, "x", 1, None, None, "Completed", "")]
    root = str(tmp_path)
    write_table(spark.createDataFrame(sales, S.SALES), root, "sales")
    write_table(spark.createDataFrame([(i, i % 60, 1, "a", money("1.00")) for i in range(150)], S.SALE_ADDONS), root, "sale_addons")
    write_table(spark.createDataFrame([(1, 3, "r", ts("2024-02-01 00:00:00")), (2, 40, "r", ts("2024-11-01 00:00:00"))], S.SALES_VOID), root, "sales_void")
    write_table(spark.createDataFrame([(i, f"p{i}", "c", money("2.00"), "Available", "") for i in range(5)], S.PRODUCTS), root, "products")
    return root


def snapshot(spark, root):
    """What the tables hold before a change, on the driver (the files go)."""
    return {t: spark.createDataFrame(read_table(spark, root, t).collect(), read_table(spark, root, t).schema)
            for t in ("sales", "sale_addons", "sales_void", "products")}


def test_statuses_touch_their_months_only(spark, shop):
    was, files_were = snapshot(spark, shop), listing(shop)
    # 6 is already null-status, 5 is Cancelled (a cancel changes nothing), 21 is void, 7 completed.
    cancels = spark.createDataFrame([(5,), (7,), (7,), (None,), (1000,)], S.CANCEL_REQUESTS)
    voids = spark.createDataFrame([(10, 21, " why ", ts("2024-12-01 00:00:00")), (11, 777, "no sale", None), (12, -1, "bad", None)], S.VOID_REQUESTS)
    assert ST.apply_statuses(spark, shop, 1, cancels, voids)
    want = CH.apply_status_changes(was["sales"], cancels, voids)
    assert same(read_table(spark, shop, "sales"), want)
    log = CH.apply_voids(was["sales"], was["sales_void"], voids)
    assert same(read_table(spark, shop, "sales_void"), log.sales_void)
    assert same(ST.output(spark, shop, 1, "void_rejects"), log.rejects)
    now = listing(shop)
    assert {d for d in now if now[d] != files_were[d]} == {month_of("2024-02-01"), month_of("2024-06-01")} and set(now) == set(files_were)
    # Again, under the same number and a new one: no file of the sales changes.
    assert not ST.apply_statuses(spark, shop, 1, cancels, voids)
    assert ST.apply_statuses(spark, shop, 2, cancels, voids)
    assert listing(shop) == now and read_table(spark, shop, "sales_void").count() == log.sales_void.count()
    assert files.folders(spark, os.path.join(shop, "_changes", "batch=1")) == ["applied", "output_void_rejects", "plan"]


def test_a_sale_without_a_time_can_be_voided(spark, shop):
    before = listing(shop)
    ST.apply_statuses(spark, shop, 1, None, spark.createDataFrame([(1, 99, "", None)], S.VOID_REQUESTS))
    now = listing(shop)
    assert {d for d in now if now[d] != before[d]} == {month_of(ST.NO_MONTH)}
    assert read_table(spark, shop, "sales").filter("sales_id = 99").first().status == S.STATUS_VOID


def test_nothing_named(spark, shop):
    before = listing(shop)
    ST.apply_statuses(spark, shop, 1, spark.createDataFrame([], S.CANCEL_REQUESTS), spark.createDataFrame([], S.VOID_REQUESTS))
    assert listing(shop) == before and ST.output(spark, shop, 1, "void_rejects").count() == 0


@pytest.mark.parametrize("at", ["2024-05-10 00:00:00", "2024-05-01 00:00:00", "2024-05-30 00:00:00", "2030-01-01 00:00:00", "2020-01-01 00:00:00"])
def test_reset_drops_folders_and_cuts_one_month(spark, shop, at):
    was, before = snapshot(spark, shop), listing(shop)
    want = CH.reset_history(was["sales"], was["sale_addons"], was["sales_void"], at)
    want = {t: getattr(want, t).select(*S.TABLES[t].names).collect() for t in ("sales", "sale_addons", "sales_void")}
    ST.reset_sales(spark, shop, 1, at)
    now = listing(shop)
    later = {d for d in before if d > month_of(at[:8] + "01") and ST.NO_MONTH not in d}
    assert {d for d in now if d in before and now[d] == before[d]} == later | ({month_of(at[:8] + "01")} & set(before) if at[8:10] == "01" else set())
    for t, rows in want.items():
        got = read_table(spark, shop, t).select(*S.TABLES[t].names).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, rows)), t


def test_deleted_products_leave_other_months_alone(spark, shop):
    was, before = snapshot(spark, shop), listing(shop)
    ids = spark.createDataFrame([(3,), (None,), (77,)], "product_id long")
    want = CH.delete_products(was["products"], was["sales"].filter("sales_id <= 48"), ids)
    ST.delete_products(spark, shop, 1, ids)
    assert same(read_table(spark, shop, "sales").filter("sales_id <= 48"), want.sales) and same(read_table(spark, shop, "products"), want.products)
    now, hit = listing(shop), {f"2024-{(i - 1) // 4 + 1:02d}-01" for i in range(1, 49) if i % 5 == 3}
    assert {d for d in now if now[d] != before[d]} == {month_of(m) for m in hit}


def test_a_job_that_fails_while_it_applies_goes_on_from_its_stage(spark, shop, monkeypatch):
    was = snapshot(spark, shop)
    want = CH.reset_history(was["sales"], was["sale_addons"], was["sales_void"], "2024-05-10 00:00:00")

    def broken():
        raise OSError("lost")
    with monkeypatch.context() as m:
        remove = files.remove
        m.setattr(ST.files, "remove", lambda spark, path: broken() if "/sales/" in path else remove(spark, path))
        with pytest.raises(OSError):
            ST.reset_sales(spark, shop, 1, "2024-05-10 00:00:00")
    with pytest.raises(RuntimeError, match="batch=1"):
        ST.apply_statuses(spark, shop, 2, spark.createDataFrame([(44,)], S.CANCEL_REQUESTS))
    assert ST.reset_sales(spark, shop, 1, "2024-05-10 00:00:00")
    for t in ("sales", "sale_addons", "sales_void"):
        assert same(read_table(spark, shop, t), getattr(want, t)), t


def test_a_job_that_fails_while_it_computes_leaves_the_tables(spark, shop):
    before = listing(shop), listing(shop, "sale_addons")
    bad = spark.createDataFrame([(7,)], S.CANCEL_REQUESTS).withColumn("sale_id", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception):
        ST.apply_statuses(spark, shop, 1, bad)
    assert (listing(shop), listing(shop, "sale_addons")) == before
    assert ST.apply_statuses(spark, shop, 1, spark.createDataFrame([(7,)], S.CANCEL_REQUESTS))


def test_the_lookup_reads_ids_only_and_skips_row_groups(spark, shop):
    sales = read_table(spark, shop, "sales")
    named = spark.createDataFrame([(7,)], "sales_id long")
    hit = rows_named(sales, "sales_id", named).join(named, "sales_id").select(SALE_MONTH).distinct()
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(sales_id,7)" in plan and "ReadSchema: struct<sales_id:bigint>" in plan
    wide = rows_named(sales, "sales_id", spark.createDataFrame([(7,), (9,)], "sales_id long"), most=1)
    assert "GreaterThanOrEqual(sales_id,7)" in wide._jdf.queryExecution().executedPlan().toString()
    assert rows_named(sales, "sales_id", named.filter("false")).count() == 0
    assert ST.touched_months(sales, named, "sales_id") == ["2024-02-01"]
    pruned = sales.filter(ST.in_months(["2024-02-01", ST.NO_MONTH]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in pruned and "Filter" not in pruned.split("FileScan")[0]
    assert len(sales.filter(ST.in_months(["2024-02-01"])).inputFiles()) <= len(sales.inputFiles())


def test_audit(spark, tmp_path):
    from tallyspark.operators import audit as AU
    root = str(tmp_path)
    write_table(D.audit_logs(spark, SF), root, "audit_logs")
    plain = D.audit_entries_without_reset(spark, SF)
    want = AU.append_audit(D.audit_logs(spark, SF), plain)
    ST.log_audit(spark, root, 1, plain)
    assert same(read_table(spark, root, "audit_logs"), want)
    ST.log_audit(spark, root, 2, D.audit_entries(spark, SF))
    assert same(read_table(spark, root, "audit_logs"), AU.append_audit(want, D.audit_entries(spark, SF)))
