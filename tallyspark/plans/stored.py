"""Changes applied to the stored tables, by the folders they touch.

Each job is one batch: cancels and voids, the sales reset, deletions, upserts,
audit entries. A job works out the new contents of the folders that change,
stages them under ``<root>/_changes/batch=<n>`` and only then replaces them, so
a job that fails while it reads or computes leaves the tables as they are, and
one that fails while it replaces goes on from the stage when it is run again.
A batch that was applied is not applied twice, whatever it is given.

Sales are partitioned by month. Months that hold no changed sale keep their
files: they are found by a scan of the ids alone, narrowed by the batch's ids
(row groups without them are skipped), and only the months found are read whole
and written, by Spark's dynamic partition overwrite. A
reset drops whole months as folders and rewrites the one it cuts through.

Batches of one root are applied one after another, by one caller at a time.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import schemas as S
from tallyspark.operators import audit as AU
from tallyspark.operators import changes as CH
from tallyspark.sources import files
from tallyspark.sources.tables import CLUSTER_KEYS, SALE_MONTH, ShopTables, conform, read_table, read_tables, rows_named, write_table

# Spark's folder for rows without a partition value (a sale without a time).
NO_MONTH = "__HIVE_DEFAULT_PARTITION__"


@dataclass
class Change:
    """What a batch does: whole tables and months of sales with new contents,
    months that go, rows that are added, and outputs for the caller (rejects)."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    sales: DataFrame | None = None
    months: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    added: dict[str, DataFrame] = field(default_factory=dict)
    outputs: dict[str, DataFrame] = field(default_factory=dict)


# Key by which rows that were added are found again.
ROW_KEYS = {"sales_void": "void_id", "audit_logs": "log_id"}


def output(spark: SparkSession, root: str, batch: int, name: str) -> DataFrame:
    """An output of an applied batch, such as its rejects."""
    return spark.read.parquet(_stage(root, batch, f"output_{name}"))


def months_of(spark: SparkSession, root: str) -> list[str]:
    """The months that the stored sales have folders for."""
    found = files.folders(spark, os.path.join(root, "sales"))
    return [f.split("=", 1)[1] for f in found if f.startswith(SALE_MONTH + "=")]


def in_months(months: list[str]) -> Column:
    """Sales of these months, as a predicate that prunes folders."""
    dated = [dt.date.fromisoformat(m) for m in months if m != NO_MONTH]
    pred = F.col(SALE_MONTH).isin(dated) if dated else F.lit(False)
    return pred | F.col(SALE_MONTH).isNull() if NO_MONTH in months else pred


def touched_months(sales: DataFrame, named: DataFrame, key: str, changes: Column | None = None) -> list[str]:
    """The months of stored ``sales`` that hold a row whose ``key`` is among
    those of ``named`` (and for which ``changes`` holds).

    Reads the key, the month and what ``changes`` needs, and of these only what
    may hold a named key (``rows_named``). At most one row per month reaches
    the driver."""
    hit = rows_named(sales, key, named.select(key)).join(named, key)
    if changes is not None:
        hit = hit.filter(changes)
    months = hit.select(SALE_MONTH).distinct().collect()
    return sorted(NO_MONTH if r[0] is None else r[0].isoformat() for r in months)


def _stage(root: str, batch: int, *parts: str) -> str:
    return os.path.join(root, "_changes", f"batch={int(batch)}", *parts)


def _pending(spark: SparkSession, root: str, but: int) -> list[str]:
    base = os.path.join(root, "_changes")
    return [b for b in files.folders(spark, base) if b != f"batch={int(but)}"
            and files.exists(spark, os.path.join(base, b, "plan", "_SUCCESS"))
            and not files.exists(spark, os.path.join(base, b, "applied", "_SUCCESS"))]


def run_change(spark: SparkSession, root: str, batch: int, work_out: Callable[[ShopTables], Change]) -> bool:
    """Apply one batch; returns whether this call applied it."""
    if files.exists(spark, _stage(root, batch, "applied", "_SUCCESS")):
        return False
    if left := _pending(spark, root, batch):
        raise RuntimeError(f"{', '.join(left)} was staged but not applied; run it again first")
    if not files.exists(spark, _stage(root, batch, "plan", "_SUCCESS")):
        files.remove(spark, _stage(root, batch))
        _write_stage(spark, root, batch, work_out(read_tables(spark, root)))
    _apply_stage(spark, root, batch)
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(_stage(root, batch, "applied"))
    for folder in files.folders(spark, _stage(root, batch)):
        if folder not in ("applied", "plan") and not folder.startswith("output_"):
            files.remove(spark, _stage(root, batch, folder))
    return True


def _write_stage(spark: SparkSession, root: str, batch: int, change: Change) -> None:
    steps = []
    for name, df in change.outputs.items():
        df.write.parquet(_stage(root, batch, f"output_{name}"))
    for table, df in change.tables.items():
        write_table(df, _stage(root, batch, "whole"), table)
        steps.append(("whole", table))
    for table, df in change.added.items():
        write_table(df, _stage(root, batch, "added"), table)
        steps.append(("added", table))
    if change.sales is not None and change.months:
        write_table(change.sales, _stage(root, batch, "months"), "sales")
        written = [f.split("=", 1)[1] for f in files.folders(spark, _stage(root, batch, "months", "sales")) if "=" in f]
        steps += [("month", m) for m in written]
        # A month that has no row left goes.
        change.dropped = sorted({*change.dropped, *change.months} - set(written))
    steps += [("drop", m) for m in change.dropped]
    # The plan is complete when everything before it is.
    spark.createDataFrame(steps, "step string, name string").coalesce(1).write.parquet(_stage(root, batch, "plan"))


def _apply_stage(spark: SparkSession, root: str, batch: int) -> None:
    steps = [tuple(r) for r in spark.read.parquet(_stage(root, batch, "plan")).collect()]  # a row per table and month
    for step, table in steps:
        if step == "whole":
            write_table(read_table(spark, _stage(root, batch, "whole"), table), root, table)
        elif step == "added":
            new, key = read_table(spark, _stage(root, batch, "added"), table), ROW_KEYS[table]
            if files.exists(spark, os.path.join(root, table)):
                ends = new.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
                there = read_table(spark, root, table).filter(F.col(key).between(F.lit(ends.lo), F.lit(ends.hi))).alias("there")
                # Less the rows that an earlier try has added.
                equal = [F.col(f"new.{c}").eqNullSafe(F.col(f"there.{c}")) for c in new.columns]
                new = new.alias("new").join(there, reduce(lambda x, y: x & y, equal), "left_anti")
            write_table(new, root, table, mode="append")
    if any(step == "month" for step, _ in steps):
        staged = read_table(spark, _stage(root, batch, "months"), "sales")
        (staged.sortWithinPartitions(*CLUSTER_KEYS["sales"]).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(SALE_MONTH).parquet(os.path.join(root, "sales")))
    for step, month in steps:
        if step == "drop":
            files.remove(spark, os.path.join(root, "sales", f"{SALE_MONTH}={month}"))


def apply_statuses(spark: SparkSession, root: str, batch: int, cancel_ids: DataFrame | None = None,
                   voids: DataFrame | None = None) -> bool:
    """Cancel and void stored sales and log the voids; output
    ``void_rejects``. Only months with a sale whose status changes are
    written."""
    def work_out(t: ShopTables) -> Change:
        flags = CH.status_flags(cancel_ids, voids)
        out = Change()
        out.months = touched_months(t.sales, flags, "sales_id", ~CH.new_status().eqNullSafe(F.col("status")))
        out.sales = CH.with_status(t.sales.filter(in_months(out.months)), flags)
        if voids is not None:
            near = rows_named(t.sales, "sales_id", voids.select("sale_id"))
            applied, out.outputs["void_rejects"] = CH.split_voids(near, voids)
            out.added["sales_void"] = CH.void_log(applied)
        return out
    return run_change(spark, root, batch, work_out)


def reset_sales(spark: SparkSession, root: str, batch: int, reset_at) -> bool:
    """Every stored sale before ``reset_at`` (or without a time) goes,
    with its add-on and void rows. Months before it are dropped unread; the
    month it falls in is rewritten; later months keep their files and only
    lend their ids to the semi-joins of the child tables."""
    at = reset_at if isinstance(reset_at, dt.datetime) else dt.datetime.fromisoformat(str(reset_at))
    border = at.date().replace(day=1).isoformat()

    def work_out(t: ShopTables) -> Change:
        months = months_of(spark, root)
        out = Change(dropped=[m for m in months if m == NO_MONTH or m < border])
        children = {name: df for name, df in (("sale_addons", t.sale_addons), ("sales_void", t.sales_void)) if df is not None}
        kept = CH.reset_history(t.sales, **{"sale_addons": spark.createDataFrame([], S.SALE_ADDONS),
                                            "sales_void": spark.createDataFrame([], S.SALES_VOID), **children}, reset_at=at)
        out.tables = {name: getattr(kept, name) for name in children}
        if border in months and at != dt.datetime.fromisoformat(border):
            out.months = [border]
            out.sales = kept.sales.filter(in_months([border]))
        return out
    return run_change(spark, root, batch, work_out)


def delete_products(spark: SparkSession, root: str, batch: int, ids: DataFrame) -> bool:
    """Products go; stored sales that name one lose its id, in the months
    that hold such sales."""
    def work_out(t: ShopTables) -> Change:
        gone = ids.select("product_id").filter(F.col("product_id").isNotNull()).distinct()
        out = Change(months=touched_months(t.sales, gone, "product_id"))
        done = CH.delete_products(t.products, t.sales.filter(in_months(out.months)), ids)
        out.tables, out.sales = {"products": done.products}, done.sales
        return out
    return run_change(spark, root, batch, work_out)


def change_catalog(spark: SparkSession, root: str, batch: int, product_changes: DataFrame | None = None,
                   ingredient_changes: DataFrame | None = None, ingredient_deletes: DataFrame | None = None) -> bool:
    """Upserts of products and ingredients, then deletions of
    ingredients; outputs ``product_rejects`` and ``ingredient_rejects``."""
    def work_out(t: ShopTables) -> Change:
        out = Change()
        if product_changes is not None:
            done = CH.upsert_products(t.products, product_changes)
            out.tables["products"], out.outputs["product_rejects"] = done.table, done.rejects
        stock = t.ingredients
        if ingredient_changes is not None:
            done = CH.upsert_ingredients(stock, ingredient_changes)
            stock, out.outputs["ingredient_rejects"] = done.table, done.rejects
        if ingredient_deletes is not None:
            stock = CH.delete_ingredients(stock, ingredient_deletes)
        if stock is not t.ingredients:
            out.tables["ingredients"] = stock
        return out
    return run_change(spark, root, batch, work_out)


def log_audit(spark: SparkSession, root: str, batch: int, entries: DataFrame) -> bool:
    """Entries of one batch join the stored log; a reset among them
    replaces it."""
    def work_out(t: ShopTables) -> Change:
        if AU.resets(entries).isEmpty():
            return Change(added={"audit_logs": conform(entries, "audit_logs")})
        return Change(tables={"audit_logs": AU.append_audit(t.audit_logs, entries)})
    return run_change(spark, root, batch, work_out)
