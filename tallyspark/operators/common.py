"""Helpers shared by the operators."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.periods import in_range, period_range
from tallyspark.sources.tables import SALE_MONTH


def is_ntz(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.TimestampNTZType)


def range_predicate(df: DataFrame, lo: dt.datetime | None, hi: dt.datetime | None,
                    col: str = "created_at") -> Column:
    """``lo <= col < hi`` as literals, plus a ``sale_month`` bound when the
    table is stored partitioned by month (so whole folders are pruned)."""
    pred = in_range(col, lo, hi, ntz=is_ntz(df, col))
    if SALE_MONTH in df.columns and col == "created_at":
        if lo is not None:
            pred = pred & (F.col(SALE_MONTH) >= F.lit(lo.date().replace(day=1)))
        if hi is not None:
            last = hi.date() if hi.time() != dt.time() else hi.date() - dt.timedelta(days=1)
            pred = pred & (F.col(SALE_MONTH) <= F.lit(last.replace(day=1)))
    return pred


def period_predicate(df: DataFrame, period: str, as_of, col: str = "created_at") -> Column:
    lo, hi = period_range(period, as_of)
    return range_predicate(df, lo, hi, col)


def and_all(preds) -> Column | None:
    preds = [p for p in preds if p is not None]
    if not preds:
        return None
    return reduce(lambda a, b: a & b, preds)


def filter_all(df: DataFrame, preds) -> DataFrame:
    p = and_all(preds)
    return df if p is None else df.filter(p)


def drop_partition_cols(df: DataFrame) -> DataFrame:
    return df.drop(SALE_MONTH) if SALE_MONTH in df.columns else df


def money_zero() -> Column:
    return F.lit(0).cast("decimal(12,2)")


# Marks that cut a group into ranges of like size.
MARKS = 200


def with_ranges(df: DataFrame, group: list[str], order: list[str], marks: int = MARKS) -> DataFrame:
    """``df`` with ``_range``: which part of its group's order (ascending,
    nulls first, ending in a unique column) a row lies in.

    The parts are cut at rows of the group itself, the ``marks`` with the
    smallest hash of the unique column, so they are of like size whatever the
    order looks like, and the same whenever they are worked out. Only ranks of
    at most ``marks`` leave a task."""
    key = F.struct(*order)
    by_hash = Window.partitionBy(*group).orderBy(F.xxhash64(F.lit("marks"), order[-1]), order[-1])
    chosen = df.select(*group, *order).withColumn("_n", F.row_number().over(by_hash)).filter(F.col("_n") <= marks)
    cuts = chosen.groupBy(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(group)]).agg(F.collect_list(key).alias("_marks"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_c{i}")) for i, c in enumerate(group)])
    return df.join(cuts, same).select(*df.columns, F.size(F.filter("_marks", lambda m: m <= key)).alias("_range"))


def with_positions(df: DataFrame, group: list[str], order: list[str], name: str, marks: int = MARKS) -> DataFrame:
    """``df`` with each row's place (from 0) among the rows of its group, in
    ascending ``order`` (as in ``with_ranges``).

    A row's place is its place in its range and the sizes of the group's
    earlier ranges: no window holds more than a range, or a group's sizes."""
    dealt = with_ranges(df, group, order, marks)
    sizes = dealt.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(group)], F.col("_range").alias("_r"),
                          F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_range").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    ranked = dealt.withColumn("_place", F.row_number().over(inside) - 1)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_c{i}")) for i, c in enumerate(group)])
    return ranked.join(before, same & (F.col("_range") == F.col("_r"))).withColumn(
        name, F.col("_before") + F.col("_place")).select(*df.columns, name)
