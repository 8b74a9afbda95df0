"""Period KPIs: sales totals, order counts, forecast, dashboard and report strips.

Every period is a literal half-open range on ``created_at`` (pushed into the
Parquet scan, and pruning ``sale_date`` folders when present). A strip of
several KPIs is one scan with conditional sums over the union of the periods,
not one job per KPI. A global aggregate needs no shuffle of rows: each task
reduces its rows to one partial row.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark import periods as P
from tallyspark import schemas as S
from tallyspark.operators.common import money_zero, period_predicate, range_predicate


def _status_filter(status: str | None) -> Column | None:
    return None if status is None else (F.col("status") == F.lit(status))


def _scoped(sales: DataFrame, period: str, as_of, status: str | None) -> DataFrame:
    pred = period_predicate(sales, period, as_of)
    st = _status_filter(status)
    if st is not None:
        pred = pred & st
    return sales.filter(pred)


def _sum_or_zero(col: Column) -> Column:
    return F.coalesce(F.sum(col), money_zero())


def period_sales_total(sales: DataFrame, as_of, period: str = P.DAILY,
                       status: str | None = None) -> DataFrame:
    """Sum of ``total`` in the period (0 when there is none).

    The dashboard passes no status (cancelled and voided sales count); the
    report passes ``Completed``.
    """
    return _scoped(sales, period, as_of, status).agg(_sum_or_zero(F.col("total")).alias("total"))


def period_order_count(sales: DataFrame, as_of, period: str = P.DAILY,
                       status: str | None = None) -> DataFrame:
    """Number of sales rows in the period."""
    return _scoped(sales, period, as_of, status).agg(F.count(F.lit(1)).alias("orders"))


def monthly_forecast(sales: DataFrame, as_of, growth: str = S.FORECAST_GROWTH,
                     status: str | None = None) -> DataFrame:
    """Current-month total times the growth factor (exact decimal)."""
    g = F.lit(Decimal(growth))
    return (period_sales_total(sales, as_of, P.MONTHLY, status)
            .select((F.col("total") * g).alias("forecast")))


def _conditional_strip(sales: DataFrame, as_of, status: str | None, parts: dict) -> DataFrame:
    """One scan over the union of the periods; each KPI sums its own slice.

    ``parts`` maps output name -> (kind, period) with kind "sum" or "count".
    """
    periods = sorted({p for _, p in parts.values()})
    lo, hi = P.covering_range(periods, as_of)
    pred = range_predicate(sales, lo, hi)
    st = _status_filter(status)
    scoped = sales.filter(pred if st is None else pred & st)
    aggs = []
    for name, (kind, period) in parts.items():
        inside = period_predicate(sales, period, as_of) if period != P.ALL else F.lit(True)
        if kind == "sum":
            aggs.append(_sum_or_zero(F.when(inside, F.col("total"))).alias(name))
        else:
            aggs.append(F.count(F.when(inside, F.lit(1))).alias(name))
    return scoped.agg(*aggs)


def dashboard_kpis(sales: DataFrame, as_of, growth: str = S.FORECAST_GROWTH) -> DataFrame:
    """Daily, trailing-7 and monthly totals, today's orders and the
    forecast in one row, from a single scan. All statuses count."""
    strip = _conditional_strip(sales, as_of, None, {
        "daily": ("sum", P.DAILY),
        "weekly": ("sum", P.TRAILING7),
        "monthly": ("sum", P.MONTHLY),
        "today_orders": ("count", P.DAILY),
    })
    return strip.withColumn("forecast", F.col("monthly") * F.lit(Decimal(growth)))


def report_summary(sales: DataFrame, as_of, filter_name: str | None = "daily") -> DataFrame:
    """Completed total and count for the report filter (daily, weekly =
    calendar week, monthly, anything else = all time)."""
    period = P.report_period(filter_name)
    scoped = _scoped(sales, period, as_of, S.STATUS_COMPLETED)
    return scoped.agg(_sum_or_zero(F.col("total")).alias("total_sales"),
                      F.count(F.lit(1)).alias("total_transactions"))


def completed_totals(sales: DataFrame) -> DataFrame:
    """All-time Completed total and count (sales page header)."""
    return report_summary(sales, None, "all")


def report_kpis(sales: DataFrame, as_of, filter_name: str | None = "daily") -> DataFrame:
    """The report strip in one scan, Completed only: filtered total and
    count, trailing-7 total, month total, today's orders."""
    period = P.report_period(filter_name)
    return _conditional_strip(sales, as_of, S.STATUS_COMPLETED, {
        "total_sales": ("sum", period),
        "total_transactions": ("count", period),
        "weekly_sales": ("sum", P.TRAILING7),
        "monthly_sales": ("sum", P.MONTHLY),
        "today_orders": ("count", P.DAILY),
    })
