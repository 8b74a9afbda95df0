"""Exact money and percentage arithmetic.

All arithmetic is decimal and rounds half away from zero (Spark's ``round`` on
decimals), which is how the application's number formatting rounds. Spark's
``format_number`` alone rounds half-even, so formatting always rounds first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def unit_price(total: str | Column = "total", quantity: str | Column = "quantity") -> Column:
    """``total / max(quantity, 1)`` to 2 decimals; NULL total counts as 0 and a
    NULL or non-positive quantity divides by 1, so the divisor is never 0."""
    num = F.coalesce(_c(total).cast("decimal(20,2)"), F.lit(0).cast("decimal(20,2)"))
    den = F.greatest(_c(quantity), F.lit(1)).cast("decimal(12,0)")
    return F.round(num / den, 2).cast("decimal(20,2)")


def fill_percent(stock: str | Column = "stock",
                 threshold: str | Column = "low_stock_threshold") -> Column:
    """Stock bar width: ``min(100, round(stock / max(3*threshold, 1) * 100))``.

    NULL stock counts as 0 and a NULL threshold as 0 (so the reference is 1).
    """
    s = F.coalesce(_c(stock), F.lit(0)).cast("decimal(20,0)")
    ref = F.greatest(F.coalesce(_c(threshold), F.lit(0)).cast("long") * 3, F.lit(1)).cast("decimal(20,0)")
    return F.least(F.lit(100), F.round(s * 100 / ref, 0).cast("long"))


def format_money(col: str | Column, decimals: int = 2) -> Column:
    """Presentation only: thousands separators after half-up rounding."""
    return F.format_number(F.round(_c(col).cast("decimal(38,6)"), decimals), decimals)
