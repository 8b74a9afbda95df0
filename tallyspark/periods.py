"""Report periods as half-open ``[lo, hi)`` ranges computed from a report date.

The application has four meanings of "day/week/month" (SURVEY §2.3). Each is
turned into a literal range on the driver, so the predicate on ``created_at``
is a pair of comparisons that Catalyst pushes into the Parquet scan (and that
prunes date partitions), instead of ``month()``/``year()``/``yearweek()`` calls
that Spark cannot push down.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DAILY = "daily"
TRAILING7 = "trailing7"
CALENDAR_WEEK = "calendar_week"
MONTHLY = "monthly"
ALL = "all"
PERIODS = (DAILY, TRAILING7, CALENDAR_WEEK, MONTHLY, ALL)


def _as_date(as_of) -> dt.date:
    if isinstance(as_of, dt.datetime):
        return as_of.date()
    if isinstance(as_of, dt.date):
        return as_of
    if isinstance(as_of, str):
        try:
            return dt.date.fromisoformat(as_of.strip())
        except ValueError as exc:  # a malformed date filter is an error, not "no rows"
            raise ValueError(f"not a calendar date: {as_of!r}") from exc
    raise TypeError(f"report date must be a date or ISO string, got {type(as_of).__name__}")


def period_range(period: str, as_of) -> tuple[dt.datetime | None, dt.datetime | None]:
    """Half-open range of ``period`` around report date ``as_of``.

    daily: the day itself; trailing7: the day and the six before it;
    calendar_week: Monday..Sunday of the day's week (may include later days);
    monthly: the calendar month (may include later days); all: unbounded.
    """
    if period == ALL:
        return None, None
    d = _as_date(as_of)
    start = dt.datetime.combine
    if period == DAILY:
        return start(d, dt.time()), start(d + dt.timedelta(days=1), dt.time())
    if period == TRAILING7:
        return start(d - dt.timedelta(days=6), dt.time()), start(d + dt.timedelta(days=1), dt.time())
    if period == CALENDAR_WEEK:
        monday = d - dt.timedelta(days=d.weekday())
        return start(monday, dt.time()), start(monday + dt.timedelta(days=7), dt.time())
    if period == MONTHLY:
        first = d.replace(day=1)
        nxt = (first.replace(year=first.year + 1, month=1) if first.month == 12
               else first.replace(month=first.month + 1))
        return start(first, dt.time()), start(nxt, dt.time())
    raise ValueError(f"unknown period {period!r}; expected one of {PERIODS}")


# Report page filter names -> periods. Any other value means all time.
_REPORT_FILTERS = {"daily": DAILY, "weekly": CALENDAR_WEEK, "monthly": MONTHLY}


def report_period(filter_name: str | None) -> str:
    """Map the report page's ``filter`` value to a period name."""
    if filter_name is None:
        return DAILY  # the page defaults to daily when no filter is given
    return _REPORT_FILTERS.get(filter_name, ALL)


def ts_literal(value: dt.datetime, ntz: bool = True) -> Column:
    """A timestamp literal built from text (microseconds kept), so no
    time-zone shift can occur.

    ``ntz=True`` matches Parquet ``timestamp_ntz`` columns; ``ntz=False`` a
    session-zone ``timestamp`` column (JDBC sources).
    """
    text = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast("timestamp_ntz" if ntz else "timestamp")


def in_range(col: str | Column, lo: dt.datetime | None, hi: dt.datetime | None,
             ntz: bool = True) -> Column:
    """``lo <= col < hi``; a missing bound is omitted (``lit(True)`` if both are)."""
    c = F.col(col) if isinstance(col, str) else col
    parts = []
    if lo is not None:
        parts.append(c >= ts_literal(lo, ntz=ntz))
    if hi is not None:
        parts.append(c < ts_literal(hi, ntz=ntz))
    if not parts:
        return F.lit(True)
    return reduce(lambda a, b: a & b, parts)


def in_period(col: str | Column, period: str, as_of, ntz: bool = True) -> Column:
    lo, hi = period_range(period, as_of)
    return in_range(col, lo, hi, ntz=ntz)


def covering_range(periods, as_of) -> tuple[dt.datetime | None, dt.datetime | None]:
    """Smallest single range covering all given periods (None bound = open)."""
    ranges = [period_range(p, as_of) for p in periods]
    los = [r[0] for r in ranges]
    his = [r[1] for r in ranges]
    lo = None if any(x is None for x in los) else min(los)
    hi = None if any(x is None for x in his) else max(his)
    return lo, hi
