"""Period ranges against the database-style definitions, evaluated by DuckDB
(ISO year-week equality = week mode 1, month/year equality, date equality,
trailing window), over random report dates and sale times around them,
including year boundaries. The Spark predicate is exactly ``lo <= ts < hi``
with these bounds (see ``tests/test_plans.py`` for what reaches the scan)."""
import datetime as dt

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark import periods as P

dates = st.dates(min_value=dt.date(1990, 1, 1), max_value=dt.date(2040, 12, 31))
offsets = st.integers(min_value=-40 * 24 * 3600 * 10**6, max_value=40 * 24 * 3600 * 10**6)
CON = duckdb.connect()


def inside(period, d, ts):
    lo, hi = P.period_range(period, d)
    return lo <= ts < hi


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(dates, offsets), min_size=1, max_size=200))
def test_periods_match_sql_definitions(pairs):
    rows = [(d, dt.datetime.combine(d, dt.time()) + dt.timedelta(microseconds=o)) for d, o in pairs]
    CON.execute("CREATE OR REPLACE TABLE t (n INTEGER, d DATE, ts TIMESTAMP)")
    CON.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, d, ts) for i, (d, ts) in enumerate(rows)])
    want = CON.execute("""
        SELECT yearweek(ts) = yearweek(d),
               month(ts) = month(d) AND year(ts) = year(d),
               CAST(ts AS DATE) = d,
               ts >= d - INTERVAL 6 DAY AND ts < d + INTERVAL 1 DAY
        FROM t ORDER BY n""").fetchall()
    got = [(inside(P.CALENDAR_WEEK, d, ts), inside(P.MONTHLY, d, ts),
            inside(P.DAILY, d, ts), inside(P.TRAILING7, d, ts)) for d, ts in rows]
    assert got == [tuple(w) for w in want]
