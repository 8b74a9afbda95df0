import datetime as dt

import pytest

from tallyspark import periods as P

D = dt.datetime


def test_daily_and_trailing7():
    assert P.period_range("daily", "2030-05-15") == (D(2030, 5, 15), D(2030, 5, 16))
    assert P.period_range("trailing7", "2030-05-15") == (D(2030, 5, 9), D(2030, 5, 16))


def test_calendar_week_is_monday_based_and_crosses_new_year():
    assert P.period_range("calendar_week", "2030-05-15") == (D(2030, 5, 13), D(2030, 5, 20))
    # 2027-01-01 is a Friday: its Monday week starts in the old year.
    assert P.period_range("calendar_week", "2027-01-01") == (D(2026, 12, 28), D(2027, 1, 4))


def test_monthly_handles_december():
    assert P.period_range("monthly", "2030-12-31") == (D(2030, 12, 1), D(2031, 1, 1))


def test_report_filters():
    assert P.report_period("weekly") == "calendar_week"
    assert P.report_period(None) == "daily"
    assert P.report_period("whatever") == "all"
    assert P.period_range("all", "2030-01-01") == (None, None)


def test_malformed_date_is_an_error():
    with pytest.raises(ValueError):
        P.period_range("daily", "15/05/2030")


def test_covering_range():
    lo, hi = P.covering_range(["daily", "trailing7", "monthly"], "2030-05-15")
    assert (lo, hi) == (D(2030, 5, 1), D(2030, 6, 1))
