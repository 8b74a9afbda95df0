"""Answers worked out by hand for a few invented sales (report day: Wednesday
5 March 2031; week 3 to 9 March; trailing week 27 February to 5 March)."""
import datetime as dt
from decimal import Decimal

import pytest

from tallyspark import periods as P
from tallyspark import schemas as S
from tallyspark.operators import changes, kpis, rankings

AS_OF = "2031-03-05"
SALES = [  # sales_id, product_id, quantity, total, created_at, status
    (1, 1, 2, "40.00", "2031-03-05 09:00:00", "Completed"),
    (2, 2, 1, "12.50", "2031-03-05 10:30:00", "Cancelled"),
    (3, 1, 1, "20.00", "2031-03-04 23:59:59", "Completed"),
    (4, 3, 4, "36.00", "2031-03-01 08:00:00", "Completed"),
    (5, 2, 2, "25.00", "2031-02-27 12:00:00", "Completed"),
    (6, 3, 1, "9.00", "2031-02-26 12:00:00", "Completed"),
    (7, 2, 3, "37.50", "2031-03-07 11:00:00", "Completed"),
]
CATEGORY = {1: "Tea", 2: "Juice", 3: "Tea"}


@pytest.fixture(scope="module")
def shop(spark):
    sales = spark.createDataFrame(
        [(i, p, f"p{p}", q, Decimal(t), dt.datetime.fromisoformat(c), st, None) for i, p, q, t, c, st in SALES], S.SALES)
    products = spark.createDataFrame(
        [(p, f"p{p}", c, Decimal("9.00"), "Available", None) for p, c in CATEGORY.items()], S.PRODUCTS)
    return sales, products


def test_dashboard(shop):
    r = kpis.dashboard_kpis(shop[0], AS_OF).first()
    assert (r.daily, r.today_orders, r.weekly, r.monthly, r.forecast) == (
        Decimal("52.50"), 2, Decimal("133.50"), Decimal("146.00"), Decimal("160.60"))


def test_report(shop):
    day, week, month = (kpis.report_summary(shop[0], AS_OF, f).first() for f in ("daily", "weekly", "monthly"))
    assert (day.total_sales, day.total_transactions) == (Decimal("40.00"), 1)
    assert (week.total_sales, month.total_sales) == (Decimal("97.50"), Decimal("133.50"))
    assert kpis.period_sales_total(shop[0], AS_OF, P.TRAILING7, "Completed").first().total == Decimal("121.00")


def test_all_time_and_categories(shop):
    r = kpis.completed_totals(shop[0]).first()
    assert (r.total_sales, r.total_transactions) == (Decimal("167.50"), 6)
    rows = rankings.category_ranking(*shop).collect()
    assert [(x.rank, x.category, x.total_quantity, x.total_sales) for x in rows] == [
        (1, "Tea", 8, Decimal("105.00")), (2, "Juice", 5, Decimal("62.50"))]


def test_pricing(spark, shop):
    """(price 9.00 + available add-on 1.50) x 4."""
    addons = spark.createDataFrame([(1, "a1", Decimal("3.00"), "Unavailable"), (4, "a4", Decimal("1.50"), "Available")], S.ADDONS)
    req = spark.createDataFrame([(31, 3, 4, [4, 1], dt.datetime(2031, 3, 5, 14))], S.SALE_REQUESTS)
    res = changes.price_sales(req, shop[1], addons)
    row = res.accepted.first()
    assert row.total == Decimal("42.00") and row.status == "Completed"
    assert [(r.sale_id, r.addon_id, r.price) for r in res.addon_rows.collect()] == [(31, 4, Decimal("1.50"))]
