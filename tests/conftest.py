import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from tallyspark.session import local_session
    s = local_session("*", shuffle_partitions=8, app_name="tallyspark-tests")
    yield s
    s.stop()


def ts(text):
    return None if text is None else dt.datetime.fromisoformat(text)


def money(x):
    return None if x is None else Decimal(str(x))


@pytest.fixture(scope="session")
def edge(spark):
    """Invented edge rows of FIXTURES.md §2 (report date 2030-05-15, a Wednesday)."""
    from tallyspark import schemas as S
    sales = spark.createDataFrame([
        (1, 10, "Café Uno", 2, money("20.00"), ts("2030-05-15 00:00:00"), "Completed", "a.jpg"),
        (2, 10, "Café Uno", 1, money("10.00"), ts("2030-05-15 23:59:59.999999"), "Cancelled", "a.jpg"),
        (3, 11, "CAFE duo", 3, money("45.00"), ts("2030-05-16 00:00:00"), "Completed", ""),
        (4, 11, "CAFE duo", 1, money("15.00"), ts("2030-05-09 00:00:00"), "VOID", ""),
        (5, 12, "50% mix", 1, money("7.50"), ts("2030-05-08 23:59:59"), "Completed", None),
        (6, None, "Gone", 4, money("40.00"), ts("2030-05-14 12:00:00"), "Completed", None),
        (7, 10, "Café Uno", 1, money("11.00"), ts("2030-04-30 23:59:59"), "Completed", "a.jpg"),
        (8, 10, "Café Uno", 0, money("0.00"), ts("2029-05-15 10:00:00"), "pending", "a.jpg"),
        (9, 11, "CAFE duo", 2, money("30.00"), None, "Completed", ""),
    ], S.SALES)
    products = spark.createDataFrame([
        (10, "Café Uno", "A", money("10.00"), "Available", "a.jpg"),
        (11, "CAFE duo", "B", money("15.00"), "Available", ""),
        (12, "50% mix", None, money("7.50"), "Unavailable", None),
    ], S.PRODUCTS)
    ingredients = spark.createDataFrame([
        (1, "i1", 5, 5, "Box-based", "x.png"),
        (2, "i2", 15, 5, "Box-based", None),
        (3, "i3", 16, 5, None, ""),
        (4, "i4", 6, None, "Can-based", None),
        (5, "i5", None, 5, "pcs", None),
        (6, "i6", 0, None, "Pack-based", None),
        (7, "i7", 0, 0, "Pack-based", None),
        (8, "i8", 1, 0, "Pack-based", None),
    ], S.INGREDIENTS)
    addons = spark.createDataFrame([
        (1, "Shot", money("1.50"), "Available"),
        (2, "Foam", money("2.00"), "Unavailable"),
    ], S.ADDONS)
    return {"sales": sales, "products": products, "ingredients": ingredients, "addons": addons,
            "as_of": "2030-05-15"}
