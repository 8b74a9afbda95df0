"""Every registered query against its DuckDB oracle on the sf0.001 tables."""
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as E  # noqa: E402
from tallyspark.plans.queries import REGISTRY  # noqa: E402
from compare_oracle import compare_rows, duck  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = sorted(REGISTRY)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(REGISTRY) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = [tuple(r[c] for c in cols) for r in df.collect()]
    rel = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in rel.description]
    assert sorted(ocols) == cols
    orows = [tuple(r[ocols.index(c)] for c in cols) for r in rel.fetchall()]
    assert compare_rows(rows, orows)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "qty_sold" in df.columns
