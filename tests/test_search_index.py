"""The search index: same rows as a scan, from fewer files."""
import pytest
from pyspark.sql import functions as F

from tallyspark import schemas as S
from tallyspark.operators import catalog
from tallyspark.sources import search_index as SI
from tallyspark.sources.tables import read_table, write_table
from tests.conftest import money

NAMES = ["Café Latte", "CAFE MOCHA", "50% off mix", "50_off", "back\\slash tea", "Green Tea", "green  tea", "Ubé", "x", "", None, "Straße", "ΣΊΓΜΑ blend", "0"]


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """A name per file or so: products 0 to 139, ten of each name, in 14 files."""
    root = str(tmp_path_factory.mktemp("search"))
    rows = [(i, NAMES[i // 10], "c", money("1.00"), "Available", None) for i in range(140)]
    write_table(spark.createDataFrame(rows, S.PRODUCTS), root, "products", files=14)
    SI.build_search_index(spark, root, "products", "product_name")
    return root


TERMS = ["cafe", "CAFÉ ", "latte", "50\\% o", "50\\_", "50%mix", "gr_en", "tea", "te", "back\\\\sl", "ube", "e  t", "%", "_", None, "0", "no such name", "σίγμα", "off%x", "straße"]


@pytest.mark.parametrize("term", TERMS)
def test_same_rows_as_a_scan(spark, root, term):
    whole, narrowed = read_table(spark, root, "products"), SI.read_candidates(spark, root, "products", "product_name", term)
    take = lambda df: sorted(map(repr, catalog.product_search(df, term).collect()))
    assert take(narrowed) == take(whole)


def test_fewer_files_are_read(spark, root):
    every = read_table(spark, root, "products").inputFiles()
    read = lambda term: len(SI.candidate_files(spark, root, "products", "product_name", term))
    assert len(every) >= 10 and read("te") == read("%") == read(None) == len(every)
    assert 1 <= read("latte") <= 3 and 1 <= read("50%mix") <= 3 and 1 <= read("gre_n te") <= 5 and read("no such name") == 0


def test_files_written_later_are_read(spark, tmp_path):
    root = str(tmp_path)
    row = lambda i, n: (i, n, "c", money("1.00"), "Available", None)
    write_table(spark.createDataFrame([row(1, "Latte")], S.PRODUCTS), root, "products", files=1)
    assert len(SI.candidate_files(spark, root, "products", "product_name", "mocha")) == 1  # no index yet
    SI.build_search_index(spark, root, "products", "product_name")
    assert SI.candidate_files(spark, root, "products", "product_name", "mocha") == []
    write_table(spark.createDataFrame([row(2, "Mocha")], S.PRODUCTS), root, "products", mode="append", files=1)
    found = SI.read_candidates(spark, root, "products", "product_name", "mocha")
    assert [r.product_id for r in catalog.product_search(found, "mocha").collect()] == [2]


def test_months_stay_columns(spark, tmp_path):
    from tallyspark.sources import driver_tables as D
    sf = "/root/testdata/sf0.001"
    root = str(tmp_path)
    write_table(D.sales_b(spark, sf), root, "sales")
    SI.build_search_index(spark, root, "sales", "product_name")
    found = SI.read_candidates(spark, root, "sales", "product_name", "red", trim=False)
    assert "sale_month" in found.columns
    whole = read_table(spark, root, "sales").filter(F.lower("product_name").contains("red"))
    assert found.filter(F.lower("product_name").contains("red")).exceptAll(whole).count() == 0 and \
        found.filter(F.lower("product_name").contains("red")).count() == whole.count()
