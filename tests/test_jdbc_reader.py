"""The JDBC reader's request shape, checked without a database: a stand-in
``read.jdbc`` records its arguments and answers with small DataFrames."""
from decimal import Decimal

from tallyspark import schemas as S
from tallyspark.sources import jdbc


class _Reader:
    def __init__(self, spark, calls):
        self.spark, self.calls = spark, calls

    def jdbc(self, url, table, column=None, lowerBound=None, upperBound=None,
             numPartitions=None, properties=None):
        self.calls.append(dict(url=url, table=table, column=column, lower=lowerBound,
                               upper=upperBound, parts=numPartitions, props=dict(properties or {})))
        if table.startswith("(SELECT MIN("):
            return self.spark.createDataFrame([(3, 41)], "lo long, hi long")
        # MySQL-like types: int keys, decimal(10,2) money.
        return self.spark.createDataFrame(
            [(3, "Latte", "Hot Coffee", Decimal("75.00"), "Available", None)],
            "product_id int, product_name string, category string, price decimal(10,2), "
            "status string, image string")


class _Session:
    def __init__(self, spark, calls):
        self.read = _Reader(spark, calls)


def test_partitioned_read_and_conformed_schema(spark):
    calls = []
    df = jdbc.read_jdbc_table(_Session(spark, calls), "jdbc:mysql://db/shop", "products",
                              {"user": "u", "password": "p"}, num_partitions=8)
    bounds, read = calls
    assert "MIN(product_id)" in bounds["table"] and "MAX(product_id)" in bounds["table"]
    assert read["table"] == "products" and read["column"] == "product_id"
    assert (read["lower"], read["upper"], read["parts"]) == (3, 42, 8)
    assert read["props"]["fetchsize"] == "10000" and read["props"]["user"] == "u"
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in S.PRODUCTS]
