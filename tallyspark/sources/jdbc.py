"""Reading the live application database over JDBC.

Each table is read with Spark's partitioned JDBC scan on its integer primary
key: the key range is split into ``num_partitions`` strides, each read by its
own task, so no single connection pulls a whole table. Filters that Spark can
translate (comparisons on plain columns, such as the period ranges built by
``tallyspark.periods``) are pushed into the database's WHERE clause.
Timestamps arrive as session-zone ``timestamp``; operators accept them as is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.sources.tables import ShopTables, conform

PRIMARY_KEYS = {
    "sales": "sales_id",
    "products": "product_id",
    "addons": "addon_id",
    "sale_addons": "id",
    "sales_void": "void_id",
    "ingredients": "ingredient_id",
    "audit_logs": "log_id",
}


def key_bounds(spark: SparkSession, url: str, table: str, key: str, properties: dict) -> tuple[int, int]:
    """Smallest and largest key (one row from the database)."""
    q = f"(SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {table}) AS bounds"
    row = spark.read.jdbc(url, q, properties=properties).first()
    lo, hi = row["lo"], row["hi"]
    return (0, 0) if lo is None else (int(lo), int(hi))


def read_jdbc_table(spark: SparkSession, url: str, table: str, properties: dict,
                    num_partitions: int = 64, fetch_size: int = 10000) -> DataFrame:
    key = PRIMARY_KEYS[table]
    lo, hi = key_bounds(spark, url, table, key, properties)
    props = {**properties, "fetchsize": str(fetch_size)}
    df = spark.read.jdbc(url, table, column=key, lowerBound=lo, upperBound=hi + 1,
                         numPartitions=max(1, num_partitions), properties=props)
    return conform(df, table)


def read_jdbc_tables(spark: SparkSession, url: str, properties: dict,
                     num_partitions: dict[str, int] | None = None) -> ShopTables:
    """All seven tables (e.g. ``jdbc:mysql://host/db`` with user/password and
    driver in ``properties``)."""
    parts = num_partitions or {}
    return ShopTables(**{t: read_jdbc_table(spark, url, t, properties, parts.get(t, 64))
                         for t in PRIMARY_KEYS})
