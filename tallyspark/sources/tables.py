"""The seven back-office tables as DataFrames.

Tables are stored as Parquet with explicit schemas (no inference). ``sales``
is written partitioned by ``sale_month`` (first day of the sale's month) and
sorted by time inside each file: a period filter prunes whole month folders
before any file is opened, and the range predicate on ``created_at`` is
pushed into the remaining files, where row-group statistics skip the other
days. Month folders keep the folder count low for long histories at small
scale and stay a reasonable unit (many files each) at large scale. Any other source (for
example ``spark.read.jdbc`` on the live database) can be passed through
``conform`` and used with every operator.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark import schemas as S

SALE_MONTH = "sale_month"  # partition column of stored sales (first day of month)


def canonical_status(col: str | Column = "status") -> Column:
    """Canonical spelling of a sale status.

    The source database compares text case-insensitively, so ``completed``
    and ``Completed`` are the same status there. ``conform`` makes statuses
    canonical for every source; stored tables hold them so, and every later
    filter on them is a plain equality that pushes into Parquet.
    """
    return _canonical(col, (S.STATUS_COMPLETED, S.STATUS_CANCELLED, S.STATUS_VOID))


def _canonical(col: str | Column, spellings) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    out = F.when(F.lit(False), c)
    for word in spellings:
        out = out.when(F.lower(c) == word.lower(), F.lit(word))
    return out.otherwise(c)


STATUSES = {
    "sales": (S.STATUS_COMPLETED, S.STATUS_CANCELLED, S.STATUS_VOID),
    "products": (S.AVAILABLE, S.UNAVAILABLE),
    "addons": (S.AVAILABLE, S.UNAVAILABLE),
}


def conform(df: DataFrame, table: str, stored: bool = False) -> DataFrame:
    """Select the table's columns in schema order, casting where types differ,
    with statuses in their canonical spelling (``stored``: they are already).

    Timestamp columns keep their flavour (``timestamp_ntz`` from Parquet,
    ``timestamp`` from JDBC); operators build literals of the matching type.
    """
    schema = S.TABLES[table]
    have = dict(df.dtypes)
    cols = []
    for fld in schema.fields:
        want = fld.dataType
        if fld.name == "status" and table in STATUSES and not stored:
            cols.append(_canonical(F.col("status").cast(want), STATUSES[table]).alias("status"))
        elif isinstance(want, T.TimestampNTZType) and have.get(fld.name) in ("timestamp", "timestamp_ntz"):
            cols.append(F.col(fld.name))
        elif have.get(fld.name) == want.simpleString():
            cols.append(F.col(fld.name))
        else:
            cols.append(F.col(fld.name).cast(want).alias(fld.name))
    if table == "sales" and SALE_MONTH in have:
        # Keep the partition column: period filters add a predicate on it so
        # that whole date folders are pruned. (Where no sale has a time, the
        # folders alone don't tell its type.)
        cols.append(F.col(SALE_MONTH) if have[SALE_MONTH] == "date" else F.col(SALE_MONTH).cast("date").alias(SALE_MONTH))
    return df.select(*cols)


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Read one stored table (sales keep their ``sale_month`` partition column)."""
    path = os.path.join(root, table)
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        # The folder is there and holds no file: all months were dropped.
        month = [T.StructField(SALE_MONTH, T.DateType())] if table == "sales" else []
        df = spark.read.schema(T.StructType([*S.TABLES[table].fields, *month])).parquet(path)
    return conform(df, table, stored=True)


@dataclass
class ShopTables:
    """The seven tables an operator may read. Unused ones are never scanned."""

    sales: DataFrame | None = None
    products: DataFrame | None = None
    addons: DataFrame | None = None
    sale_addons: DataFrame | None = None
    sales_void: DataFrame | None = None
    ingredients: DataFrame | None = None
    audit_logs: DataFrame | None = None
    extra: dict = field(default_factory=dict)

    def as_dict(self) -> dict[str, DataFrame]:
        return {k: getattr(self, k) for k in S.TABLES if getattr(self, k) is not None}


def read_tables(spark: SparkSession, root: str) -> ShopTables:
    """Lazily read every stored table under ``root`` (one folder per table);
    tables that are not there are left out. Works on any file system Spark
    reads (the check is Spark's own path resolution, not the local disk)."""
    found = {}
    for name in S.TABLES:
        try:
            found[name] = read_table(spark, root, name)
        except AnalysisException:
            continue
    return ShopTables(**found)


# Key each stored table is clustered by: child tables by their parent's id,
# so lookups and semi-joins by that id skip row groups by min/max statistics.
CLUSTER_KEYS = {
    "sales": (SALE_MONTH, "created_at", "sales_id"),
    "products": ("product_id",),
    "addons": ("addon_id",),
    "sale_addons": ("sale_id", "addon_id"),
    "sales_void": ("sale_id", "void_id"),
    "ingredients": ("ingredient_id",),
    "audit_logs": ("created_at", "log_id"),
}


def write_table(df: DataFrame, root: str, table: str, mode: str = "overwrite",
                files: int | None = None) -> str:
    """Write a table in its stored layout.

    Rows are range-partitioned on the table's cluster key into ``files``
    tasks (default ``spark.sql.shuffle.partitions``) and sorted inside each
    file. Range partitioning samples the key, so a very busy month, day or
    parent id is split over several tasks instead of landing in one.

    Sales also get a ``sale_month`` column and are written partitioned by it:
    each task writes one or a few month folders, and rows are sorted by time
    inside each file, so row-group statistics on ``created_at`` skip data
    within a month.
    """
    spark = df.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = os.path.join(root, table)
    out = conform(df, table)
    if table == "sales":
        if SALE_MONTH not in out.columns:
            out = out.withColumn(SALE_MONTH, F.trunc(F.to_date("created_at"), "month"))
    keys = CLUSTER_KEYS[table]
    out = out.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    writer = out.write.mode(mode)
    if table == "sales":
        writer = writer.partitionBy(SALE_MONTH)
    writer.parquet(path)
    return path


# Ids that are looked up as literals; more are looked up by their range.
NAMED_IDS = 1000


def rows_named(df: DataFrame, key: str, ids: DataFrame, most: int = NAMED_IDS) -> DataFrame:
    """The rows of ``df`` whose ``key`` can be among the first column of
    ``ids``: a superset, to be joined, read without most of the table.

    Up to ``most`` ids become literals: a bucketed table is read in their
    buckets only, and Parquet skips row groups without them. More are narrowed
    to the range from the smallest to the largest."""
    wanted = ids.select(F.col(ids.columns[0]).alias("id")).filter(F.col("id").isNotNull())
    few = [r.id for r in wanted.distinct().limit(most + 1).collect()]
    if len(few) <= most:
        return df.filter(F.col(key).isin(sorted(few)) if few else F.lit(False))
    ends = wanted.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    return df.filter(F.col(key).between(F.lit(ends.lo), F.lit(ends.hi)))


# Bucketed layout: tables joined on the sale id, bucketed by it with the same
# bucket count, join and aggregate by that id without any shuffle.
BUCKET_KEYS = {"sales": "sales_id", "sale_addons": "sale_id", "sales_void": "sale_id"}


def save_bucketed(df: DataFrame, table: str, name: str, path: str, buckets: int,
                  mode: str = "overwrite") -> str:
    """Save ``table`` as catalogue table ``name`` at ``path``, bucketed (and
    sorted) by its sale id into ``buckets`` buckets; sales stay partitioned
    by month as well. Use one bucket count for every table joined together."""
    out = conform(df, table)
    if table == "sales":
        if SALE_MONTH not in out.columns:
            out = out.withColumn(SALE_MONTH, F.trunc(F.to_date("created_at"), "month"))
    key = BUCKET_KEYS[table]
    w = out.write.mode(mode).format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path)
    if table == "sales":
        w = w.partitionBy(SALE_MONTH)
    w.saveAsTable(name)
    return name


def read_bucketed(spark: SparkSession, name: str, table: str) -> DataFrame:
    """A bucketed table through the catalogue (which carries the bucketing)."""
    return conform(spark.table(name), table, stored=True)


def attach_bucketed(spark: SparkSession, name: str, path: str, table: str, buckets: int) -> DataFrame:
    """Register bucketed files written by ``save_bucketed`` (possibly by
    another session) as catalogue table ``name`` with the same bucketing, so
    a session without a shared metastore still joins them without a shuffle.
    """
    schema = S.TABLES[table]
    cols = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields]
    key = BUCKET_KEYS[table]
    part = ""
    if table == "sales":
        cols.append(f"`{SALE_MONTH}` date")
        part = f"PARTITIONED BY (`{SALE_MONTH}`) "
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?", name):
        raise ValueError(f"not a table name: {name!r}")
    if "'" in path or "\\" in path:
        raise ValueError(f"quotes and backslashes can't be in the path: {path!r}")
    if spark.catalog.tableExists(name):
        # Only the entry of an external table may go; its files stay.
        if spark.catalog.getTable(name).tableType != "EXTERNAL":
            raise ValueError(f"{name} is a managed table; its data would be deleted")
        spark.sql(f"DROP TABLE {name}")
    spark.sql(f"CREATE TABLE {name} ({', '.join(cols)}) USING parquet {part}"
              f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS "
              f"LOCATION '{path}'")
    if part:
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return read_bucketed(spark, name, table)
