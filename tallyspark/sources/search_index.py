"""Substring search over a large stored table: which files can hold a match.

The index has a row per three folded letters and data file that holds them in
the indexed column, sorted by the letters. A search term's literal stretches
(between ``%`` and ``_``) give the letters that every match must hold, so only
files that hold all of them are read; the search itself is then the operators'
own exact filter. Files written since the index was built are always read, so
an old index costs time and never a row.
"""

from __future__ import annotations

import os
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.text import _fold_text, fold_accents, is_blank_php, like_pattern, php_trim_text
from tallyspark.sources.tables import conform, read_table

GRAM = 3


def _folder(root: str, table: str, column: str) -> str:
    return os.path.join(root, "_search", f"{table}_{column}")


def build_search_index(spark: SparkSession, root: str, table: str, column: str) -> str:
    """Index ``column`` of a stored table; returns the index's folder.

    A file's letters are made distinct in its tasks before they are shuffled.
    Files without a name of three letters are listed too (with null letters),
    so that they are known to hold no match."""
    name = fold_accents(column)
    grams = F.when(F.length(name) >= GRAM, F.transform(F.sequence(F.lit(1), F.length(name) - (GRAM - 1)),
                                                      lambda i: F.substr(name, i, F.lit(GRAM))))
    pairs = spark.read.parquet(os.path.join(root, table)).select(
        F.input_file_name().alias("file"), F.explode_outer(F.array_distinct(grams)).alias("gram")).distinct()
    path = _folder(root, table, column)
    pairs.repartitionByRange("gram", "file").sortWithinPartitions("gram", "file").write.mode("overwrite").parquet(path)
    return path


def term_grams(term: str | None, trim: bool = True) -> set[str]:
    """The folded letters that every match of a search term holds."""
    if term is None:
        return set()
    if trim:
        term = php_trim_text(term)
    if is_blank_php(term):
        return set()
    # Escaped characters are literal; unescaped % and _ end a stretch.
    marked = re.sub(r"\\(.)|([%_])", lambda m: m[1] if m[2] is None else "\0", like_pattern(_fold_text(term)), flags=re.S)
    return {s[i:i + GRAM] for s in marked.split("\0") for i in range(len(s) - GRAM + 1)}


def candidate_files(spark: SparkSession, root: str, table: str, column: str, term: str | None, trim: bool = True) -> list[str]:
    """Files of the stored table that may hold a match. The list of files
    reaches the driver, as it does for any scan."""
    now = set(spark.read.parquet(os.path.join(root, table)).inputFiles())
    grams = term_grams(term, trim)
    if not grams:
        return sorted(now)
    try:
        index = spark.read.parquet(_folder(root, table, column))
    except AnalysisException:
        return sorted(now)
    known = {r.file for r in index.select("file").distinct().collect()}
    hits = index.filter(F.col("gram").isin(sorted(grams))).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    found = {r.file for r in hits.filter(F.col("n") == len(grams)).collect()}
    return sorted((now & found) | (now - known))


def read_candidates(spark: SparkSession, root: str, table: str, column: str, term: str | None, trim: bool = True) -> DataFrame:
    """The stored table's rows in the files that may hold a match, for a
    search by the same term."""
    paths = candidate_files(spark, root, table, column, term, trim)
    if not paths:
        return read_table(spark, root, table).filter(F.lit(False))
    return conform(spark.read.option("basePath", os.path.join(root, table)).parquet(*paths), table, stored=True)
