"""Folders of stored tables, through the file system that Spark itself uses
for a path (any that Hadoop knows)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``; none if there is no such path."""
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory())


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder; nothing happens where there is none."""
    fs, where = _at(spark, path)
    fs.delete(where, True)


def replace(spark: SparkSession, new: str, path: str) -> None:
    """Put the folder ``new`` in the place of ``path``."""
    fs, where = _at(spark, path)
    fs.delete(where, True)
    fs.mkdirs(where.getParent())
    if not fs.rename(_at(spark, new)[1], where):
        raise OSError(f"can't move {new} to {path}")
