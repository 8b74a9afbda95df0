"""Helpers shared by the document operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyspark.session import ensure_checkpoint_dir

# Fixed by the contracts: a word is a run of other characters than these.
WORD = r"[^\x20\x09-\x0D]+"


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def on_workers(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from its folder,
    wherever the driver was started. A cluster ships the package as usual."""
    environment = spark.sparkContext.environment
    known = [x for x in environment.get("PYTHONPATH", "").split(os.pathsep) if x]
    if ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*known, ROOT])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the session's shared
    checkpoint folder and read it back. The files survive lost executors; a
    column-pruned Parquet copy is several times smaller than ``checkpoint()``.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
