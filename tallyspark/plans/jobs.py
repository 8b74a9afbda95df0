"""Batch jobs: the change operators' outputs as plain Parquet tables.

A batch of an output is a folder ``<root>/<output>/batch=<n>``. It is written
aside by Spark's own writer and put in its place when it is complete, so a
batch that runs again replaces what it wrote before, rows that are gone
included, and a retry that fails leaves what was there. Sales, their add-on
rows and the rejects of a sale batch are one frame, written in one pass and
put in place together. ``plans.stored`` applies changes to the stored tables.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import changes as CH
from tallyspark.sources import files
from tallyspark.sources.tables import ShopTables, rows_named

BATCH = "batch"
# The folder of the frame that holds all outputs of a sale batch.
SALE_BATCHES = "sale_batches"


def write_batch(df: DataFrame, root: str, output: str, batch: int, by: str | None = None) -> str:
    """Write one output of one batch, in folders by the column ``by`` if one is
    given; returns the output's folder. Without rows the batch is empty."""
    spark, path = df.sparkSession, os.path.join(root, output)
    aside = os.path.join(path, f"_writing-{int(batch)}")
    out = df.write.mode("overwrite")
    (out.partitionBy(by) if by else out).parquet(aside)
    files.replace(spark, aside, os.path.join(path, f"{BATCH}={int(batch)}"))
    return path


def read_batches(spark: SparkSession, root: str, output: str) -> DataFrame:
    """All batches of an output, with their ``batch`` number."""
    if output in CH.SALE_OUTPUTS:
        # Outputs without a row have no folder: the schema is given.
        kinds = CH.sale_schema().add("output", "string").add(BATCH, "long")
        found = spark.read.schema(kinds).parquet(os.path.join(root, SALE_BATCHES))
        return found.filter(F.col("output") == F.lit(output)).select(*CH.SALE_OUTPUTS[output], BATCH)
    return spark.read.parquet(os.path.join(root, output))


def run_sale_batch(tables: ShopTables, requests: DataFrame, root: str, batch: int, default_time=None) -> None:
    """Price a batch of sale requests: ``new_sales``, ``new_sale_addons`` and
    ``sale_rejects``, from one pass over the requests. Sale ids are the request
    ids, so a request delivered again in the same batch is one sale; a sale
    and its add-on rows can be read from the same moment on."""
    outcomes = CH.sale_outcomes(requests, tables.products, tables.addons, default_time)
    write_batch(outcomes, root, SALE_BATCHES, batch, by="output")


def run_status_batch(tables: ShopTables, cancel_ids: DataFrame, voids: DataFrame, root: str, batch: int) -> None:
    """Cancels and voids of a batch: ``status_flags`` (one row per named sale,
    for one join with the sales), the new ``void_log`` rows, ``void_rejects``.
    Whether a voided sale exists is asked of the buckets and row groups that can
    hold its id."""
    applied, rejects = CH.split_voids(rows_named(tables.sales, "sales_id", voids.select("sale_id")), voids)
    write_batch(CH.status_flags(cancel_ids, voids), root, "status_flags", batch)
    write_batch(CH.void_log(applied), root, "void_log", batch)
    write_batch(rejects, root, "void_rejects", batch)


def run_catalog_batch(products: DataFrame, product_changes: DataFrame, root: str, batch: int) -> None:
    """Product inserts and updates of a batch: the whole ``products`` table
    after it, and ``product_rejects``."""
    done = CH.upsert_products(products, product_changes)
    write_batch(done.table, root, "products", batch)
    write_batch(done.rejects, root, "product_rejects", batch)
