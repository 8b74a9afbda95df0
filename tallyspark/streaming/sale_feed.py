"""Sale entry as a stream.

The source prices and stores each sale when its form is posted. Here new
request files are read as a stream; each micro-batch is priced by the same
``price_sales`` operator and written with its add-on rows and rejects as batch
``<epoch id>`` (``plans.jobs``). An epoch that runs again after a failure
replaces its own partition, so delivery is effectively once. The stream's own
checkpoint goes next to the outputs (a hidden ``_stream_checkpoint`` folder)
unless a location is given.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tallyspark import schemas as S
from tallyspark.plans import jobs
from tallyspark.sources.tables import ShopTables


def read_requests(spark: SparkSession, requests_dir: str, max_files: int | None = None) -> DataFrame:
    """Stream of sale requests from Parquet files dropped into a folder."""
    r = spark.readStream.schema(S.SALE_REQUESTS)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(requests_dir)


def start_sale_feed(spark: SparkSession, requests: DataFrame, tables: ShopTables, root: str,
                    checkpoint: str | None = None, available_now: bool = False, name: str | None = None):
    """Start the stream; returns the ``StreamingQuery``."""
    # Default: next to the committed batches, so it is as shared as they are
    # and stays the same across restarts of this feed (and differs per feed).
    checkpoint = checkpoint or os.path.join(root, "_stream_checkpoint")

    def handle(batch: DataFrame, epoch_id: int) -> None:
        jobs.run_sale_batch(tables, batch, root, epoch_id)

    w = requests.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if name:
        w = w.queryName(name)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
