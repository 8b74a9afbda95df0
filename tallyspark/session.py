"""Session helpers.

The library never creates folders on a machine-local disk when running on a
cluster: lineage, where it is cut, is cut by files in the shared folder named
by ``spark.checkpoint.dir``. Only tests and local runs (where that setting is
unset) get a scratch folder of their own.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: a pinned session time zone (report dates are
# calendar dates in one zone), adaptive execution for runtime join selection,
# partition coalescing and skew splitting.
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ui.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Size estimates of Parquet scans are file sizes; decompressed rows are
    # several times larger. Scaling the estimate keeps the planner from
    # broadcasting a side that only looks small on disk; AQE still broadcasts
    # it at run time when its measured size is under the threshold.
    "spark.sql.sources.fileCompressionFactor": "8",
    # Checkpoint files are removed once their DataFrame is no longer referenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "tallyspark", extra: dict | None = None) -> SparkSession:
    """A local session for tests and benchmarks (never used on a cluster)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app_name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "16g"))
    # Catalogue tables created in local runs (bucketed layout) live in a
    # scratch warehouse, not in the working directory.
    builder = builder.config("spark.sql.warehouse.dir", tempfile.mkdtemp(
        prefix="tallyspark-wh-", dir=os.environ.get("TMPDIR", "/tmp")))
    for k, v in {**CORE_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, as named by ``spark.checkpoint.dir``.

    On a cluster that setting names a shared folder and is used as is. Only
    when it is missing (a session built elsewhere for a local run) is a fresh
    scratch folder taken.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server's own setting applies
        return spark.conf.get("spark.checkpoint.dir", None)
    active = sc.getCheckpointDir()
    if active:
        return active  # already in use (each set would add a new subfolder)
    current = sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local"):
            # A machine-local folder is not reachable from other executors.
            raise RuntimeError("set spark.checkpoint.dir to a shared folder on a cluster")
        current = tempfile.mkdtemp(prefix="tallyspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def cluster_settings(advisory_partition_mb: int = 256, initial_shuffle_partitions: int = 8192) -> dict:
    """Settings suggested for large clusters (tens of TB per query).

    AQE coalesces the many initial shuffle partitions down to the advisory
    size and splits skewed ones; scans read ~256 MB splits. Pass these to
    ``SparkSession.builder.config`` together with ``CORE_CONF``.
    """
    mb = advisory_partition_mb * 1024 * 1024
    return {
        **CORE_CONF,
        "spark.sql.shuffle.partitions": str(initial_shuffle_partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(mb),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * mb),
        "spark.sql.files.maxPartitionBytes": str(mb),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    }
