"""Per-stage task statistics of one operator run, from Spark's event log.

    python tools/stage_report.py [scenario] [sf_dir]

Scenarios: ``hot_product_list`` (sales list where one product holds ~40% of
the sales, broadcast off so the product join is a sort-merge join),
``hot_product_list_no_split`` (the same with AQE skew splitting switched
off, for contrast), ``sales_list`` (no hot product) and
``bucketed_sales_list`` (sales and add-on rows stored bucketed by sale id;
only the list job's stages are reported). The event log goes to a
fresh scratch folder; the report prints, per stage: tasks, median and max
task time, and shuffle bytes read/written. A max far above the median marks
a straggler (a hot key landing in one task).
"""

from __future__ import annotations

import glob
import io
import json
import os
import statistics
import sys
import tempfile

import zstandard

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)


def _event_lines(path: str) -> list[str]:
    if path.endswith(".zstd"):
        with open(path, "rb") as raw:
            text = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw), encoding="utf-8")
            return text.read().splitlines()
    with open(path) as f:
        return f.read().splitlines()


def summarize(log_dir: str, job_group: str | None = None) -> list[dict]:
    """Per-stage task statistics; only stages of jobs in ``job_group`` when given."""
    # Spark 4 writes rolling event logs: a folder of "events_*" files.
    files = [p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)
             if os.path.isfile(p) and not os.path.basename(p).startswith((".", "appstatus"))]
    stages: dict[int, dict] = {}
    wanted: set[int] = set()
    for path in files:
        for line in _event_lines(path):
            if not line.strip():
                continue
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerJobStart":
                if (ev.get("Properties") or {}).get("spark.jobGroup.id") == job_group:
                    wanted |= set(ev.get("Stage IDs", []))
                continue
            if kind != "SparkListenerTaskEnd":
                continue
            sid = ev["Stage ID"]
            info, metrics = ev["Task Info"], ev.get("Task Metrics") or {}
            st = stages.setdefault(sid, {"times": [], "read": 0, "write": 0})
            st["times"].append(info["Finish Time"] - info["Launch Time"])
            sr = metrics.get("Shuffle Read Metrics") or {}
            sw = metrics.get("Shuffle Write Metrics") or {}
            st["read"] += sr.get("Remote Bytes Read", 0) + sr.get("Local Bytes Read", 0)
            st["write"] += sw.get("Shuffle Bytes Written", 0)
    out = []
    for sid in sorted(stages):
        if job_group is not None and sid not in wanted:
            continue
        st = stages[sid]
        out.append({"stage": sid, "tasks": len(st["times"]),
                    "median_ms": statistics.median(st["times"]), "max_ms": max(st["times"]),
                    "shuffle_read_kb": st["read"] // 1024, "shuffle_write_kb": st["write"] // 1024})
    return out


def main(argv):
    scenario = argv[1] if len(argv) > 1 else "hot_product_list"
    sf_dir = argv[2] if len(argv) > 2 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="tallyspark-eventlog-", dir=os.environ.get("TMPDIR", "/tmp"))
    from pyspark.sql import functions as F
    from tallyspark.session import local_session
    from tallyspark.operators import sales_views
    from tallyspark.sources import driver_tables as D
    extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
             "spark.sql.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256k",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m"}
    if scenario == "hot_product_list_no_split":
        extra["spark.sql.adaptive.skewJoin.enabled"] = "false"
    spark = local_session(8, shuffle_partitions=32, app_name=f"stage-report-{scenario}", extra=extra)
    sales = D.sales_b(spark, sf_dir)
    if scenario.startswith("hot_product_list"):
        hot = F.col("status").isin("Completed", "Pending") & (F.col("sales_id") % 3 != 0)
        sales = sales.withColumn("product_id", F.when(hot, F.lit(7)).otherwise(F.col("product_id")))
    addons = D.sale_addons(spark, sf_dir)
    if scenario == "bucketed_sales_list":
        # Sales and add-on rows stored bucketed by sale id (same count): the
        # nesting and the sale-id join read them without any shuffle.
        from tallyspark.sources.tables import read_bucketed, save_bucketed
        scratch = tempfile.mkdtemp(prefix="tallyspark-bucketed-", dir=os.environ.get("TMPDIR", "/tmp"))
        save_bucketed(sales, "sales", "stage_sales", os.path.join(scratch, "sales"), 32)
        save_bucketed(addons, "sale_addons", "stage_addons", os.path.join(scratch, "addons"), 32)
        sales = read_bucketed(spark, "stage_sales", "sales")
        addons = read_bucketed(spark, "stage_addons", "sale_addons")
    df = sales_views.sales_list(sales, D.products(spark, sf_dir), addons)
    spark.sparkContext.setJobGroup("report", "the measured job")
    df.write.format("noop").mode("overwrite").save()
    spark.stop()
    rows = summarize(log_dir, "report")
    print(f"scenario={scenario} sf_dir={sf_dir}")
    print("| stage | tasks | median ms | max ms | shuffle read KiB | shuffle write KiB |")
    print("| --- | --- | --- | --- | --- | --- |")
    for r in rows:
        print(f"| {r['stage']} | {r['tasks']} | {r['median_ms']} | {r['max_ms']} | "
              f"{r['shuffle_read_kb']} | {r['shuffle_write_kb']} |")


if __name__ == "__main__":
    main(sys.argv)
