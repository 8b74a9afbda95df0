"""Report export (O35): the period summary and its transactions as files.

The source streams a spreadsheet-styled HTML table to the browser. Here the
same two tables are written by Spark as CSV (or Parquet) folders under one
export folder named ``Report_<Label>_<date>``: ``summary/`` (always one row,
even for an empty period) and ``transactions/`` (header only when empty).
Money is rounded half-up and formatted with thousands separators, as shown.
"""

from __future__ import annotations

import datetime as dt
import os
from decimal import Decimal

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.numeric import format_money
from tallyspark.operators.kpis import report_summary
from tallyspark.operators.sales_views import report_transactions


def period_label(filter_name: str | None) -> str:
    """The file label: the filter text with its first letter upper-cased
    (the page's default filter is ``daily``)."""
    name = "daily" if filter_name is None else filter_name
    return name[:1].upper() + name[1:]


def folder_label(filter_name: str | None) -> str:
    """The label in the folder name: one of the known periods, or ``All`` (the
    filter is user text and must not become a path)."""
    label = period_label(filter_name)
    return label if label in ("Daily", "Weekly", "Monthly") else "All"


def summary_frame(figures: DataFrame, filter_name: str | None) -> DataFrame:
    """The summary's columns from (total_sales, total_transactions)."""
    return figures.select(F.lit(period_label(filter_name)).alias("period_label"), "total_sales", "total_transactions",
                          format_money("total_sales", 2).alias("total_sales_text"))


def export_frames(sales: DataFrame, as_of, filter_name: str | None = "daily") -> tuple[DataFrame, DataFrame]:
    """(summary, transactions) of the report period, ready to write."""
    summary = summary_frame(report_summary(sales, as_of, filter_name), filter_name)
    rows = report_transactions(sales, as_of, filter_name).withColumn(
        "total_text", format_money("total", 2))
    return summary, rows


def export_report(sales: DataFrame, as_of, filter_name: str | None, path: str,
                  fmt: str = "csv", generated_at: dt.datetime | None = None) -> str:
    """Write the export under ``path``; returns the export folder.

    The folder is named after the report date (the page uses the clock's
    date); ``generated_at``, when given, is stamped into the summary as the
    page's "Generated" line. The sales are read once: the summary's figures are
    observed while the transactions are written, so both say the same.
    """
    label = folder_label(filter_name)
    day = as_of if isinstance(as_of, str) else (as_of.date() if isinstance(as_of, dt.datetime) else as_of).isoformat()
    out = os.path.join(path, f"Report_{label}_{day}")
    summary, rows = export_frames(sales, as_of, filter_name)
    seen = Observation()
    rows = rows.observe(seen, F.sum("total").alias("total_sales"), F.count(F.lit(1)).alias("total_transactions"))
    # Transactions keep their sort across part files (range-partitioned).
    write = rows.write.mode("overwrite")
    if fmt == "csv":
        write.option("header", True).csv(os.path.join(out, "transactions"))
    else:
        write.parquet(os.path.join(out, "transactions"))
    figures = (seen.get["total_sales"] or Decimal(0), seen.get["total_transactions"])
    kinds = T.StructType([summary.schema["total_sales"], summary.schema["total_transactions"]])
    summary = summary_frame(sales.sparkSession.createDataFrame([figures], kinds), filter_name)
    if generated_at is not None:
        summary = summary.withColumn("generated_at", F.lit(generated_at.strftime("%Y-%m-%d %H:%M:%S")))
    if fmt == "csv":
        summary.coalesce(1).write.mode("overwrite").option("header", True).csv(os.path.join(out, "summary"))
    else:
        summary.write.mode("overwrite").parquet(os.path.join(out, "summary"))
    return out
