"""Audit trail: appending entries (with the log reset) and the latest entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark import schemas as S
from tallyspark.sources.tables import conform


def resets(entries: DataFrame) -> DataFrame:
    """The entries that empty the log."""
    return entries.filter(F.col("action") == F.lit(S.RESET_LOGS_ACTION))


def append_audit(logs: DataFrame, entries: DataFrame) -> DataFrame:
    """The log after appending ``entries`` in ``log_id`` order.

    A "Reset Logs" entry empties the log and is then logged itself, so the
    result keeps only the last reset entry and what follows it; with no reset
    in the batch, the old log and all entries are kept. The position of the
    last reset is one scalar (a scalar subquery), not a join.
    """
    entries = conform(entries, "audit_logs")
    last_reset = resets(entries).select(F.max("log_id")).scalar()
    kept_old = conform(logs, "audit_logs").filter(last_reset.isNull())
    kept_new = entries.filter(last_reset.isNull() | (F.col("log_id") >= last_reset))
    return kept_old.unionByName(kept_new)


def recent_audit_logs(logs: DataFrame, n: int = S.RECENT_LOGS) -> DataFrame:
    """The latest ``n`` entries, newest first (ties: higher id first)."""
    return logs.orderBy(F.col("created_at").desc_nulls_last(), F.col("log_id").desc()).limit(n)
