"""Day-level sales KPIs maintained from a stream of sales and their changes.

One event-time window per calendar day on ``created_at``. The state is one row
per day, so it is kept: a late sale still reaches its day, however late. Status
changes and removals enter as signed effects (``change_effects``), so the
Completed figures follow cancels, voids and resets. Each micro-batch writes
the days it changed (update mode) as its own batch folder; ``read_daily_totals``
keeps the latest row per day. A ``watermark`` may be set to bound the state
where sales older than that are known not to come; such sales are then lost.
"""

from __future__ import annotations

import os
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import periods as P
from tallyspark import schemas as S


def _wall_clock_as_utc(col: str) -> F.Column:
    """A ``timestamp`` (instant) whose UTC reading equals the wall-clock
    value of a ``timestamp_ntz``/``timestamp`` column in any session zone, so
    day windows (aligned to UTC midnight) are the wall-clock days."""
    c = F.col(col)
    return F.make_timestamp(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c),
                            F.date_part(F.lit("SECOND"), c), F.lit("UTC"))


EFFECT = ["created_at", "total", "status", "sign"]


def sale_effects(sales: DataFrame) -> DataFrame:
    """New sales as effects: each counts once."""
    return sales.select("created_at", "total", "status", F.lit(1).alias("sign"))


def change_effects(changes: DataFrame) -> DataFrame:
    """``changes(created_at, total, old_status, new_status)`` of known sales as
    effects: the sale leaves its old status and enters the new one; without a
    new status it is removed."""
    pair = F.array(F.struct(F.col("old_status").alias("status"), F.lit(-1).alias("sign")),
                   F.struct(F.col("new_status").alias("status"), F.lit(1).alias("sign")))
    sides = F.filter(pair, lambda x: (x["sign"] < 0) | x["status"].isNotNull())
    return changes.select("created_at", "total", F.explode(sides).alias("e")).select("created_at", "total", "e.status", "e.sign")


def daily_windows(effects: DataFrame, watermark: str | None = None) -> DataFrame:
    """Streaming (or batch) aggregate: one row per sale day, from effects or
    plain sales (each an effect of +1).

    Windows need an instant (``timestamp``); the wall-clock sale time is read
    as UTC for that, independent of the session zone, and the output day is
    taken from the rows' own dates.
    """
    if "sign" not in effects.columns:
        effects = sale_effects(effects)
    done = F.col("status") == F.lit(S.STATUS_COMPLETED)
    amount = F.col("total") * F.col("sign").cast("decimal(3,0)")
    zero = F.lit(0).cast(S.MONEY)
    timed = (effects.filter(F.col("created_at").isNotNull())      # no time, no day
             .withColumn("_event_time", _wall_clock_as_utc("created_at")))
    if watermark is not None:
        timed = timed.withWatermark("_event_time", watermark)
    return (timed.groupBy(F.window("_event_time", "1 day").alias("w"))
            .agg(F.min(F.to_date("created_at")).alias("day"),
                 F.coalesce(F.sum(amount), zero).alias("total"),
                 F.coalesce(F.sum("sign"), F.lit(0)).cast("long").alias("orders"),
                 F.coalesce(F.sum(F.when(done, amount)), zero).alias("completed_total"),
                 F.coalesce(F.sum(F.when(done, F.col("sign"))), F.lit(0)).cast("long").alias("completed_orders"))
            .select("day", "total", "orders", "completed_total", "completed_orders"))


def start_daily_totals(spark: SparkSession, effects_stream: DataFrame, out_dir: str,
                       checkpoint: str | None = None, watermark: str | None = None,
                       available_now: bool = False):
    # Default: a hidden folder inside the output (Spark's readers skip names
    # starting with "_"), stable across restarts and unique per output.
    checkpoint = checkpoint or os.path.join(out_dir, "_checkpoint")

    def handle(batch: DataFrame, epoch_id: int) -> None:
        (batch.withColumn("epoch", F.lit(epoch_id).cast("long"))
         .write.mode("overwrite").parquet(os.path.join(out_dir, f"epoch={epoch_id:012d}")))

    w = (daily_windows(effects_stream, watermark).writeStream.outputMode("update")
         .foreachBatch(handle).option("checkpointLocation", checkpoint))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def read_daily_totals(spark: SparkSession, out_dir: str) -> DataFrame:
    """Latest figures per day across the written micro-batches."""
    df = spark.read.parquet(out_dir)
    latest = F.max_by(F.struct("total", "orders", "completed_total", "completed_orders"), "epoch")
    return df.groupBy("day").agg(latest.alias("v")).select("day", "v.*")


def dashboard_from_days(days: DataFrame, as_of, growth: str = S.FORECAST_GROWTH) -> DataFrame:
    """The dashboard strip (daily, weekly = trailing 7 days, monthly, today's
    orders, forecast) from the day table kept by the stream: a few dozen day
    rows are summed instead of scanning the sales table."""
    def day_range(period):
        lo, hi = P.period_range(period, as_of)
        return (F.col("day") >= F.lit(lo.date())) & (F.col("day") < F.lit(hi.date()))

    lo, hi = P.covering_range([P.DAILY, P.TRAILING7, P.MONTHLY], as_of)
    scoped = days.filter((F.col("day") >= F.lit(lo.date())) & (F.col("day") < F.lit(hi.date())))
    zero = F.lit(0).cast(S.MONEY)
    strip = scoped.agg(
        F.coalesce(F.sum(F.when(day_range(P.DAILY), F.col("total"))), zero).alias("daily"),
        F.coalesce(F.sum(F.when(day_range(P.TRAILING7), F.col("total"))), zero).alias("weekly"),
        F.coalesce(F.sum(F.when(day_range(P.MONTHLY), F.col("total"))), zero).alias("monthly"),
        F.coalesce(F.sum(F.when(day_range(P.DAILY), F.col("orders"))), F.lit(0)).cast("long").alias("today_orders"),
    )
    return strip.withColumn("forecast", F.col("monthly") * F.lit(Decimal(growth)))
