"""Daily totals and alarms over a stream of heartbeat lines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vacantia import fixed_values as V
from vacantia.operators import metrics


def stream_daily_summary(
    lines: DataFrame,
    cost_per_score: float,
    marker: str = metrics.DEFAULT_MARKER,
    lateness: str = "1 hour",
) -> DataFrame:
    """Day totals, final once the watermark has passed the day; later lines are dropped."""
    parsed = metrics.parse_heartbeat(lines.withWatermark("ts", lateness), marker)
    return metrics.summarize_by_day(parsed, cost_per_score)


def stream_alarms(
    lines: DataFrame, seconds: int = V.ALARM_PERIOD_SECONDS, lateness: str = "10 minutes"
) -> DataFrame:
    """Unhealthy heartbeats per period, updated as lines arrive."""
    return metrics.alarm_unhealthy(lines.withWatermark("ts", lateness), seconds)


def clock(spark: SparkSession) -> DataFrame:
    """A ``ts`` per second. After a restart the seconds of the pause are made up for."""
    return spark.readStream.format("rate").load().select(F.col("timestamp").alias("ts"))


def stream_no_runs(
    runs: DataFrame,
    ticks: DataFrame,
    start: dt.datetime | Column,
    seconds: int = V.NO_RUN_WINDOW_SECONDS,
    lateness: str = "10 minutes",
) -> DataFrame:
    """Runs of every finished period that begins from ``start`` on; one without any is an alarm.

    Silence makes no rows, so ``ticks`` of a clock (``ts``, at least one in a period) are counted as
    nothing beside the runs: they give each period its row, and they move the watermark on when no
    run comes. A run that lands more than ``lateness`` behind the clock counts for nothing.
    """
    first = (start if isinstance(start, Column) else F.lit(start)).cast("timestamp")
    both = runs.select("ts", F.lit(1).alias("run")).unionByName(
        ticks.select("ts", F.lit(0).alias("run"))
    )
    return (
        both.withWatermark("ts", lateness)
        .groupBy(F.window("ts", f"{seconds} seconds").alias("w"))
        .agg(F.sum("run").alias("runs"))
        .select(
            F.col("w.start").alias("period_start"),
            F.col("w.end").alias("period_end"),
            "runs",
            (F.col("runs") < 1).alias("alarm"),
        )
        .where(F.col("period_start") >= first)
    )


def write_stream(
    table: DataFrame, path: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Append finished windows to Parquet files."""
    writer = (
        table.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()


def write_updates(
    table: DataFrame, path: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Write the windows each micro-batch changed; a reader takes the last batch of a window."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = (
        table.writeStream.outputMode("update")
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
    )
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()
