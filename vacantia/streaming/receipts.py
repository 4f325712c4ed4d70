"""Delivery receipts matched to the mails of an outbox, both as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vacantia.operators.store import KeyedStore, new_run
from vacantia.session import use_utc, written
from vacantia.streaming.ingest import commit, committed_run


def match_receipts(
    outbox: DataFrame, receipts: DataFrame, patience: str = "1 day", lateness: str = "1 hour"
) -> DataFrame:
    """run_id, sent_at, job_ids, message_id of every mail; message_id is null where none came in time.

    ``outbox`` has run_id, sent_at and job_ids, one row per mail; ``receipts`` run_id, message_id and
    received_at. A receipt counts from its mail's sending until ``patience`` later. One that comes later,
    that names no mail or that lands more than ``lateness`` behind the newest row counts for nothing, and
    its mail is given up. A mail is given up when both streams have passed its last moment, so a
    stream that stands still gives up nothing. Mails wait in the state no longer than that.
    """
    sent = outbox.select("run_id", "sent_at", "job_ids").withWatermark("sent_at", lateness)
    got = (
        receipts.select(F.col("run_id").alias("r_run_id"), "message_id", "received_at")
        .withWatermark("received_at", lateness)
    )
    in_time = (
        (F.col("run_id") == F.col("r_run_id"))
        & (F.col("received_at") >= F.col("sent_at"))
        & (F.col("received_at") <= F.col("sent_at") + F.expr(f"INTERVAL {patience}"))
    )
    return sent.join(got, in_time, "left_outer").select("run_id", "sent_at", "job_ids", "message_id")


def stream_receipts(
    spark: SparkSession,
    outbox: DataFrame,
    receipts: DataFrame,
    stored: KeyedStore,
    out: str,
    checkpoint: str,
    interval: str | None = None,
    *,
    patience: str = "1 day",
    lateness: str = "1 hour",
) -> StreamingQuery:
    """Mark the postings of delivered mails as emailed; what became of each mail lies under ``out``.

    Mails without a message_id there are lost: their postings stay as they are in the store. Of a mail's
    repeated receipts, those of one micro-batch mark its postings once, and later ones write the same
    rows again. A replay writes the store's run of that batch again, under its own name.
    """
    use_utc(spark)

    def handle(batch: DataFrame, batch_id: int) -> None:
        mails = batch.groupBy("run_id", "sent_at", "job_ids").agg(
            F.min("message_id").alias("message_id")
        )
        rows = written(mails, f"{out}/batch_id={batch_id}")
        delivered = rows.where("message_id is not null")
        if delivered.isEmpty():
            return
        run = committed_run(spark, out, batch_id)
        if run is None:
            run = new_run()
            commit(spark, out, batch_id, run)
        stored.mark_emailed(delivered.select(F.explode("job_ids").alias("job_id")), run=run)

    writer = (
        match_receipts(outbox, receipts, patience, lateness)
        .writeStream.outputMode("append")
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
    )
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()
