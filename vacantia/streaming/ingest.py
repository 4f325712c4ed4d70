"""Landed files as a stream of postings, and each posting once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vacantia import fixed_values as V
from vacantia.operators import dedup
from vacantia.operators.store import KeyedStore, new_run
from vacantia.session import new_work_dir, use_utc, written
from vacantia.sources import registry
from vacantia.sources.normalise import combine_sources, described, reject_table
from vacantia.sources.payloads import payload_scan
from vacantia.sources.workday import completed, whole_fetches
from vacantia.streaming.hydration import hydrated_hits, use_rocksdb

_ONE_STAGE = [source for source in V.SOURCES if source != "workday"]
_COMMIT = "batch_id long, run string"


def _start(stream: DataFrame, handle, checkpoint: str, interval: str | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()


def stream_ingest(
    spark: SparkSession,
    landed: str,
    out: str,
    checkpoint: str,
    fetched_at: dt.datetime | Column,
    interval: str | None = None,
    *,
    packed: bool = False,
    fetches: bool = False,
    quarantine: bool = False,
    keep: dt.timedelta | None = None,
) -> StreamingQuery:
    """New landed files become postings under ``out``, one folder per micro-batch.

    With ``quarantine`` the documents that cannot be used lie under ``out``-rejected, whole and with the
    reason; that is a second parse of what has just landed.

    A replayed batch overwrites its own folder. Search hits and details of the two-stage source may
    land in any order: they meet in the state store (`hydrated_hits`; ``keep`` bounds how long one waits
    for the other), and no earlier document is read again. A detail without a title fails what its hits'
    fetches give in the micro-batch in which they meet; postings written before stay.
    """
    use_rocksdb(use_utc(spark))
    boards, sites = registry.boards(spark), registry.workday_boards(spark)

    def handle(batch: DataFrame, batch_id: int) -> None:
        # The documents are read once per normaliser branch, so they are written first.
        path = new_work_dir(spark, f"ingest-{batch_id}")
        landed_now = written(batch, path, partition_by="source")
        documents = landed_now.where("hit is null").drop("hit", "info")
        if quarantine:
            rejected = reject_table(documents, body=True)
            rejected.write.mode("overwrite").parquet(f"{out}-rejected/batch_id={batch_id}")
        met = landed_now.where("source = 'workday' and hit is not null").select("hit.*", "info")
        postings = combine_sources(documents, boards, sources=_ONE_STAGE).unionByName(
            described(completed(whole_fetches(met), sites))
        )
        postings.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    landed_docs = payload_scan(
        spark, landed, fetched_at, streaming=True, packed=packed, fetches=fetches
    )
    met = hydrated_hits(landed_docs, keep)
    hit = F.struct(*[c for c in met.columns if c != "info"]).alias("hit")
    met = met.select("source", hit, "info")
    documents = landed_docs if quarantine else landed_docs.where("source <> 'workday'")
    stream = documents.unionByName(met, allowMissingColumns=True)
    return _start(stream, handle, checkpoint, interval)


def stream_dedup(
    spark: SparkSession,
    postings: DataFrame,
    stored: KeyedStore,
    out: str,
    checkpoint: str,
    interval: str | None = None,
) -> StreamingQuery:
    """Emit each posting once, for ever: the keyed store is the memory, not bounded state.

    The new rows are written before the store closes over them, and a batch that was written is
    not computed again, so a replay loses nothing and emits nothing twice; it writes the store's run of
    that batch again, under its own name.
    """
    use_utc(spark)

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = f"{out}/batch_id={batch_id}"
        run = committed_run(spark, out, batch_id)
        if run is None:
            run = new_run()
            unique = written(dedup.dedup_in_batch(batch), new_work_dir(spark, f"dedup-{batch_id}"))
            written(stored.unseen(unique), rows)
            commit(spark, out, batch_id, run)
        stored.mark_seen(spark.read.schema(batch.schema).parquet(rows), run=run)

    return _start(postings, handle, checkpoint, interval)


def commit(spark: SparkSession, out: str, batch_id: int, run: str) -> None:
    """Note that the rows of a micro-batch are complete, and under which name the store gets them."""
    spark.createDataFrame([(batch_id, run)], _COMMIT).coalesce(1).write.mode("overwrite").parquet(
        f"{out}-commits/{batch_id}"
    )


def committed_run(spark: SparkSession, out: str, batch_id: int) -> str | None:
    """The store's run of a micro-batch whose rows are complete."""
    try:
        found = spark.read.schema(_COMMIT).parquet(f"{out}-commits/{batch_id}").first()
    except Exception as error:  # no such folder: nothing was committed
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    return found.run if found else None
