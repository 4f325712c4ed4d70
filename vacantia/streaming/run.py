"""One scheduled run per micro-batch."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vacantia.operators import scoring
from vacantia.operators.store import KeyedStore, new_run
from vacantia.plans.run import run_cycle
from vacantia.session import new_work_dir, use_utc, written
from vacantia.streaming.backlog import Backlog
from vacantia.streaming.ingest import _start, commit, committed_run


def stream_run(
    spark: SparkSession,
    postings: DataFrame,
    stored: KeyedStore,
    out: str,
    checkpoint: str,
    *,
    interval: str | None = None,
    replies: DataFrame | None = None,
    scorer: scoring.Scorer | None = None,
    **knobs: Any,
) -> StreamingQuery:
    """Budget, score, rank, store and count each micro-batch of postings.

    Results lie under ``out``: `ranked/batch_id=`, `digest/batch_id=` and `counts/batch_id=`. A
    run saves its ranking before the store closes over it; a replay of a finished batch only writes the
    store's run of that batch again, under its own name, and one of an unfinished batch finds its replies
    in the batch's own log, so no posting is scored or counted twice. What a run leaves over, by its budget
    or without a usable reply, waits in the `Backlog` under ``out``-backlog and joins the next one.
    """
    use_utc(spark)
    backlog = Backlog(spark, f"{out}-backlog", postings.schema)

    def handle(batch: DataFrame, batch_id: int) -> None:
        ranked_path = f"{out}/ranked/batch_id={batch_id}"
        run = committed_run(spark, out, batch_id)
        if run is not None:
            stored.save_new(spark.read.parquet(ranked_path), run=run)
            return
        held = written(backlog.waiting(batch_id - 1), new_work_dir(spark, f"held-{batch_id}"))
        arrived = backlog.arrivals(batch, batch_id, held)
        result = run_cycle(
            spark,
            arrived.unionByName(held),
            stored,
            replies=replies,
            scorer=scorer,
            reply_log=f"{out}-replies/batch_id={batch_id}",
            save=False,
            text_of=lambda chosen: backlog.texts(chosen, batch, batch_id),
            **knobs,
        )
        result.ranked.write.mode("overwrite").parquet(ranked_path)
        result.digest.write.mode("overwrite").parquet(f"{out}/digest/batch_id={batch_id}")
        result.counts.coalesce(1).write.mode("overwrite").parquet(
            f"{out}/counts/batch_id={batch_id}"
        )
        backlog.record(batch, batch_id, held, result.pending)
        run = new_run()
        commit(spark, out, batch_id, run)
        stored.save_new(spark.read.parquet(ranked_path), run=run)

    return _start(postings, handle, checkpoint, interval)
