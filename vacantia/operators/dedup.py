"""In-batch dedup and lookups against the keyed store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedup_in_batch(postings: DataFrame, seq: str = "seq") -> DataFrame:
    """First row of each job_id.

    `row_number() = 1` is applied inside every map task before the shuffle, so copies of one hot
    id reach the reducer as one row per task.
    """
    first = Window.partitionBy("job_id").orderBy(seq)
    return (
        postings.withColumn("copy", F.row_number().over(first))
        .where(F.col("copy") == 1)
        .drop("copy")
    )


def seen_lookup(postings: DataFrame, store: DataFrame) -> DataFrame:
    """Which of the postings' ids are stored, each once.

    The store is the streamed side: a batch small enough to broadcast is looked up in one scan of
    the store's id column, without shuffling the store.
    """
    return store.select("job_id").join(postings.select("job_id"), "job_id", "left_semi")


def unseen(postings: DataFrame, store: DataFrame) -> DataFrame:
    """Postings whose id is not stored; ``postings`` is a written table, as it is read twice."""
    return postings.join(seen_lookup(postings, store), "job_id", "left_anti")


def new_jobs_only(postings: DataFrame, store: DataFrame, seq: str = "seq") -> DataFrame:
    """Dedup first, then anti-join: the join reuses the dedup's partitioning by job_id, and no
    hot id is left to skew it."""
    unique = dedup_in_batch(postings, seq)
    return unique.join(store.select("job_id"), "job_id", "left_anti")
