"""Paid replies, kept as they arrive.

A task that asks the scorer writes every slice of replies the scorer hands back as a file of its own, at
once, and not when the task or the job ends. So a task that dies, or a job that fails, loses at most the
slice it was working on: a retried task begins with what its earlier attempts wrote, and a repeated run
asks only for postings without a usable reply in the log.

Files are Parquet in plain folders, `ask=` for each time a run asks and `part=` for each of its tasks. A
file is written under a name that readers pass over and then renamed, so none is ever read half. There is
no other protocol: an id may have several replies, of attempts that ran side by side, and readers take one.

Give a run, or a micro-batch, a log of its own: then no run reads what others paid for.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from vacantia import schemas as S
from vacantia.operators import scoring
from vacantia.session import new_work_dir, written

#: Postings handed to the scorer at a time, unless it is told otherwise.
SLICE = 20
_FILE = pa.schema([("job_id", pa.string()), ("reply", pa.string())])


@dataclass(frozen=True)
class ReplyLog:
    """The log in folder ``path``, which driver and tasks share and `pyarrow.fs` can open."""

    spark: SparkSession
    path: str

    def read(self) -> DataFrame:
        """job_id, reply of everything paid for, in no order; one id may have several."""
        empty = self.spark.createDataFrame([], S.REPLY)
        empty.write.mode("ignore").parquet(f"{self.path}/ask=none/part=none")
        return self.spark.read.schema(S.REPLY).parquet(self.path).select("job_id", "reply")

    def usable(self, postings: DataFrame) -> DataFrame:
        """job_id, reply of the usable replies to ``postings``."""
        mine = self.read().join(postings.select("job_id"), "job_id", "left_semi")
        return scoring.parse_response(mine).where("parsed").select("job_id", "reply")

    def ask(
        self,
        postings: DataFrame,
        scorer: scoring.Scorer,
        profile: dict[str, Any] | None = None,
        tasks: int | None = None,
        slice_rows: int = SLICE,
    ) -> DataFrame:
        """job_id, reply for ``postings``, logged by the tasks while they ask."""
        folder = f"{self.path}/ask={uuid.uuid4().hex}"
        kept = _kept_as_they_arrive(scorer, folder, slice_rows)
        return scoring.request_replies(postings, kept, profile, tasks)


def paid_once(
    postings: DataFrame,
    log: ReplyLog,
    scorer: scoring.Scorer,
    profile: dict[str, Any] | None = None,
    tasks: int | None = None,
    slice_rows: int = SLICE,
) -> DataFrame:
    """Replies to ``postings``: the usable ones of the log, and for the others the scorer's.

    A posting whose logged replies are all unusable is asked for again.
    """
    spark = log.spark
    known = written(log.usable(postings), new_work_dir(spark, "known-replies"))
    missing = postings.join(known.select("job_id"), "job_id", "left_anti")
    fresh = log.ask(missing, scorer, profile, tasks, slice_rows)
    return known.unionByName(written(fresh, new_work_dir(spark, "fresh-replies")))


def _kept_as_they_arrive(scorer: scoring.Scorer, folder: str, slice_rows: int) -> Callable:
    """``scorer`` given small slices, each of its answers written before it goes on."""

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = f"{folder}/part={TaskContext.get().partitionId():06d}"
        files, path = fs.FileSystem.from_uri(own)
        files.create_dir(path, recursive=True)
        earlier = _earlier(files, path)
        if len(earlier):
            yield earlier
        answered = set(earlier["job_id"])

        def slices() -> Iterator[pd.DataFrame]:
            for batch in batches:
                missing = batch[~batch["job_id"].isin(answered)]
                for start in range(0, len(missing), slice_rows):
                    yield missing.iloc[start : start + slice_rows].reset_index(drop=True)

        for replies in scorer(slices()):
            replies = replies[["job_id", "reply"]]
            _append(files, path, replies)
            yield replies

    return asked


def _append(files: fs.FileSystem, path: str, replies: pd.DataFrame) -> None:
    name = f"{uuid.uuid4().hex}.parquet"
    rows = pa.Table.from_pandas(replies, schema=_FILE, preserve_index=False)
    with files.open_output_stream(f"{path}/_{name}") as out:
        pq.write_table(rows, out)
    files.move(f"{path}/_{name}", f"{path}/{name}")


def _earlier(files: fs.FileSystem, path: str) -> pd.DataFrame:
    """What earlier attempts of this task have paid for."""
    found = [
        f.path
        for f in files.get_file_info(fs.FileSelector(path))
        if f.is_file and f.base_name.endswith(".parquet") and not f.base_name.startswith("_")
    ]
    tables = [pq.read_table(name, filesystem=files, schema=_FILE) for name in found]
    rows = pa.concat_tables([_FILE.empty_table(), *tables]).to_pandas()
    return rows.astype(object).where(rows.notna(), None)
