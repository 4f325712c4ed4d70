"""Replies survive failed tasks and failed runs; nobody is asked twice for a usable one."""

import glob
import uuid

import pytest
from pyspark.sql import functions as F

from vacantia.operators import reply_log as L
from vacantia.operators import scoring


def postings(spark, n):
    return spark.range(n).select(
        F.col("id").alias("seq"),
        F.concat(F.lit("j"), F.col("id")).alias("job_id"),
        F.lit("t").alias("title"),
        F.lit("d").alias("description"),
    )


def paying(folder, breaks_at=(), unusable=()):
    """A scorer that notes every request it is paid for, and breaks at some ids."""

    def scorer(batches):
        for batch in batches:
            for job_id in batch["job_id"]:
                if job_id in breaks_at:
                    raise RuntimeError("the connection is gone")
                open(f"{folder}/{job_id}.{uuid.uuid4().hex}", "w").close()
            reply = ["no answer" if j in unusable else '{"score": 70}' for j in batch["job_id"]]
            yield batch[["job_id"]].assign(reply=reply)

    return scorer


def paid(folder):
    return sorted(f.rsplit("/", 1)[1].split(".")[0] for f in glob.glob(f"{folder}/*"))


def test_a_run_that_fails_half_way_keeps_what_it_paid_for(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    log = L.ReplyLog(spark, str(tmp_path / "log"))
    jobs = postings(spark, 40)
    with pytest.raises(Exception, match="the connection is gone"):
        L.paid_once(jobs, log, paying(notes, breaks_at=("j39",)), tasks=4, slice_rows=1)
    before = paid(notes)
    assert before
    # All that was paid for is in the log, but for what tasks were cut off in the middle of.
    logged = {r.job_id for r in log.read().collect()}
    assert logged <= set(before) and len(set(before) - logged) <= 3
    got = L.paid_once(jobs, log, paying(notes), tasks=4, slice_rows=1)
    assert {r.job_id for r in got.collect()} == {f"j{n}" for n in range(40)}
    twice = len(paid(notes)) - 40
    assert twice == len(set(before) - logged)
    again = L.paid_once(jobs, log, paying(notes, breaks_at={f"j{n}" for n in range(40)}))
    assert again.count() == 40


def test_a_retried_task_goes_on_where_it_broke_off(tmp_path, monkeypatch):
    """The same part of the same question again, as Spark does with a task that died."""
    import pandas as pd

    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 3

    monkeypatch.setattr(L, "TaskContext", Context)
    notes = tmp_path / "notes"
    notes.mkdir()
    batch = pd.DataFrame({"job_id": [f"j{n}" for n in range(10)], "prompt": "p"})
    first = L._kept_as_they_arrive(paying(notes, breaks_at=("j6",)), str(tmp_path / "log"), 2)
    with pytest.raises(RuntimeError):
        list(first(iter([batch])))
    assert paid(notes) == [f"j{n}" for n in range(6)]
    second = L._kept_as_they_arrive(paying(notes), str(tmp_path / "log"), 2)
    got = pd.concat(second(iter([batch])))
    assert sorted(got["job_id"]) == [f"j{n}" for n in range(10)]
    assert paid(notes) == [f"j{n}" for n in range(10)]
    # Half a file is passed over.
    (tmp_path / "log" / "part=000003" / "_cut.parquet").write_bytes(b"PAR1")
    assert len(pd.concat(second(iter([batch])))) == 10 and len(paid(notes)) == 10


def test_unusable_replies_are_asked_for_again(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    log = L.ReplyLog(spark, str(tmp_path / "log"))
    jobs = postings(spark, 12)
    first = L.paid_once(jobs, log, paying(notes, unusable=("j3", "j5")))
    assert {r.job_id for r in scoring.unscored(jobs, first).collect()} == {"j3", "j5"}
    second = L.paid_once(jobs, log, paying(notes))
    assert scoring.unscored(jobs, second).isEmpty()
    assert len(paid(notes)) == 14 and second.count() == 12
    assert log.usable(jobs.where("seq < 2")).count() == 2
