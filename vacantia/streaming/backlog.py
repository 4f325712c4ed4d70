"""Postings that wait for a later run, as appended events.

A posting that a run leaves over enters the backlog: its wide row is written once, below the micro-batch
it came with, and a narrow event says so. When it is scored, stored elsewhere or too old, another event
says that it left. Nothing is written again for what goes on waiting, so a micro-batch writes as many rows
as it has arrivals and departures. What waits now is the latest event of each id; every SNAPSHOT batches it
is written down, so that a batch reads the last snapshot and the events since, and not all of history. Text
is read for chosen postings only, from the folders of the batches they came with.

Every folder belongs to one micro-batch and is overwritten if that is replayed; batches later than the one
asked for are not read. Folders of text whose postings have all left are not removed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNAPSHOT = 16
#: What the gate needs of a posting, and the micro-batch whose folder has the rest.
NARROW = ("job_id", "seq", "location", "remote", "posted_at")
_KEY = ["job_id", "seq"]


@dataclass(frozen=True)
class Backlog:
    """The backlog in folder ``path`` of postings with schema ``wide``."""

    spark: SparkSession
    path: str
    wide: T.StructType
    snapshot_every: int = SNAPSHOT

    def waiting(self, batch_id: int) -> DataFrame:
        """Narrow rows, with ``entered``, of what waits after micro-batch ``batch_id``."""
        start = batch_id - batch_id % self.snapshot_every
        if batch_id < 0:
            return self.spark.createDataFrame([], self._narrow())
        known = self._read("snapshots", [start], self._narrow()).select(self._narrow().names)
        if start == batch_id:
            return known
        events = self._read("events", range(start + 1, batch_id + 1), self._events())
        first = known.withColumns({"waits": F.lit(True), "batch_id": F.lit(start).cast("bigint")})
        row = F.struct("waits", *[c for c in self._narrow().names if c != "job_id"])
        latest = (
            first.unionByName(events)
            .groupBy("job_id")
            .agg(F.max_by(row, "batch_id").alias("last"))
            .where("last.waits")
        )
        return latest.select("job_id", "last.*").select(self._narrow().names)

    def arrivals(self, batch: DataFrame, batch_id: int, held: DataFrame) -> DataFrame:
        """Narrow rows of a micro-batch; one that waits already goes on under the batch it came with."""
        narrow = batch.select(*NARROW, F.lit(batch_id).cast("bigint").alias("entered"))
        return narrow.join(held.select(*_KEY), _KEY, "left_anti")

    def texts(self, chosen: DataFrame, batch: DataFrame, batch_id: int) -> DataFrame:
        """Wide rows of ``chosen`` (job_id, seq, entered)."""
        now = batch.join(chosen.where(F.col("entered") == batch_id), _KEY, "left_semi")
        before = chosen.where(F.col("entered") < batch_id)
        batches = [r.entered for r in before.select("entered").distinct().collect()]
        if not batches:
            return now
        old = self._read("postings", batches, self.wide).join(before, _KEY, "left_semi")
        return now.unionByName(old.select(batch.columns))

    def record(
        self, batch: DataFrame, batch_id: int, held: DataFrame, pending: DataFrame
    ) -> None:
        """Write what entered and left: ``held`` waited before the batch, ``pending`` waits after it."""
        entered = pending.join(held.select(*_KEY), _KEY, "left_anti")
        left = held.join(pending.select("job_id"), "job_id", "left_anti")
        events = entered.withColumn("waits", F.lit(True)).unionByName(
            left.withColumn("waits", F.lit(False))
        )
        self._write(events.select("waits", *self._narrow().names), "events", batch_id)
        entered = self._read("events", [batch_id], self._events()).where("waits")
        self._write(batch.join(entered, _KEY, "left_semi"), "postings", batch_id)
        if batch_id % self.snapshot_every == 0:
            self._write(pending.select(self._narrow().names), "snapshots", batch_id)

    def _write(self, rows: DataFrame, kind: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{kind}/batch_id={batch_id}")

    def _read(self, kind: str, batches, schema: T.StructType) -> DataFrame:
        folders = [f"{self.path}/{kind}/batch_id={n}" for n in batches]
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}")
        return reader.parquet(*folders)

    def _narrow(self) -> T.StructType:
        """Schema of the narrow rows."""
        fields = [T.StructField(n, self.wide[n].dataType) for n in NARROW]
        return T.StructType([*fields, T.StructField("entered", T.LongType())])

    def _events(self) -> T.StructType:
        fields = [T.StructField("waits", T.BooleanType()), *self._narrow().fields]
        return T.StructType([*fields, T.StructField("batch_id", T.LongType())])
