"""The keyed store: a Parquet table whose rows are appended by run.

A run writes its own rows and nothing else; of the rows of an id the latest run's counts. The gate in
front of scoring needs the id column only. ``compacted`` writes the latest rows to a new table, and the
caller goes on with that one. There is no update in place, so nothing reads a folder that is being
written over, and a run that is repeated under its own name replaces what it wrote.

Compacted into buckets, the rows lie in files by a hash of their id, sorted, with Parquet's bloom filters.
A lookup then deals its own few ids to the buckets and leaves the store where it is, and one id is looked
for in one bucket. Only runs written since the compaction are scanned whole.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia import schemas as S
from vacantia.functions.text import null_if_empty
from vacantia.operators import dedup


def iso_text(at: Column) -> Column:
    """ISO text with the UTC offset; microseconds only when there are any."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(at, ".SSSSSS")
    return F.concat(
        whole, F.when(micros == ".000000", "").otherwise(micros), F.lit("+00:00")
    )


def _item_columns() -> dict[str, Column]:
    salary = null_if_empty(F.col("salary"))
    return {
        "job_id": F.col("job_id"),
        "source": F.col("source"),
        "source_id": F.col("source_id"),
        "company": F.col("company"),
        "title": F.col("title"),
        "url": F.col("url"),
        "remote": F.col("remote"),
        "status": F.lit("new"),
        "fetched_at": iso_text(F.col("fetched_at")),
        "location": null_if_empty(F.col("location")),
        "salary": salary,
        "salary_is_estimated": F.when(salary.isNotNull(), F.col("salary_is_estimated")),
        "posted_at": iso_text(F.col("posted_at")),
    }


def _as_store_rows(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.select(
        *[
            columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in S.STORE.fields
        ]
    )


def store_item(postings: DataFrame) -> DataFrame:
    """Store rows of unscored postings: no description, status 'new'."""
    return _as_store_rows(postings, _item_columns())


def store_scored_item(ranked: DataFrame) -> DataFrame:
    """Store rows of ranked postings, with the verdict."""
    columns = _item_columns() | {
        "status": F.when(F.col("status") == "ranked", "new").otherwise("skipped"),
        "fit_score": F.col("score"),
        "fit_reason": F.col("reason"),
        "location_tier": F.col("location_tier"),
        "skip_flags": F.when(F.size("skip_flags") > 0, F.col("skip_flags")),
        "skip_reason": F.col("skip_reason"),
    }
    return _as_store_rows(ranked, columns)


def last_write(items: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per job_id of a batch, the last one written."""
    latest = Window.partitionBy("job_id").orderBy(F.col(seq).desc())
    return (
        items.withColumn("copy", F.row_number().over(latest))
        .where(F.col("copy") == 1)
        .drop("copy")
    )


def emailed(store: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with status 'emailed' for ``ids``; one that is not stored becomes a bare row."""
    sent = ids.select("job_id").distinct()
    columns = {f.name: F.col(f.name) for f in S.STORE.fields} | {"status": F.lit("emailed")}
    return _as_store_rows(sent.join(store, "job_id", "left"), columns)


# --- the table on disk --------------------------------------------------------------

def latest_rows(rows: DataFrame) -> DataFrame:
    """One row per job_id, of the latest run. The cut comes before the shuffle, in every map task."""
    newest = Window.partitionBy("job_id").orderBy(F.col("run").desc())
    return rows.withColumn("copy", F.row_number().over(newest)).where("copy = 1").drop("copy", "run")


@dataclass(frozen=True)
class KeyedStore:
    """The table at ``path``, with a folder `run=` per write and, if ``buckets``, a compacted `base`."""

    spark: SparkSession
    path: str
    buckets: int | None = None

    def create(self) -> KeyedStore:
        """Write an empty table unless there is one."""
        empty = self.spark.createDataFrame([], S.STORE)
        empty.write.mode("ignore").parquet(f"{self.path}/run={0:020d}")
        return self

    def read(self) -> DataFrame:
        return latest_rows(self._rows())

    def ids(self) -> DataFrame:
        """Every stored id, once per run that wrote it: enough to tell what is new."""
        return self._rows().select("job_id")

    def unseen(self, postings: DataFrame) -> DataFrame:
        """Postings whose id is not stored; ``postings`` is a written table, as it is read again."""
        parts = [dedup.seen_lookup(postings, rows) for rows in self._parts()]
        return postings.join(reduce(DataFrame.unionByName, parts), "job_id", "left_anti")

    def near(self, batch: DataFrame) -> DataFrame:
        """Stored rows of the ids of ``batch``. The store is the streamed side of the lookup."""
        ids = batch.select("job_id")
        found = [rows.join(ids, "job_id", "left_semi") for rows in self._parts()]
        return latest_rows(reduce(DataFrame.unionByName, found))

    def get(self, job_id: str) -> DataFrame:
        """Stored record of one id; the filter reaches the scan, and one bucket's file."""
        return latest_rows(store_get(self._rows(), job_id))

    def upsert(self, items: DataFrame, run: str | None = None) -> None:
        """Append ``items``, one row per job_id, as one run; the same run again replaces it."""
        items.write.mode("overwrite").parquet(f"{self.path}/run={run or new_run()}")

    def mark_seen(self, postings: DataFrame, seq: str = "seq", run: str | None = None) -> None:
        self.upsert(store_item(last_write(postings, seq)), run)

    def save_new(self, ranked: DataFrame, seq: str = "seq", run: str | None = None) -> None:
        self.upsert(store_scored_item(last_write(ranked, seq)), run)

    def mark_emailed(self, ids: DataFrame, run: str | None = None) -> None:
        self.upsert(emailed(self.near(ids), ids), run)

    def compacted(self, path: str, buckets: int | None = None) -> KeyedStore:
        """The latest rows as a new table at ``path``, sorted by id within its files.

        With ``buckets`` there is a file for each; take as many as keep a file at some 100 MB.
        """
        if buckets is None:
            sorted_rows = self.read().sortWithinPartitions("job_id")
            sorted_rows.write.mode("error").parquet(f"{path}/run={0:020d}")
            return KeyedStore(self.spark, path)
        made = KeyedStore(self.spark, path, buckets).create()
        (
            self.read()
            .repartition(buckets, "job_id")
            .write.format("parquet")
            .bucketBy(buckets, "job_id")
            .sortBy("job_id")
            .option("path", f"{path}/base")
            .option("parquet.bloom.filter.enabled#job_id", "true")
            .mode("error")
            .saveAsTable(made._table())
        )
        return made

    def _parts(self) -> list[DataFrame]:
        """What is looked up each on its own: the compacted rows, and the runs written since."""
        schema = T.StructType([*S.STORE.fields, T.StructField("run", T.StringType())])
        reader = self.spark.read.schema(schema)
        if self.buckets is None:
            return [reader.parquet(self.path)]
        runs = reader.option("basePath", self.path).parquet(f"{self.path}/run=*")
        return [self._base().withColumn("run", F.lit("")), runs]

    def _rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self._parts())

    def _table(self) -> str:
        return f"store_{hashlib.md5(self.path.encode()).hexdigest()}_{self.buckets}"

    def _base(self) -> DataFrame:
        """The compacted rows; a session that has not seen the table is told where it lies."""
        name = self._table()
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(
                f"CREATE TABLE {name} ({S.STORE.toDDL()}) USING parquet CLUSTERED BY (job_id) "
                f"SORTED BY (job_id) INTO {self.buckets} BUCKETS LOCATION '{self.path}/base'"
            )
        return self.spark.table(name)


def new_run() -> str:
    """A name that sorts after those of earlier runs."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def store_get(store: DataFrame, job_id: str | Column) -> DataFrame:
    """Stored record of one id."""
    return store.where(F.col("job_id") == job_id)
