"""Search hits and detail documents of the two-stage source, matched as they land."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vacantia.sources.workday import readable_details, workday_stubs

_HIT = "payload_id string, fetched_us long, query string, page int, fetch_id string, pos int"
_DETAIL = "payload_id string, fetched_us long, detail string"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MET = f"slug string, external_path string, {_HIT}, detail string"
_met_row = Row(*[field.split()[0] for field in _MET.split(", ")])
_AT_ONCE = 500


def use_rocksdb(spark: SparkSession) -> SparkSession:
    """State of streams started from now on is kept on disk beside the executors, not in their heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    return spark


class _Match(StatefulProcessor):
    """State of one tenant's path: its latest readable detail, and the hits that wait for one."""

    def __init__(self, keep_ms: int | None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("detail", _DETAIL, self.keep_ms)
        self.waiting = handle.getListState("waiting", _HIT, self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.latest.get() if self.latest.exists() else None
        latest = held
        hits: list[tuple] = []
        for row in rows:
            if row.detail is not None:
                copy = (row.payload_id, row.fetched_us, row.detail)
                if latest is None or _order(copy) < _order(latest):
                    latest = copy
                continue
            hits.append(
                (row.payload_id, row.fetched_us, row.query, row.page, row.fetch_id, row.pos)
            )
            if len(hits) == _AT_ONCE:
                self.waiting.appendList(hits)
                hits = []
        if latest is None:
            if hits:
                self.waiting.appendList(hits)
            return
        if latest is not held:
            self.latest.update(tuple(latest))
        if self.waiting.exists():
            for hit in self.waiting.get():
                yield _met_row(*key, *hit, latest[2])
            self.waiting.clear()
        for hit in hits:
            yield _met_row(*key, *hit, latest[2])

    def close(self) -> None:
        pass


def _order(copy: Any) -> tuple:
    """The copy fetched last comes first; of several, that of the smaller payload id."""
    payload_id, fetched_us, _ = copy
    return (float("inf") if fetched_us is None else -fetched_us, payload_id or "")


def hydrated_hits(documents: DataFrame, keep: dt.timedelta | None = None) -> DataFrame:
    """Columns of a hit, and ``info`` of its detail, once for each hit of a stream of ``documents``.

    A hit meets the latest readable detail landed until then, or waits for the first one; either may
    come first. Both are keyed by tenant and path in the state store, so a micro-batch looks up the keys
    that have just landed and reads no earlier document. A hit without a tenant waits for nothing
    and is left out. With ``keep`` a hit or detail not written for so long is forgotten.
    """
    fetched = F.unix_micros("fetched_at").alias("fetched_us")
    hits = workday_stubs(documents).where("slug is not null")
    hits = hits.select(
        "slug",
        F.col("external_path").alias("path"),
        "payload_id",
        fetched,
        "query",
        "page",
        "fetch_id",
        "pos",
    )
    details = readable_details(documents).where("d_slug is not null")
    info = details.schema["info"].dataType
    details = details.select(
        F.col("d_slug").alias("slug"),
        F.col("d_path").alias("path"),
        "payload_id",
        fetched,
        F.to_json("info").alias("detail"),
    )
    met = (
        hits.unionByName(details, allowMissingColumns=True)
        .groupBy("slug", "path")
        .transformWithState(
            statefulProcessor=_Match(int(keep.total_seconds() * 1000) if keep else None),
            outputStructType=_MET,
            outputMode="append",
            timeMode="ProcessingTime" if keep else "None",
        )
    )
    return met.select(
        F.lit("workday").alias("source"),
        *[c for c in met.columns if c not in ("fetched_us", "detail")],
        F.timestamp_micros("fetched_us").alias("fetched_at"),
        F.from_json("detail", info).alias("info"),
    )
