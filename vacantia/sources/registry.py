"""The source registry: small dimension tables built from the fixed lists."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia import fixed_values as V

_TEXT, _INT, _FLAG = pa.string(), pa.int32(), pa.bool_()
_BOARD = {"source": _TEXT, "slug": _TEXT, "company": _TEXT}
_TENANT = {"tenant": _TEXT, "site": _TEXT, "host": _TEXT, "company": _TEXT}
_QUERY = {
    "source": _TEXT, "slug": _TEXT, "query": _TEXT, "place": _TEXT, "radius": _INT,
    "remote_only": _FLAG, "max_results": _INT,
}


def _local(
    spark: SparkSession, rows: Sequence[tuple], columns: dict[str, pa.DataType]
) -> DataFrame:
    """A local table. Spark knows its size, so joins with it broadcast it without a hint."""
    values = zip(*rows, strict=True) if rows else [[]] * len(columns)
    arrays = [pa.array(list(v), t) for v, t in zip(values, columns.values(), strict=True)]
    return spark.createDataFrame(pa.table(dict(zip(columns, arrays, strict=True))))


def boards(
    spark: SparkSession, rows: Iterable[tuple[str, str, str]] = V.BOARDS
) -> DataFrame:
    """Company boards: (source, slug, company)."""
    return _local(spark, list(rows), _BOARD)


def workday_boards(spark: SparkSession) -> DataFrame:
    return _local(spark, V.WORKDAY_BOARDS, _TENANT)


def _queries() -> list[tuple]:
    rows: list[tuple] = [
        ("remotive", "all", term, None, None, None, None) for term in V.REMOTIVE_SEARCHES
    ]
    rows += [
        ("adzuna", place, phrase, place, miles, None, V.ADZUNA_QUERY_MAX_RESULTS)
        for (place, miles), phrase in product(V.ADZUNA_PLACES, V.ADZUNA_PHRASES)
    ]
    rows += [
        ("workday", tenant, term, None, None, None, V.WORKDAY_QUERY_MAX_RESULTS)
        for (tenant, *_), term in product(V.WORKDAY_BOARDS, V.WORKDAY_SEARCHES)
    ]
    rows += [
        ("usajobs", place or "remote", word, place, miles, remote, V.USAJOBS_QUERY_MAX_RESULTS)
        for word, (place, miles, remote) in product(V.USAJOBS_KEYWORDS, V.USAJOBS_SCOPES)
    ]
    return rows


def query_grid(spark: SparkSession) -> DataFrame:
    """Searches of the queried sources: every term in every scope (``slug``)."""
    return _local(spark, _queries(), _QUERY)


def all_sources(spark: SparkSession) -> DataFrame:
    """Everything a full run reads, numbered by ``source_no`` from 0: boards, then searches."""
    rows = [(*board[:2], None, None, None, None, None) for board in V.BOARDS] + _queries()
    return _local(spark, [(n, *row) for n, row in enumerate(rows)], {"source_no": _INT} | _QUERY)


def landed_by_source(registry: DataFrame, status: DataFrame) -> DataFrame:
    """Documents and failures per registered source; sources that landed nothing show zeros."""
    keys = ["source", "slug", "query"]
    landed = status.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    landed = landed.select(*[F.col(k).alias(f"l_{k}") for k in keys], "documents", "failed")
    return registry.join(
        landed, [F.col(k).eqNullSafe(F.col(f"l_{k}")) for k in keys], "left"
    ).select(
        *registry.columns,
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("failed", F.lit(0)).alias("failed"),
    )


def registry_checks(registry: DataFrame) -> DataFrame:
    """Entries that break a rule: unknown source, blank company, repeated (source, slug)."""
    known = F.coalesce(F.col("source").isin("greenhouse", "lever", "ashby"), F.lit(False))
    named = F.coalesce(F.trim("company") != "", F.lit(False))
    per_entry = registry.groupBy("source", "slug").agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(~known).alias("unknown_source"),
        F.count_if(~named).alias("blank_company"),
    )
    return per_entry.where(
        (F.col("entries") > 1) | (F.col("unknown_source") > 0) | (F.col("blank_company") > 0)
    )
