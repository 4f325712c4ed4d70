"""Tiers, skip verdicts and the final order."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions.fit import rank_keys, skip_reason
from vacantia.functions.location import (
    DEFAULT_GAZETTEER,
    Gazetteer,
    location_tier,
)
from vacantia.session import new_work_dir, written

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def scored_tier(gazetteer: Gazetteer = DEFAULT_GAZETTEER) -> Column:
    """Tier of a scored posting, with the reported workplace and office days.

    A workplace that is none of the known words decides nothing, so it needs no mapping here.
    """
    return location_tier(
        F.col("location"),
        F.col("remote"),
        F.col("workplace"),
        F.col("office_days_per_month"),
        gazetteer,
    )


def rank_one(
    scored: DataFrame,
    profile: dict[str, Any] | None = None,
    gazetteer: Gazetteer = DEFAULT_GAZETTEER,
) -> DataFrame:
    """Add ``location_tier``, ``skip_reason`` and ``status``."""
    reason = skip_reason(
        F.col("years_required"), F.col("work_authorization"), F.col("skip_flags"), profile
    )
    return scored.withColumns(
        {"location_tier": scored_tier(gazetteer), "skip_reason": reason}
    ).withColumn("status", F.when(F.col("skip_reason").isNull(), "ranked").otherwise("skipped"))


def rank(
    scored: DataFrame,
    profile: dict[str, Any] | None = None,
    gazetteer: Gazetteer = DEFAULT_GAZETTEER,
    seq: str = "seq",
) -> DataFrame:
    """Every scored posting in final order: a range-partitioned sort, nothing dropped."""
    return rank_one(scored, profile, gazetteer).orderBy(*rank_keys(seq))


def rank_by_location(postings: DataFrame, seq: str = "seq") -> DataFrame:
    """Every posting, best tier first, in feed order within a tier."""
    tier = location_tier(F.col("location"), F.col("remote"))
    return postings.withColumn("location_tier", tier).orderBy("location_tier", seq)


def with_global_rank(df: DataFrame, keys: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add the 1-based position under ``keys`` without pulling rows into one task.

    The range-sorted rows are written once; positions are partition offsets plus local row
    numbers. Only the per-partition counts (one row per task) meet in a single window. The keys
    end in a unique column, so even equal leading keys split over the ranges.
    """
    path = new_work_dir(df.sparkSession, "rank")
    ordered = df.orderBy(*keys).withColumn("_row", F.monotonically_increasing_id())
    rows = written(ordered, path)
    part = F.shiftright("_row", _ROW_BITS)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    local = F.col("_row").bitwiseAND((1 << _ROW_BITS) - 1)
    return (
        rows.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row per sort task
        .withColumn(name, F.col("_offset") + local + 1)
        .drop("_part", "_row", "_offset")
    )
