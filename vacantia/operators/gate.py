"""Filters and the cost gate in front of scoring."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.functions.fit import freshness
from vacantia.functions.location import (
    DEFAULT_GAZETTEER,
    Gazetteer,
    is_us_eligible,
    location_tier,
)


def instant(now: dt.datetime | str | Column) -> Column:
    return (now if isinstance(now, Column) else F.lit(now)).cast("timestamp")


def keep_worth_scoring(postings: DataFrame) -> DataFrame:
    """Postings that might be workable from the US. The title is never looked at."""
    return postings.where(is_us_eligible(F.col("location")))


def workable_gate(
    postings: DataFrame, workable_only: bool = True, gazetteer: Gazetteer = DEFAULT_GAZETTEER
) -> DataFrame:
    """Drop postings whose location text alone puts them in the last tier."""
    if not workable_only:
        return postings
    tier = location_tier(F.col("location"), F.col("remote"), gazetteer=gazetteer)
    return postings.where(tier != V.OTHER_US)


def freshness_cut(
    postings: DataFrame, now: dt.datetime | str | Column, max_age_days: int | None
) -> DataFrame:
    """Drop postings older than ``max_age_days``; undated ones stay."""
    if max_age_days is None:
        return postings
    cutoff = instant(now) - F.make_interval(days=F.lit(max_age_days))
    return postings.where(F.col("posted_at").isNull() | (F.col("posted_at") >= cutoff))


def select_within_budget(
    postings: DataFrame,
    now: dt.datetime | str | Column,
    max_age_days: int | None = None,
    max_score_per_run: int | None = None,
    seq: str = "seq",
) -> DataFrame:
    """The freshest postings a run may score. Without a bound on the number nothing is sorted.

    ``max_score_per_run`` is a number of paid requests: every task keeps that many rows, and one task
    merges them.
    """
    kept = freshness_cut(postings, now, max_age_days)
    if max_score_per_run is None:
        return kept
    order = [freshness(F.col("posted_at")).desc(), F.col(seq).asc()]
    return kept.orderBy(*order).limit(max_score_per_run)


def deferred(new: DataFrame, selected: DataFrame) -> DataFrame:
    """New postings this run does not score; they are not stored, so the next run sees them."""
    return new.join(selected.select("job_id"), "job_id", "left_anti")
