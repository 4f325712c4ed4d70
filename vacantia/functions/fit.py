"""Skip rules and the ranking order."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.functions.text import collapse_ws, strip_ws


def years_wall(profile: dict[str, Any] | None) -> float:
    return (profile or {}).get("skip_flags", {}).get("years_required_above", V.YEARS_WALL)


def number_text(number: Column) -> Column:
    """Whole numbers without a decimal point."""
    return F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(
        number.cast("string")
    )


def skip_reason(
    years_required: Column,
    work_authorization: Column,
    skip_flags: Column,
    profile: dict[str, Any] | None = None,
) -> Column:
    """Why a posting is skipped, or NULL; the first rule that holds wins."""
    wall = years_wall(profile)
    before, rest = V.SKIP_YEARS_FORMAT.split("{years}")
    years_text = F.concat(
        F.lit(before), number_text(years_required), F.lit(rest.format(wall=wall))
    )
    reason = F.when(years_required >= wall, years_text).when(
        work_authorization == V.SKIP_AUTHORIZATION, V.SKIP_AUTHORIZATION_TEXT
    )
    for flag, text in V.SKIP_FLAG_TEXTS.items():
        reason = reason.when(F.array_contains(skip_flags, flag), text)
    return reason


def freshness(posted_at: Column) -> Column:
    """Undated postings count as the oldest ones."""
    return F.coalesce(posted_at, F.timestamp_seconds(F.lit(0)))


def rank_keys(seq: str = "seq") -> list[Column]:
    """Sort keys of the final order. ``seq`` is unique, so the order is total."""
    return [
        F.when(F.col("status") == "ranked", 0).otherwise(1).asc(),
        F.when(F.col("location_tier") == V.OTHER_US, 1).otherwise(0).asc(),
        F.col("score").desc(),
        F.col("location_tier").asc(),
        freshness(F.col("posted_at")).desc(),
        F.col(seq).asc(),
    ]


def company_key(company: Column) -> Column:
    return F.lower(strip_ws(F.coalesce(company, F.lit(""))))


def title_key(title: Column) -> Column:
    return F.lower(collapse_ws(F.coalesce(title, F.lit(""))))
