"""Eligibility and location tiers, from the location text and reported facts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia import fixed_values as V

# Case and character classes follow Unicode, as in the patterns' original engine.
_FLAGS = "(?iU)"


def words(patterns: tuple[str, ...] | list[str]) -> str:
    return rf"\b(?:{'|'.join(patterns)})\b"


US_PATTERN = "|".join([words(V.US_STATE_CODES), *V.US_SCOPE_PATTERNS])
FOREIGN_PATTERN = "|".join([words(V.FOREIGN_REGIONS), *V.FOREIGN_CITY_PATTERNS])


@dataclass(frozen=True)
class Gazetteer:
    """Place patterns that decide tiers; the defaults are the fixed lists."""

    target_metro: tuple[str, ...] = V.TARGET_METRO_PATTERNS
    current_base: tuple[str, ...] = V.CURRENT_BASE_PATTERNS


DEFAULT_GAZETTEER = Gazetteer()


def _found(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(_FLAGS + pattern), F.lit(False))


def is_us_eligible(location: Column) -> Column:
    """False only for text that names somewhere foreign and nowhere in the US."""
    return (
        F.when(location.isNull() | (location == ""), True)
        .when(_found(location, V.CANADA_PREFIX_PATTERN), False)
        .when(_found(location, US_PATTERN), True)
        .otherwise(~_found(location, FOREIGN_PATTERN))
    )


def mentions_target_metro(text: Column, gazetteer: Gazetteer = DEFAULT_GAZETTEER) -> Column:
    return _found(text, words(gazetteer.target_metro))


def mentions_current_base(text: Column, gazetteer: Gazetteer = DEFAULT_GAZETTEER) -> Column:
    return _found(text, words(gazetteer.current_base))


def to_workplace(reported: Column) -> Column:
    """Anything but the four known words is 'unknown'."""
    return F.when(reported.isin(*V.WORKPLACES), reported).otherwise("unknown")


def is_remote(location: Column, remote: Column, workplace: Column | None = None) -> Column:
    """A reported workplace decides; without one the flag or the word in the location does."""
    hinted = F.coalesce(remote, F.lit(False)) | _found(location, V.REMOTE_WORD_PATTERN)
    if workplace is None:
        return hinted
    return (
        F.when(workplace == "remote", True)
        .when(workplace.isin("hybrid", "onsite"), False)
        .otherwise(hinted)
    )


def rare_travel_hybrid(workplace: Column, office_days: Column) -> Column:
    """Hybrid with a stated number of office days small enough to fly in for."""
    return F.coalesce(
        (workplace == "hybrid") & (office_days <= V.RARE_TRAVEL_DAYS), F.lit(False)
    )


def location_tier(
    location: Column,
    remote: Column,
    workplace: Column | None = None,
    office_days_per_month: Column | None = None,
    gazetteer: Gazetteer = DEFAULT_GAZETTEER,
) -> Column:
    """Tier 1 (best) to 6; the first rule that holds wins."""
    at = F.lit("unknown") if workplace is None else workplace
    days = F.lit(None).cast("double") if office_days_per_month is None else office_days_per_month
    metro = mentions_target_metro(location, gazetteer)
    return (
        F.when(is_remote(location, remote, workplace), V.REMOTE_US)
        .when(metro & (at == "hybrid"), V.TARGET_METRO_HYBRID)
        .when(metro, V.TARGET_METRO_ONSITE)
        .when(rare_travel_hybrid(at, days), V.HYBRID_RARE_TRAVEL)
        .when(mentions_current_base(location, gazetteer), V.CURRENT_BASE)
        .otherwise(V.OTHER_US)
    )
