"""Keys and times of a posting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Years 1 to 9999 in epoch milliseconds.
_MILLIS_RANGE = (-62135596800000, 253402300799999)


def job_id(source: Column, source_id: Column) -> Column:
    """SHA-256 over source, NUL and the source's own id, as 64 hex digits."""
    return F.sha2(F.concat(source, F.char(F.lit(0)), source_id), 256)


def parse_posted_at(text: Column) -> Column:
    """ISO date or date-time; without a zone it is UTC; anything else is NULL."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))


def parse_posted_millis(millis: Column) -> Column:
    """Epoch milliseconds; outside the calendar it is NULL."""
    return F.timestamp_millis(F.when(millis.between(*_MILLIS_RANGE), millis))
