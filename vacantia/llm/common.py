"""What the operators of this package share: settings, words, hashing, splitting of batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.session import new_work_dir, use_utc, written

#: White space between words, as a regular expression of the JVM.
SPACE = r"[\x20\x09-\x0D]+"

__all__ = [
    "SPACE", "crc_fold", "gathered", "new_work_dir", "prepared", "slices", "table", "words", "written",
]


def prepared(spark: SparkSession) -> SparkSession:
    """Texts can be long: small Arrow batches bound a Python worker's memory."""
    use_utc(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Non-empty runs between white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def crc_fold(doc_id: Column, remainder: int) -> Column:
    """Whether crc32(doc_id as text) mod 5 is ``remainder``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == remainder


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000):
    """Cut Arrow batches into runs of rows of about ``most`` bytes of ``column``; long rows alone."""
    for batch in batches:
        sizes = np.fromiter(
            (len(v.as_buffer()) if v.is_valid else 0 for v in batch.column(column)),
            np.int64,
            batch.num_rows,
        )
        start, held = 0, 0
        for n, size in enumerate(sizes.tolist()):
            if held and held + size > most:
                yield batch.slice(start, n - start)
                start, held = n, 0
            held += size + 1
        if start < batch.num_rows:
            yield batch.slice(start)


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000):
    """Arrow batches put together, or cut, into ones of about ``most`` bytes of ``column``."""
    held, size = [], 0
    for part in slices(batches, column, most):
        # Counted by offsets: a slice's buffers are those of its whole batch.
        own = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
        if held and size + own > most:
            yield _together(held)
            held, size = [], 0
        held.append(part)
        size += own
    if held:
        yield _together(held)


def _together(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
