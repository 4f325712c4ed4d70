"""Token ids as Parquet list columns, sorted by document, with controlled row groups and pages.

The ids column is a list of 32-bit integers, dictionary-encoded: a row group holds fewer distinct ids
than the vocabulary. doc_id, n_tokens and local_start grow slowly or not at all within a file and are
delta-encoded. Row groups and pages are small and the files have page indexes, so a reader that wants
some documents, or only metadata, skips the rest. Files follow ascending doc_id: part k holds smaller
ids than part k + 1. ``local_start`` counts the ids before a document in its part; the sums per part,
one row each, turn it into the place in the whole corpus.

Defined results: a null text is an empty one and has only its end id. Repeated rows are written one by
one; rows of one doc_id follow each other in the order of their texts' hashes, and a null doc_id comes
first. Extra columns are not written. An empty table gives an empty folder with the schema.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia.llm.common import gathered, new_work_dir, table
from vacantia.llm.tokens import BYTE_BPE, END_ID, encoder

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 128 << 10
PAGE_ROWS = 256

_LAYOUT = {
    "compression": "zstd",
    "parquet.block.size": ROW_GROUP_BYTES,
    "parquet.page.size": PAGE_BYTES,
    "parquet.page.row.count.limit": PAGE_ROWS,
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.enable.dictionary#local_start": "false",
}


def write_tokens(docs: DataFrame, path: str, vocabulary: str = BYTE_BPE) -> None:
    """Encode every text and write part, doc_id, local_start, n_tokens, ids in doc_id order."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    arrow_ids = pa.list_(pa.int32())

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before = encoder(vocabulary).encode, 0
        end = np.array([END_ID], "<u4").tobytes()
        for part in gathered(batches, "text"):
            found = encode([t or "" for t in part.column("text").to_pylist()])
            sizes = np.fromiter((len(f) // 4 + 1 for f in found), np.int64, len(found))
            ends = np.cumsum(sizes)
            ids = np.frombuffer(end.join((*found, b"")), "<i4")
            offsets = np.concatenate(([0], ends)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("part"),
                    part.column("doc_id"),
                    pa.array(before + ends - sizes),
                    pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)).cast(arrow_ids),
                ],
                ["part", "doc_id", "local_start", "n_tokens", "ids"],
            )
            before += int(ends[-1])

    # Rows of one id are told apart by their texts, and equal ones by where they stand.
    ordered = (
        docs.select("doc_id", "text")
        .withColumn("tie", F.xxhash64("text"))
        .withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(parts, "doc_id", "tie", "row")
        .sortWithinPartitions("doc_id", "tie", "row")
        .select(F.spark_partition_id().alias("part"), "doc_id", "text")
    )
    schema = f"part int, doc_id {id_type}, local_start long, n_tokens long, ids array<int>"
    ordered.mapInArrow(encoded, schema).write.mode("error").options(**_LAYOUT).parquet(path)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, part_start: ids before each part. One row per part; only two narrow columns are read."""
    sums = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return sums.select("part", F.coalesce(before, F.lit(0)).cast("long").alias("part_start"))


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None):
    """doc_id, start, n_tokens, ids of documents with ids from ``low`` to ``high``, both included.

    The bounds reach the scan, which skips files, row groups and pages by their statistics.
    """
    rows = spark.read.parquet(path)
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") <= high)
    return rows.join(F.broadcast(part_starts(spark, path)), "part").select(
        "doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids"
    )


def with_checksums(rows: DataFrame) -> DataFrame:
    """Rows of ``read_tokens`` with ids_crc32, over the ids as little-endian 32-bit, for the ids."""
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            data = memoryview(ids.flatten().to_numpy().astype("<u4").tobytes())
            ends = np.cumsum(ids.value_lengths().to_numpy()).tolist()
            starts = [0, *ends[:-1]]
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "start", "n_tokens")], pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        sums, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long"
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_work_dir(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return with_checksums(read_tokens(spark, path))
