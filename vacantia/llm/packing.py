"""Best-fit packing of documents into sequences of a fixed number of tokens.

Bulk-synchronous best fit. Pieces are range-sorted by length on the executors and ranked within their
length; a superstep places all pieces of one length, from the longest down. In a superstep every
piece looks for its successor among the sorted gaps, the smallest that holds it; pieces that want the
same gap are told apart by rank, gaps shrink, and the sweep goes on until the length is placed. A gap
that a piece was put into stays the smallest one while it holds another piece of that length, so each
is filled with as many as it holds before the next. What finds no gap opens new sequences.

Pieces of equal length, and sequences with equal gaps, are interchangeable. So a sweep moves runs of
ranks over runs of sequences and not single rows: its state is one count per length and one list of
runs per gap, bounded by the sequence length whatever the corpus. A superstep splits at most one run
in three or opens at most two, so there are at most a few runs per length. The executors then look up, by
length and rank, which sequence and offset each piece got. The result is the one of best-fit
decreasing over single pieces.

Defined results: a null text is an empty one; an empty text is its end id alone. Only documents longer
than a sequence are cut, and their first piece takes what is left over. Repeated rows and repeated ids
are packed one by one. Columns other than doc_id and text are passed by. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia.llm.common import gathered, new_work_dir, table, written
from vacantia.llm.tokens import BYTE_BPE, END_ID, encoder

SEQUENCE = 2048


def cut(n_tokens: int, most: int = SEQUENCE) -> list[tuple[int, int]]:
    """start, length of a document's pieces; the first takes what is left over."""
    first = (n_tokens - 1) % most + 1
    starts = [0, *range(first, n_tokens, most)]
    return list(zip(starts, (first, *[most] * (len(starts) - 1)), strict=True))


def pieces(
    docs: DataFrame, path: str = BYTE_BPE, most: int = SEQUENCE, tokens: bool = True
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, tokens of every document."""
    end = np.array([END_ID], "<u4").tobytes()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for part in gathered(batches, "text"):
            found = encode([t or "" for t in part.column("text").to_pylist()])
            rows = []
            for n, ids in enumerate(found):
                ids += end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, most)):
                    rows.append((n, piece, start, length, ids[4 * start : 4 * (start + length)]))
            row, piece, start, length, data = zip(*rows, strict=True)
            columns = [
                part.column("doc_id").take(pa.array(row, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array([zlib.crc32(d) for d in data], pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if tokens:
                columns.append(pa.array(data, pa.binary()))
                names.append("tokens")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(
        encoded, schema + (", tokens binary" if tokens else "")
    )


class Gaps:
    """Open sequences by what they have left: runs of consecutive sequence numbers, sorted by gap."""

    def __init__(self, most: int):
        self.most = most
        self.opened = 0
        self._runs: dict[int, list[tuple[int, int]]] = {}
        self._sorted: list[int] = []

    def add(self, gap: int, first: int, count: int) -> None:
        if gap:
            if gap not in self._runs:
                insort(self._sorted, gap)
                self._runs[gap] = []
            self._runs[gap].append((first, count))

    def open(self, count: int) -> int:
        self.opened += count
        return self.opened - count

    def successor(self, length: int, wanted: int) -> tuple[int, int, int, int] | None:
        """Sequences of the smallest gap that holds ``length``: gap, pieces in each, first, count.

        They are filled as far as ``wanted`` pieces go, and take ``wanted`` of them at most.
        """
        at = bisect_left(self._sorted, length)
        if at == len(self._sorted):
            return None
        gap = self._sorted[at]
        runs = self._runs[gap]
        first, count = runs.pop()
        each = min(gap // length, wanted)
        taken = min(count, wanted // each)
        if taken < count:
            runs.append((first + taken, count - taken))
        elif not runs:
            del self._runs[gap], self._sorted[at]
        return gap, each, first, taken


def sweeps(lengths: dict[int, int], most: int = SEQUENCE) -> np.ndarray:
    """length, first rank, first sequence, pieces per sequence, offset: one row per run placed."""
    gaps, moves = Gaps(most), []
    for length in sorted(lengths, reverse=True):
        rank, left = 0, lengths[length]
        while left:
            found = gaps.successor(length, left)
            if found:
                gap, each, first, count = found
            else:
                gap, each = most, min(most // length, left)
                count = left // each
                first = gaps.open(count)
            moves.append((length, rank, first, each, most - gap))
            gaps.add(gap - each * length, first, count)
            rank, left = rank + count * each, left - count * each
    return np.array(moves, np.int64).reshape(-1, 5)


def _ranked(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``rows`` with their rank within their length: a range sort, and the counts before each part.

    The sort keys end in a unique one, so that a frequent length is spread over many parts.
    """
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = (
        rows.withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(parts, F.desc("length"), "doc_id", "piece", "row")
        .sortWithinPartitions(F.desc("length"), "doc_id", "piece", "row")
        .withColumn("part", F.spark_partition_id())
    )
    placed = written(ranged, new_work_dir(spark, "ranged"))
    counts = placed.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    within = F.row_number().over(
        Window.partitionBy("part", "length").orderBy("doc_id", "piece", "row")
    )
    return (
        placed.withColumn("within", within)
        .join(counts.select("part", "length", before.alias("before")), ["part", "length"])
        .withColumn("rank", F.col("before") + F.col("within") - 1)
        .drop("row", "part", "within", "before")
    )


def pack(spark: SparkSession, rows: DataFrame, most: int = SEQUENCE) -> DataFrame:
    """``rows`` (doc_id, piece, length and more) with sequence_id and offset.

    At most ``most`` rows, one per length, reach the driver.
    """
    counts = rows.groupBy("length").agg(F.count("*").alias("n")).collect()
    if any(not 0 < r["length"] <= most for r in counts):
        raise ValueError(f"lengths must be from 1 to {most}")
    moves = sweeps({r["length"]: r["n"] for r in counts}, most)
    order = np.lexsort((moves[:, 1], moves[:, 0]))
    moves = moves[order]
    place = moves[:, 0] << 48 | moves[:, 1]
    ranked = _ranked(spark, rows)
    names = ranked.drop("rank").columns
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            move = moves[np.searchsorted(place, length << 48 | rank, side="right") - 1]
            nth = rank - move[:, 1]
            sequence, within = move[:, 2] + nth // move[:, 3], nth % move[:, 3]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in names],
                    pa.array(sequence),
                    pa.array(move[:, 4] + within * length),
                ],
                [*names, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(looked_up, schema)


def packed_pieces(spark: SparkSession, docs: DataFrame, tokens: bool = True) -> DataFrame:
    """Every piece of every document with its place; tokens stay in a table that is joined last."""
    cut_up = written(pieces(docs, tokens=tokens), new_work_dir(spark, "pieces"))
    if not tokens:
        return pack(spark, cut_up)
    named = cut_up.withColumn("at", F.struct("_metadata.file_path", "_metadata.row_index"))
    placed = pack(spark, named.select("doc_id", "piece", "length", "at"))
    return named.drop("doc_id", "piece", "length").join(placed, "at").drop("at")


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, tokens (little-endian unsigned 32-bit ids), documents: one row per sequence.

    A group is one sequence, so at most ``SEQUENCE`` tokens.
    """
    ordered = F.sort_array(F.collect_list(F.struct("offset", "tokens", "doc_id", "piece")))
    joined = F.aggregate(
        "parts", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["tokens"])
    )
    return (
        placed.groupBy("sequence_id")
        .agg(ordered.alias("parts"))
        .select(
            "sequence_id",
            joined.alias("tokens"),
            F.transform(
                "parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"], p["offset"])
            ).alias("documents"),
        )
    )


_COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(spark, table(spark, sf_dir, "documents"), tokens=False).select(*_COLUMNS)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packed_pieces(spark, docs, tokens=False).select(*_COLUMNS)
