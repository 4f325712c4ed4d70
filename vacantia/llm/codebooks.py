"""Vector compression: a codebook per part of a vector, trained by k-means with norm-of-sum bounds.

Components become integers, vectors are cut into equal parts, and every part position has its codebook.
A round assigns each part to its codebook's nearest entry and moves each entry to the floor of its parts'
mean. All arithmetic that decides anything is on integers, so results do not depend on how rows are dealt.

Most distances need not be computed again. A vector keeps, for each part and each group of entries, a
lower bound on its distance to the group's other entries, and the round in which that was exact: the
stamp. All codebooks since the first are retained, so the bound is lowered by how far the group's entries
lie now from where they lay in the stamped round: the norm of the sum of their moves, not the sum of the
moves' norms. Only groups whose bound no longer clears the exact distance to the assigned entry are
scanned again, exactly; then the bound gets the new round's stamp.

What a round keeps of each vector (integers, assignments, bounds, stamps) is a table in the shared folder,
written together with the sums of each task, at most parts x entries rows of them. The driver holds the
codebooks: entries x dimension integers a round, however many vectors there are.

Defined results: vectors that are null, empty, or hold a null, NaN or infinity are dropped; those that are
left must have one dimension, a multiple of ``parts``, and components below 2**27 / scale, or it is a
ValueError. Null ids count as larger than all others and ties between equal ids go to the smaller vector,
when the first entries are chosen; fewer vectors than ``entries`` make as many entries. Repeated rows stay.
Columns other than vec_id, embedding and label are passed by. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.common import new_work_dir, table, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Entries of a codebook whose bound is kept together.
GROUP = 64
#: Rows that are worked on together.
ROWS = 4_096

#: Products of so small numbers, summed over a part, are exact in floating point.
_EXACT = 1 << 22
_LARGEST = 1 << 27
#: Bounds are stored a little lower than computed, so that rounding cannot make them too large.
_SAFE = 1e-6

Codebook = np.ndarray  # parts x entries x components of a part, int64


def kept_vectors(vectors: DataFrame, label: bool = True) -> DataFrame:
    """vec_id, embedding, label of the rows that take part."""
    e = F.col("embedding")
    whole = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    columns = ["vec_id", "embedding", "label" if label else F.lit(None).cast("int").alias("label")]
    return vectors.select(*columns).where(e.isNotNull() & (F.size(e) > 0) & whole)


def _integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(vectors.astype(np.float64) * scale).astype(np.int64)


def _first_entries(vectors: DataFrame, parts: int, entries: int, scale: int) -> Codebook:
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries)
    found = _integers(np.array([r.embedding for r in rows.select("embedding").collect()]), scale)
    return found.reshape(len(found), parts, -1).transpose(1, 0, 2).copy()


def _distances(x: np.ndarray, entries: np.ndarray, exact: bool) -> np.ndarray:
    """Squared distances of rows to entries: whole numbers, in floating point where that is exact."""
    kind = np.float64 if exact else np.int64
    x, entries = x.astype(kind), entries.astype(kind)
    return (x * x).sum(1)[:, None] + (entries * entries).sum(1) - 2 * (x @ entries.T)


class Assigner:
    """Nearest entries of one part position, given all codebooks up to now."""

    def __init__(self, history: list[np.ndarray], exact: bool, group: int = GROUP):
        self.now = history[-1]
        self.round = len(history) - 1
        self.exact = exact
        self.starts = list(range(0, len(self.now), group))
        self.size = group
        moves = [np.sqrt(((h - self.now).astype(np.float64) ** 2).sum(1)) for h in history]
        #: By stamp and group: how far the group's farthest-moved entry is from where it was.
        self.moved = np.array(
            [[m[s : s + group].max() for s in self.starts] for m in moves]
        ) * (1 + _SAFE)

    def to_entry(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return ((x - self.now[entry]) ** 2).sum(1)

    def assign(
        self, x: np.ndarray, entry: np.ndarray | None, low: np.ndarray, stamp: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, int]:
        """Entry and squared distance of each row, and how many groups were scanned; ``low`` and
        ``stamp`` (rows x groups) are brought up to date. Without entries every group is scanned."""
        n, groups = len(x), len(self.starts)
        rows = np.arange(n)
        if entry is None:
            scan = np.ones((n, groups), bool)
            best = np.full(n, -1)
            distance = np.full(n, np.iinfo(np.int64).max)
        else:
            best, distance = entry.copy(), self.to_entry(x, entry)
            bound = low - self.moved[stamp, np.arange(groups)]
            scan = bound <= (np.sqrt(distance.astype(np.float64)) * (1 + _SAFE))[:, None]
        left, left_distance = best.copy(), distance.copy()
        seen: list[tuple] = []
        for g, start in enumerate(self.starts):
            which = rows if scan[:, g].all() else np.flatnonzero(scan[:, g])
            if not len(which):
                continue
            d = _distances(x[which], self.now[start : start + self.size], self.exact)
            at = np.arange(len(which))
            first = d.argmin(1)
            least = d[at, first].astype(np.int64)
            d[at, first] = np.iinfo(np.int64).max
            second = d.min(1)
            first += start
            closer = (least < distance[which]) | (
                (least == distance[which]) & (first < best[which])
            )
            best[which[closer]] = first[closer]
            distance[which[closer]] = least[closer]
            seen.append((g, which, first, least, second))
        for g, which, first, least, second in seen:
            # The bound is on all entries but the assigned one.
            others = np.where(best[which] == first, second, least).astype(np.float64)
            low[which, g] = np.sqrt(others) * (1 - _SAFE)
            stamp[which, g] = self.round
        if entry is not None:
            # An entry that was left joins the others of its group.
            was = left // self.size
            gone = np.flatnonzero((best != left) & ~scan[rows, was])
            g = was[gone]
            low[gone, g] = np.minimum(
                low[gone, g] - self.moved[stamp[gone, g], g],
                np.sqrt(left_distance[gone].astype(np.float64)),
            ) * (1 - np.sign(low[gone, g]) * _SAFE)
            stamp[gone, g] = self.round
        return best, distance, int(scan.sum())


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _bytes_of(column: pa.Array, kind: str) -> np.ndarray:
    """A binary column of equally long values as a matrix."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1]
    values = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return values.reshape(len(column), -1).view(kind).copy()


def _as_binary(matrix: np.ndarray) -> pa.Array:
    matrix = np.ascontiguousarray(matrix).view(np.uint8).reshape(len(matrix), -1)
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.Array.from_buffers(
        pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix)]
    )


_STATE = (
    "vec_id bigint, label {label}, integers binary, entry binary, low binary, stamp binary, "
    "slot int, sums array<bigint>"
)
_NAMES = ["vec_id", "label", "integers", "entry", "low", "stamp", "slot", "sums"]


def _sums_batch(sums: np.ndarray, label: pa.DataType) -> pa.RecordBatch:
    """A row per entry that has parts: its number among all parts' entries, their sums and count."""
    slots = np.flatnonzero(sums[:, -1])
    values = sums[slots]
    lists = pa.ListArray.from_arrays(
        pa.array(np.arange(len(slots) + 1) * values.shape[1], pa.int32()), pa.array(values.reshape(-1))
    )
    empty = [pa.nulls(len(slots), t) for t in (pa.int64(), label, *[pa.binary()] * 4)]
    return pa.RecordBatch.from_arrays([*empty, pa.array(slots, pa.int32()), lists], _NAMES)


def _round(history: list[Codebook], kind: str, exact: bool, scale: int):
    """What a task does in a round: rows with their new state, then the task's sums."""
    parts, entries, width = history[-1].shape

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigners = [Assigner([h[p] for h in history], exact) for p in range(parts)]
        groups = len(assigners[0].starts)
        sums = np.zeros((parts, entries, width + 1), np.int64)
        label = None
        for batch in _together(batches):
            if not batch.num_rows:
                continue
            n, label = batch.num_rows, batch.column("label").type
            if len(history) == 1:
                flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
                x = _integers(flat, scale).reshape(n, parts, width)
                entry = None
                low = np.zeros((n, parts, groups), np.float64)
                stamp = np.zeros((n, parts, groups), np.uint8)
            else:
                x = _bytes_of(batch.column("integers"), kind).astype(np.int64).reshape(n, parts, width)
                entry = _bytes_of(batch.column("entry"), "u1").astype(np.int64)
                low = _bytes_of(batch.column("low"), "<f4").astype(np.float64).reshape(n, parts, groups)
                stamp = _bytes_of(batch.column("stamp"), "u1").reshape(n, parts, groups)
            now = np.empty((n, parts), np.int64)
            for p, assigner in enumerate(assigners):
                own = x[:, p]
                was = None if entry is None else entry[:, p]
                now[:, p], _, _ = assigner.assign(own, was, low[:, p], stamp[:, p])
                sums[p, :, -1] += np.bincount(now[:, p], minlength=entries)
                for c in range(width):
                    if exact:
                        added = np.bincount(now[:, p], own[:, c], entries).astype(np.int64)
                    else:
                        added = np.zeros(entries, np.int64)
                        np.add.at(added, now[:, p], own[:, c])
                    sums[p, :, c] += added
            low32 = low.astype("<f4")
            low32 = np.where(low32 > low, np.nextafter(low32, np.float32(-np.inf)), low32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("label"),
                    _as_binary(x.reshape(n, -1).astype(kind)),
                    _as_binary(now.astype("u1")),
                    _as_binary(low32.astype("<f4").reshape(n, -1)),
                    _as_binary(stamp.reshape(n, -1)),
                    pa.nulls(n, pa.int32()),
                    pa.nulls(n, pa.list_(pa.int64())),
                ],
                _NAMES,
            )
        if label is not None:
            yield _sums_batch(sums.reshape(parts * entries, width + 1), label)

    return assigned


def _moved(state: DataFrame, codebook: Codebook) -> Codebook:
    """The codebook after a round: floors of means; entries without parts stay."""
    parts, entries, width = codebook.shape
    totals = (
        state.where("slot is not null")
        .select("slot", F.posexplode("sums").alias("place", "value"))
        .groupBy("slot", "place")
        .agg(F.sum("value").alias("total"))
    )
    sums = np.zeros((parts * entries, width + 1), np.int64)
    for slot, place, total in totals.collect():  # at most parts x entries x (width + 1) rows
        sums[slot, place] = total
    counts = sums[:, -1:]
    means = np.floor_divide(sums[:, :-1], np.maximum(counts, 1))
    return np.where(counts > 0, means, codebook.reshape(-1, width)).reshape(codebook.shape)


def _coded(history: list[Codebook], kind: str, exact: bool):
    parts, _, width = history[-1].shape

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigners = [Assigner([h[p] for h in history], exact) for p in range(parts)]
        groups = len(assigners[0].starts)
        for batch in _together(batches):
            n = batch.num_rows
            if not n:
                continue
            x = _bytes_of(batch.column("integers"), kind).astype(np.int64).reshape(n, parts, width)
            entry = _bytes_of(batch.column("entry"), "u1").astype(np.int64)
            low = _bytes_of(batch.column("low"), "<f4").astype(np.float64).reshape(n, parts, groups)
            stamp = _bytes_of(batch.column("stamp"), "u1").reshape(n, parts, groups)
            error = np.zeros(n, np.int64)
            for p, assigner in enumerate(assigners):
                entry[:, p], distance, _ = assigner.assign(
                    x[:, p], entry[:, p], low[:, p], stamp[:, p]
                )
                error += distance
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("label"),
                    _as_binary(entry.astype("u1")),
                    pa.array(error),
                ],
                ["vec_id", "label", "code", "error"],
            )

    return coded


def compressed(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, Codebook]:
    """vec_id, label, code (a byte per part), error (squared distance) of every kept vector, and the
    codebooks. ``entries`` is at most 256, ``rounds`` at most 255."""
    if not (0 < entries <= 256 and 0 < rounds <= 255):
        raise ValueError("a code byte tells 256 entries apart, a stamp 256 rounds")
    spark = vectors.sparkSession
    used = kept_vectors(vectors, "label" in vectors.columns).withColumn(
        "vec_id", F.col("vec_id").cast("bigint")
    )
    label = used.schema["label"].dataType.simpleString()
    e = F.col("embedding")
    count, least, most, largest = used.agg(
        F.count("*"),
        F.min(F.size(e)),
        F.max(F.size(e)),
        F.max(F.array_max(F.transform(e, lambda x: F.abs(x.cast("double"))))),
    ).first()
    codes = f"vec_id bigint, label {label}, code binary, error bigint"
    if not count:
        return spark.createDataFrame([], codes), np.zeros((parts, 0, 0), np.int64)
    if least != most or most % parts:
        raise ValueError(f"dimensions from {least} to {most}, to be cut into {parts} equal parts")
    largest = int(largest * scale) + 1
    if largest > _LARGEST:
        raise ValueError(f"components of up to {largest} times the scale: distances would overflow")
    kind = "<i2" if largest < 1 << 15 else "<i4"
    exact = largest * largest * (most // parts) * 4 < 1 << 52 and largest < _EXACT
    history = [_first_entries(used, parts, entries, scale)]
    state = used
    for _ in range(rounds):
        task = _round(history, kind, exact, scale)
        state = written(
            state.mapInArrow(task, _STATE.format(label=label)), new_work_dir(spark, "vectors")
        )
        history.append(_moved(state, history[-1]))
        state = state.where("slot is null")
    return state.mapInArrow(_coded(history, kind, exact), codes), history[-1]


def decoded(codes: DataFrame, codebooks: Codebook, scale: int = SCALE) -> DataFrame:
    """vec_id, embedding: the vectors that the codes stand for."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = _bytes_of(batch.column("code"), "u1")
            found = np.concatenate(
                [codebooks[p][code[:, p]] for p in range(code.shape[1])], axis=1
            ) / float(scale)
            ends = pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.ListArray.from_arrays(ends, pa.array(found.reshape(-1)))],
                ["vec_id", "embedding"],
            )

    return codes.select("vec_id", "code").mapInArrow(entries, "vec_id bigint, embedding array<double>")


def codebook_digest(codebooks: Codebook) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def with_label_error(spark: SparkSession, codes: DataFrame) -> DataFrame:
    """``codes`` with the error summed over each row's label, null being a label as well.

    Sums are taken in every task first. The table of sums is written, so that its size is known: Spark
    broadcasts it where it is small, and else splits the partitions of frequent labels.
    """
    codes = written(codes, new_work_dir(spark, "codes"))
    sums = written(
        codes.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")),
        new_work_dir(spark, "label-errors"),
    )
    same: Column = F.col("label").eqNullSafe(F.col("of_label"))
    return codes.join(sums, same, "left").drop("of_label")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, codebooks = compressed(table(spark, sf_dir, "embeddings"))
    return with_label_error(spark, codes).select(
        "vec_id",
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.lit(codebook_digest(codebooks)).alias("codebooks_sha256"),
    )
