"""Periodic runs of words, by enumerating maximal pairs over a document's LCP-interval tree.

A run is a stretch of consecutive words with smallest period q and length of at least
max(MIN_LENGTH, 2 q) that neither neighbouring word extends. Its first two periods are a maximal pair:
places i and i + q with the same words for ``length - q`` places, with different words before them and
after them. Turned around, a maximal pair of length l whose places are p <= l apart spans i to
i + p + l, and nothing extends that stretch with period p: it needs no extension, and every run is found.
A run of several periods gives pairs at multiples of q, too; of the pairs with one start and one length
the least distance is the smallest period.

The words of a document are numbered, its suffixes sorted by prefix doubling, and the LCP-interval tree
is walked from the bottom up. An interval keeps its places in lists by the word to their left. Where two
children meet, the smaller one's places look for partners in the larger one: the occurrences of one
stretch within its own length form an arithmetic progression, so all partners to the right of a place
stand after one same word, and only the leftmost one on the left can stand after another. One look
in either direction therefore tells which list, if any, holds partners, and each partner is a pair found.

Pairs shorter than MIN_LENGTH / 2 belong to no run, so only suffixes that share their first words with
another one are sorted, and documents without any are passed by.

All work on a document is within its row; nothing is shuffled.

Defined results: a null or empty text, and one of white space, has no words and no runs, and collapses
to the empty string. Words are taken as bytes, so ill-formed text makes no difference. A very long text is
one row: a task needs about 100 bytes of memory per word of it. Repeated rows are each answered, null
ids too; other columns are passed by. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.common import slices, table, words

MIN_LENGTH = 12

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SCHEMA = "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary"


def _numbered(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all documents as numbers (equal words alike), and where each document starts."""
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    sizes = [len(d) for d in documents]
    ids = np.fromiter(
        map(numbers.__getitem__, chain.from_iterable(documents)), np.int64, sum(sizes)
    )
    return ids, np.concatenate(([0], np.cumsum(sizes)))


def repeating(ids: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Which documents may hold some stretch of ``size`` words twice (by hash: never too few)."""
    found = np.zeros(len(bounds) - 1, bool)
    n = len(ids) - size + 1
    if n <= 0:
        return found
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    key = doc[:n].astype(np.uint64)
    for k in range(size):
        key = (key ^ (key >> np.uint64(29))) * _MULTIPLIER + ids[k : k + n].astype(np.uint64)
    key = (key ^ (key >> np.uint64(32))) * _MULTIPLIER
    inside = doc[:n] == doc[size - 1 :]
    key, doc = key[inside], doc[:n][inside]
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    found[doc[order[1:][same]]] = True
    return found


def sorted_suffixes(ids: np.ndarray, least: int) -> np.ndarray:
    """Places of the suffixes that share ``least`` or more elements with another one (and of some that
    share fewer), in order.

    Prefix doubling over the places whose rank is not yet their own. ``ids`` must end in an element that
    occurs once, so that no suffix is the beginning of another one.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    new = np.ones(n, bool)
    new[1:] = ids[order[1:]] != ids[order[:-1]]
    starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = starts
    kept, at = order, np.arange(n)
    shared, chosen = np.zeros(n, bool), False
    span = 1
    while True:
        open_ = np.zeros(len(kept), bool)
        open_[1:] = rank[kept[1:]] == rank[kept[:-1]]
        open_[:-1] |= open_[1:]
        if 2 * span > least and not chosen:
            shared[at[open_]], chosen = True, True
        kept, at = kept[open_], at[open_]
        if not len(kept):
            break
        after = rank[kept + span]
        again = np.lexsort((after, rank[kept]))
        kept, after = kept[again], after[again]
        group = rank[kept]
        order[at] = kept
        new = np.ones(len(kept), bool)
        new[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        rank[kept] = np.maximum.accumulate(np.where(new, at, 0))
        span *= 2
    return order[shared]


def _common(ids: list[int], places: list[int], least: int) -> list[int]:
    """How many elements each suffix shares with the one before it in order.

    Taken in text order: what a suffix shares, less its distance, the next one shares at least, as long
    as that is enough for both partners of the next one to be among ``places``.
    """
    before = dict(zip(places[1:], places[:-1], strict=True))
    common = dict.fromkeys(places, 0)
    length, last = 0, 0
    for i in sorted(before):
        j = before[i]
        length = length - (i - last) if length - (i - last) >= least else 0
        while ids[i + length] == ids[j + length]:
            length += 1
        common[i], last = length, i
    return [common[i] for i in places]


class _Interval:
    """Places below a node of the tree: in order, and by the word to their left."""

    __slots__ = ("by_left", "places")

    def __init__(self, place: int, left: int):
        self.places = [place]
        self.by_left = {left: [place]}

    def joined(self, other: _Interval, depth: int, pairs: list) -> _Interval:
        """Both, and the pairs between them that are ``depth`` long and at most that far apart."""
        large, small = (self, other) if len(self.places) >= len(other.places) else (other, self)
        all_places = large.places
        for left, places in small.by_left.items():
            own = large.by_left.get(left, ())
            for place in places:
                at = bisect_right(all_places, place)
                if at < len(all_places) and all_places[at] <= place + depth:
                    # All partners to the right stand after one word: the first one's.
                    if not _holds(own, all_places[at]):
                        end = bisect_right(all_places, place + depth)
                        pairs.extend((place, p, depth) for p in all_places[at:end])
                first = bisect_left(all_places, place - depth)
                if first < at and not _holds(own, all_places[first]):
                    pairs.append((all_places[first], place, depth))
        for left, places in small.by_left.items():
            own = large.by_left.setdefault(left, [])
            for place in places:
                insort(own, place)
                insort(all_places, place)
        return large


def _holds(places: list[int] | tuple, place: int) -> bool:
    at = bisect_left(places, place)
    return at < len(places) and places[at] == place


def maximal_pairs(ids: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(i, j, length) of the maximal pairs of ``least`` or more elements at most ``length`` apart.

    ``ids`` holds stretches that each end in an element of their own; what stands before the first place
    differs from everything.
    """
    suffixes = sorted_suffixes(ids, least).tolist()
    if not suffixes:
        return []
    listed = ids.tolist()
    common = _common(listed, suffixes, least)
    common.append(0)
    pairs: list[tuple[int, int, int]] = []
    stack: list[tuple[int, _Interval]] = []
    child = _Interval(suffixes[0], listed[suffixes[0] - 1] if suffixes[0] else -1)
    for n in range(1, len(common)):
        depth = common[n]
        while stack and stack[-1][0] > depth:
            held_depth, held = stack.pop()
            child = held.joined(child, held_depth, pairs)
        if depth >= least:
            if stack and stack[-1][0] == depth:
                stack[-1] = (depth, stack[-1][1].joined(child, depth, pairs))
            else:
                stack.append((depth, child))
        if n < len(suffixes):
            place = suffixes[n]
            child = _Interval(place, listed[place - 1] if place else -1)
    return pairs


def runs_of(documents: list[list[bytes]], min_length: int = MIN_LENGTH) -> list[list[tuple]]:
    """(start, length, period) of each document's runs, by start, then period."""
    found: list[list[tuple]] = [[] for _ in documents]
    least = (min_length + 1) // 2
    ids, bounds = _numbered(documents)
    chosen = np.flatnonzero(repeating(ids, bounds, least))
    if not len(chosen):
        return found
    # The chosen documents one after another, an element of its own behind each of them.
    parts, starts, end = [], [], 0
    own = int(ids.max()) + 1
    for n, d in enumerate(chosen.tolist()):
        parts += [ids[bounds[d] : bounds[d + 1]], [own + n]]
        starts.append(end)
        end += int(bounds[d + 1] - bounds[d]) + 1
    least_period: dict[tuple[int, int], int] = {}
    for i, j, length in maximal_pairs(np.concatenate(parts), least):
        period = j - i
        if period + length >= min_length:
            key = (i, period + length)
            least_period[key] = min(period, least_period.get(key, period))
    for (start, length), period in least_period.items():
        n = bisect_right(starts, start) - 1
        found[int(chosen[n])].append((start - starts[n], length, period))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def collapsed(document: list[bytes], runs: list[tuple]) -> bytes:
    """The words outside every run, and of each run its first period, joined by single spaces."""
    if not runs:
        return b" ".join(document)
    edges = np.zeros(len(document) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
    return b" ".join([document[n] for n in kept.tolist()])


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([(f, pa.int64()) for f in ("start", "length", "period")])
    for part in slices(batches, "text"):
        documents = [(t or b"").split() for t in part.column("text").cast(pa.binary()).to_pylist()]
        found = runs_of(documents)
        flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
        structs = pa.StructArray.from_arrays(
            [pa.array(flat[:, n]) for n in range(3)], fields=list(kind)
        )
        ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        kept = pa.array(map(collapsed, documents, found), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.ListArray.from_arrays(ends, structs), kept],
            ["doc_id", "runs", "collapsed"],
        )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length, period), collapsed (text without the repeats) of each row."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        _answered, _SCHEMA
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text; a tenth of the texts repeat a stretch of their own words up to their end.

    With h = crc32 of the id's digits and g = h div 10, where h mod 10 is 0 each word i from a = g mod n on
    becomes word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w = words(F.col("text"))
    planted = F.array_join(
        F.transform(
            "w",
            lambda x, i: F.when(i < F.col("a"), x).otherwise(
                F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
            ),
        ),
        " ",
    )
    return (
        docs.select("doc_id", "text", h.alias("h"))
        .withColumn("w", F.when(F.col("h") % 10 == 0, w))
        .withColumn("n", F.size("w"))
        .withColumn("g", F.floor(F.col("h") / 10))
        .withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
        .withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
        .select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs(with_planted_runs(docs))
    longest = F.array_max(
        F.transform(
            "runs",
            lambda r: F.struct(
                r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less")
            ),
        )
    )
    lines = F.array_join(
        F.transform(
            "runs",
            lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")),
        ),
        "",
    )
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("longest.back")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.less")).alias("period"),
        F.expr("1000 * longest.length div -longest.less").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
