"""Near-duplicates by ProbMinHash over weighted five-word shingles, banding and exact verification.

A document is a set of shingles (five lower-case words each) weighted by how often they occur. Each
shingle is a Poisson process whose rate is its share of the document; its arrivals fall into
registers, and a register keeps the shingle that arrives first. Two documents agree in a register
with the probability of their probability Jaccard similarity. A shingle is given up as soon as its
next arrival is later than every register's first one.

Equal texts (after lower-casing and collapsing white space) are one node, however many copies there
are. Nodes that agree in a whole band of registers are candidates. No bucket is capped and none is
expanded into all its pairs at once:

1. in each bucket every node is compared with the bucket's first node, exactly, on whole texts;
2. confirmed links are joined to components; a bucket that then lies inside one component is done;
3. in the others, nodes of different components are compared with each other, which leaves no pair
   of a bucket undecided: it is either compared or already in one class.

A class is a connected component of links with similarity of at least THRESHOLD; its id is the
smallest doc_id in it.

Defined results: documents without a word (null, empty, white space) are classes of their own; a text
of one to four words has itself as its only shingle. A null doc_id never names a class that has
another id. Repeated rows stay, with the same class. Columns other than doc_id and text are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia.llm.common import new_work_dir, slices, table, words, written

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 40
ROWS = 10
#: Nodes on either side of a task that compares those of different components.
BLOCK = 256
#: Places of a bitmap of hashed keys, whatever the corpus; 2**15 of them are one row of 4 KB.
PLACES = 1 << 26
#: Rows (a hash each) that leave are broadcast up to so many.
MOST_BROADCAST = 250_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.uint64(0xD1B54A32D192ED03)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (splitmix64's finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's distinct word shingles and how often each occurs."""
    found = text.split()
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    digest = xxhash.xxh3_64_intdigest
    hashed = np.fromiter(map(digest, found), np.uint64, len(found))
    n = max(1, len(hashed) - size + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(min(size, len(hashed))):
        rolled = _mixed(rolled * _MULTIPLIER + hashed[k : k + n])
    return np.unique(rolled, return_counts=True)


def signatures(
    documents: list[tuple[np.ndarray, np.ndarray]], registers: int
) -> np.ndarray:
    """The element that arrives first in each register, one row per document.

    All documents' elements take their next arrival together; those whose arrival is later than every
    first one of their document are given up, and few rounds have more than a few left.
    """
    first = np.full((len(documents), registers), np.inf)
    winner = np.zeros(len(documents) * registers, np.uint64)
    sizes = [len(e) for e, _ in documents]
    doc = np.repeat(np.arange(len(documents)), sizes)
    alive = np.concatenate([e for e, _ in documents])
    rate = np.concatenate([w / w.sum() for _, w in documents])
    state, clock, latest = alive, np.zeros(len(alive)), np.full(len(documents), np.inf)
    while len(alive):
        state = _mixed(state + _MULTIPLIER)
        uniform = ((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        clock = clock - np.log(uniform) / rate
        soon = clock < latest[doc]
        if not soon.all():
            state, clock, alive = state[soon], clock[soon], alive[soon]
            rate, doc = rate[soon], doc[soon]
            if not len(alive):
                break
        at = (_mixed(state ^ _SALT) % np.uint64(registers)).astype(np.int64) + doc * registers
        np.minimum.at(first.reshape(-1), at, clock)
        won = clock == first.reshape(-1)[at]
        winner[at[won]] = alive[won]
        open_docs = doc[np.concatenate(([True], doc[1:] != doc[:-1]))]
        latest[open_docs] = first[open_docs].max(axis=1)
    return winner.reshape(len(documents), registers)


def probability_jaccard(
    x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]
) -> float:
    """Sum over shared elements i of 1 / sum_j max(x_j / x_i, y_j / y_i), by one sort."""
    if not len(x[0]) or not len(y[0]):
        return 0.0
    shared, at_x, at_y = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    px, py = x[1] / x[1].sum(), y[1] / y[1].sum()
    own_x, own_y = px[at_x], py[at_y]
    only_x, only_y = max(0.0, 1.0 - own_x.sum()), max(0.0, 1.0 - own_y.sum())
    order = np.argsort(own_y / own_x, kind="stable")
    own_x, own_y = own_x[order], own_y[order]
    up_to = only_x + np.cumsum(own_x)
    beyond = only_y + (own_y.sum() - np.cumsum(own_y))
    return float((1.0 / (up_to / own_x + beyond / own_y)).sum())


def normal_text(text: Column) -> Column:
    return F.array_join(words(F.lower(text)), " ")


def _key(normal: Column) -> Column:
    return F.unhex(F.md5(normal.cast("binary")))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    band_no = np.arange(BANDS, dtype=np.uint64)
    seen: set[bytes] = set()
    for part in slices(batches, "normal"):
        # Equal texts of a task are one node already here.
        new = [k not in seen and not seen.add(k) for k in part.column("key").to_pylist()]
        part = part.filter(pa.array(new, pa.bool_()))
        if not part.num_rows:
            continue
        found = [
            shingles(t.encode("utf-8", "replace")) for t in part.column("normal").to_pylist()
        ]
        winners = signatures(found, BANDS * ROWS).reshape(len(found), BANDS, ROWS)
        bucket = np.broadcast_to(_mixed(band_no + _SALT), (len(found), BANDS))
        for k in range(ROWS):
            bucket = _mixed(bucket * _MULTIPLIER + winners[:, :, k])
        values = pa.array(bucket.reshape(-1).view(np.int64))
        ends = pa.array(np.arange(len(found) + 1) * BANDS, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [part.column("key"), pa.ListArray.from_arrays(ends, values)], ["key", "buckets"]
        )


def _perhaps_in(rows: DataFrame, key: str, some: DataFrame) -> DataFrame:
    """``rows`` with ``perhaps``: false only where ``key`` is in no row of ``some``.

    A bitmap of the hashed keys of ``some`` is broadcast, at most PLACES / 8 bytes. What it rules out
    need not be moved by a join; an exact join decides on the rest.
    """
    place = F.pmod(F.xxhash64(key), F.lit(PLACES))
    block, bit = F.shiftright(place, 15), place.bitwiseAND(F.lit((1 << 15) - 1))
    bitmaps = (
        some.select(block.alias("block"), bit.alias("bit"))
        .repartition("block")
        .groupBy("block")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    byte = F.substring("bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))
    is_set = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), bit.bitwiseAND(F.lit(7)).cast("int"))
    return (
        rows.withColumn("block", block)
        .join(F.broadcast(bitmaps), "block", "left")
        .withColumn("perhaps", F.coalesce(is_set == 1, F.lit(False)))
        .drop("block", "bits")
    )


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b of the pairs whose texts are similar enough, compared exactly on whole texts."""
    texts = texts.hint("merge")
    with_texts = pairs.join(
        texts.select(F.col("key").alias("a"), F.col("normal").alias("text_a")), "a"
    ).join(texts.select(F.col("key").alias("b"), F.col("normal").alias("text_b")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held_text, held = None, None
            keep = []
            both = zip(*(batch.column(c).to_pylist() for c in ("text_a", "text_b")), strict=True)
            for left, right in both:
                if left != held_text:
                    held_text, held = left, shingles(left.encode("utf-8", "replace"))
                other = shingles(right.encode("utf-8", "replace"))
                keep.append(probability_jaccard(held, other) >= THRESHOLD - 1e-12)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")], ["a", "b"]
            ).filter(pa.array(keep, pa.bool_()))

    return with_texts.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a binary, b binary")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """key, root (its component's smallest key) of every key that has a link.

    Alternating stars: each step points a key's neighbours at the smallest one, by a grouped minimum
    and a join, until nothing moves. Every step is a table in the shared folder.
    """
    small = F.least("a", "b").alias("root"), F.greatest("a", "b").alias("key")
    stars = written(
        links.where("a <> b").select(*small).distinct(), new_work_dir(spark, "links")
    )
    seen = None
    while True:
        both = stars.unionByName(stars.select(F.col("key").alias("root"), F.col("root").alias("key")))
        least = both.groupBy("key").agg(F.least(F.min("root"), F.col("key")).alias("least"))
        large = (
            both.join(least, "key")
            .where(F.col("root") > F.col("key"))
            .select(F.col("least").alias("root"), F.col("root").alias("key"))
            .distinct()
        )
        least = large.groupBy("key").agg(F.min("root").alias("least"))
        moved = large.join(least, "key")
        stars = written(
            moved.select(F.col("least").alias("root"), F.col("root").alias("key"))
            .unionByName(least.select(F.col("least").alias("root"), "key"))
            .where(F.col("root") < F.col("key"))
            .distinct(),
            new_work_dir(spark, "stars"),
        )
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("root", "key").cast("decimal(38,0)"))).first()
        if now == seen:
            return stars.select("key", "root")
        seen = now


def _links_apart(buckets: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b of similar nodes in a common bucket whose components differ.

    In a bucket of several components each node outside its largest one meets every node of another
    component. Both sides are dealt into blocks of about BLOCK nodes, a task holds one block of each,
    and only links leave it: the pairs themselves are never rows.
    """
    known = buckets.join(roots, "key", "left").select(
        "bucket", "key", F.coalesce("root", "key").alias("root")
    )
    sizes = known.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    mixed = (
        sizes.groupBy("bucket")
        .agg(
            F.count("*").alias("roots"),
            F.sum("n").alias("n"),
            F.max(F.struct("n", "root")).alias("major"),
        )
        .where("roots > 1")
        .select(
            "bucket",
            F.col("major.root").alias("major"),
            F.ceil(F.col("n") / BLOCK).cast("int").alias("row_blocks"),
            F.ceil((F.col("n") - F.col("major.n")) / BLOCK).cast("int").alias("minor_blocks"),
        )
    )
    placed = known.join(mixed, "bucket").withColumn("minor", F.col("root") != F.col("major"))
    hashed = F.xxhash64("key")

    def side(rows: DataFrame, number: int, row_block: Column, minor_block: Column) -> DataFrame:
        with_rows = rows.withColumn("row_block", row_block)
        return with_rows.withColumn("minor_block", minor_block).select(
            "bucket", "row_block", "minor_block", F.lit(number).alias("side"), "key", "root", "minor"
        )

    def own(blocks: str) -> Column:
        return F.pmod(hashed, F.col(blocks)).cast("int")

    def each(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    left = side(placed, 0, own("row_blocks"), each("minor_blocks"))
    right = side(placed.where("minor"), 1, each("row_blocks"), own("minor_blocks"))
    group = ["bucket", "row_block", "minor_block"]
    dealt = left.unionByName(right).join(texts.hint("merge"), "key").repartition(*group)
    return dealt.sortWithinPartitions(*group, "side").mapInArrow(_compare, "a binary, b binary")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each group of rows; the groups follow each other, rows of side 0 first."""
    held: tuple[list[tuple], list[tuple]] = [], []
    now = None
    for batch in batches:
        names = ("bucket", "row_block", "minor_block", "side", "key", "root", "minor", "normal")
        for *group, side, key, root, minor, text in zip(
            *(batch.column(c).to_pylist() for c in names), strict=True
        ):
            if group != now:
                yield _links(*held)
                held, now = ([], []), group
            held[side].append((key, root, minor, *shingles(text.encode("utf-8", "replace"))))
    yield _links(*held)


def _links(rows: list[tuple], minors: list[tuple]) -> pa.RecordBatch:
    found: list[tuple[bytes, bytes]] = []
    if rows and minors:
        elements = np.concatenate([r[3] for r in rows])
        shares = np.concatenate([r[4] / r[4].sum() for r in rows])
        of = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])
        for key, root, _, own, counts in minors:
            place = np.minimum(np.searchsorted(own, elements), len(own) - 1)
            same = own[place] == elements
            least = np.minimum(shares[same], (counts / counts.sum())[place[same]])
            # Shares in common bound the similarity from above.
            for n in np.flatnonzero(np.bincount(of[same], least) >= THRESHOLD - 1e-9):
                other, other_root, other_minor, *sketch = rows[n]
                if other_root == root or (other_minor and other >= key):
                    continue
                if probability_jaccard(tuple(sketch), (own, counts)) >= THRESHOLD - 1e-12:
                    found.append((other, key))
    return pa.RecordBatch.from_arrays(
        [pa.array([f[n] for f in found], pa.binary()) for n in range(2)], ["a", "b"]
    )


def _roots(spark: SparkSession, normal: DataFrame) -> DataFrame:
    """key, root of every node of ``normal`` (key, normal) that is linked to another."""
    has_words = normal.where(F.col("normal") != "")
    sketched = (
        has_words.select("key", "normal")
        .mapInArrow(_bands, "key binary, buckets array<long>")
        .select("key", F.explode("buckets").alias("bucket"))
    )
    # One shuffle by bucket: its smallest key leads, and a bucket of one node leaves no row.
    by_key = Window.partitionBy("bucket").orderBy("key")
    leader = F.first("key").over(by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    led = written(
        sketched.withColumn("leader", leader).where("key <> leader").distinct(),
        new_work_dir(spark, "led"),
    )
    leaders = led.select("bucket", F.col("leader").alias("key")).distinct()
    shared = led.select("bucket", "key").unionByName(leaders)
    met = written(shared.select("key").distinct(), new_work_dir(spark, "met"))
    # Texts that met no other stay where they are.
    texts = written(
        _perhaps_in(has_words.select("key", "normal"), "key", met)
        .where("perhaps")
        .join(met.hint("merge"), "key", "left_semi")
        .groupBy("key")
        .agg(F.first("normal").alias("normal")),
        new_work_dir(spark, "texts"),
    )
    to_leader = led.select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct()
    links = written(_verified(to_leader, texts), new_work_dir(spark, "near"))
    roots = components(spark, links)
    more = written(
        _links_apart(shared, roots, texts).distinct(),
        new_work_dir(spark, "near"),
    )
    if not more.isEmpty():
        roots = components(
            spark, more.unionByName(roots.select(F.col("root").alias("a"), F.col("key").alias("b")))
        )
    return roots


def classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, class_id for every row of ``docs`` (doc_id, text)."""
    normal = docs.select("doc_id", normal_text(F.col("text")).alias("normal")).withColumn(
        "key", _key(F.col("normal"))
    )
    roots = _roots(spark, normal)
    members = normal.select(
        "doc_id", F.when(F.col("normal") != "", F.col("key")).alias("key")
    )
    named = (
        members.join(roots, "key", "left")
        .select("doc_id", F.coalesce("root", "key").alias("root"))
    )
    ids = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return named.join(ids, "root", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id")
    )


def op1_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays: the one with the smallest id, then by hashes of text and row. Different
    texts with one id are in classes of their own; rows without an id cannot be named and stay.

    Who stays is decided on hashes. Texts move in one join at most, against the rows that leave: in none
    where these are few enough to be broadcast, else only those that a bitmap of them does not rule out.
    """
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    row = F.unhex(F.md5(F.to_json(F.struct(*rows.columns))))
    with_id = rows.where("doc_id is not null").withColumn("row", row)
    normal = normal_text(F.col("text"))
    nodes = with_id.select(normal.alias("normal")).withColumn("key", _key(F.col("normal")))
    # Rows equal in all columns are one from here on.
    distinct = (
        with_id.select("doc_id", "row", F.when(normal != "", _key(normal)).alias("key"))
        .groupBy("row")
        .agg(F.first("doc_id").alias("doc_id"), F.first("key").alias("key"), F.count("*").alias("n"))
    )
    classed = written(
        written(distinct, new_work_dir(spark, "rows"))
        .join(_roots(spark, nodes), "key", "left")
        .withColumn("root", F.coalesce("root", "key")),
        new_work_dir(spark, "classed"),
    )
    # Texts without a word are classes of their own, by id.
    alone = F.when(F.col("root").isNull(), F.col("doc_id")).alias("alone")
    firsts = (
        classed.groupBy("root", alone)
        .agg(F.min(F.struct("doc_id", "key", "row")).alias("first"))
        .select("first.row")
    )
    repeated = written(
        classed.where("n > 1").join(firsts, "row", "left_semi").select("row"),
        new_work_dir(spark, "repeated"),
    )
    away = written(
        classed.join(firsts, "row", "left_anti").select("row").unionByName(repeated),
        new_work_dir(spark, "away"),
    )
    if away.count() <= MOST_BROADCAST:
        kept = with_id.join(F.broadcast(away), "row", "left_anti")
    else:
        asked = _perhaps_in(with_id, "row", away)
        kept = asked.where(~F.col("perhaps")).unionByName(
            asked.where("perhaps").join(away.hint("merge"), "row", "left_anti")
        )
    if not repeated.isEmpty():
        once = _perhaps_in(with_id, "row", repeated).where("perhaps")
        once = once.join(repeated.hint("merge"), "row", "left_semi").dropDuplicates(["row"])
        kept = kept.select(*rows.columns).unionByName(once.select(*rows.columns))
    return kept.select(*rows.columns).unionByName(rows.where("doc_id is null"))
