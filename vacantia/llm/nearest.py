"""Approximate nearest neighbours by cross-polytope hashing.

A vector is scaled to a unit vector (vectors shorter than the longest get one more component, so that
the largest inner product is the smallest angle), rotated by three rounds of random signs and a fast
Hadamard transform, and hashed to the signed axis nearest to it. Each of TABLES tables has rotations
of its own and joins ``hashes`` such axes to a bucket; their number grows with the logarithm of the
row count, so that buckets keep their size. A query looks into the buckets that its rotated vector
comes closest to. How many per table is fitted on a bounded sample (SAMPLE rows, the smallest hashes)
until the share of true neighbours found reaches TARGET; every row is indexed. Where MOST_PROBES do
not reach it there are twice as many tables, then four times, then one axis less to a bucket; what no
such index reaches is answered by one table of which every bucket is visited, which is exact.

Equal vectors are hashed once and keep the ids that a result can name. A bucket of more than BLOCK
vectors or queries is split into blocks, and every block of queries meets every block of vectors, so no bucket is capped and none is
one task's load. Scores are exact inner products of the original vectors in double precision, summed
in the same way wherever a pair meets. A query that found fewer neighbours than there are visits all
rows, in blocks.

Defined results: vectors that are null, zero, or hold a null or a component that is not finite take no
part, nor do rows without an id, nor vectors of another length than most rows have (the shorter, if
two are as frequent). A row is no candidate of its own id, however often that is repeated; a repeated
id is one candidate with its best score. Ties go to the smaller id. Extra columns are passed by; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia.llm.common import new_work_dir, table, written

TABLES = 24
NEIGHBOURS = 20
BLOCK = 4_096
#: Vectors a bucket should hold on average.
BUCKET = 400
SAMPLE = 20_000
SAMPLE_QUERIES = 256
TARGET = 0.96
MOST_PROBES = 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    width, step = x.shape[1], 1
    x = x.copy()
    while step < width:
        pairs = x.reshape(len(x), width // (2 * step), 2, step)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2)
        x = x.reshape(len(x), width)
        step *= 2
    return x / np.sqrt(width)


class Rotations:
    """Unit vectors, and their pseudo-rotations by table and hash."""

    def __init__(self, size: int, longest: float, hashes: int, tables: int = TABLES):
        self.size, self.longest, self.hashes, self.tables = size, longest, hashes, tables
        self.width = 1 << max(1, size).bit_length()
        rng = np.random.default_rng(7)
        self.signs = rng.choice((-1.0, 1.0), (tables, hashes, 3, self.width))

    def units(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Padded unit vectors; a row's spare component takes up what it lacks in length."""
        out = np.zeros((len(vectors), self.width))
        scale = np.linalg.norm(vectors, axis=1) if query else np.full(len(vectors), self.longest)
        out[:, : self.size] = vectors / scale[:, None]
        if not query:
            lacking = 1.0 - (out[:, : self.size] ** 2).sum(axis=1)
            out[:, self.size] = np.sqrt(np.where(lacking > 1e-9, lacking, 0.0))
        return out

    def rotated(self, units: np.ndarray, table: int, part: int) -> np.ndarray:
        for signs in self.signs[table, part]:
            units = hadamard(units * signs)
        return units

    def buckets(self, units: np.ndarray, table: int) -> np.ndarray:
        """The bucket of each unit vector in a table."""
        out = np.zeros(len(units), np.int64)
        for part in range(self.hashes):
            turned = self.rotated(units, table, part)
            axis = np.abs(turned).argmax(axis=1)
            negative = turned[np.arange(len(units)), axis] < 0
            out = out * (2 * self.width) + axis * 2 + negative
        return out

    def probes(self, units: np.ndarray, table: int, count: int) -> np.ndarray:
        """For each query the ``count`` buckets it comes closest to, closest first."""
        each = min(count, 2 * self.width)
        axes, losses = [], []
        for part in range(self.hashes):
            turned = self.rotated(units, table, part)
            both = np.stack((turned, -turned), axis=2).reshape(len(units), -1)
            best = np.argsort(-both, axis=1, kind="stable")[:, :each]
            value = np.take_along_axis(both, best, axis=1)
            axes.append(best)
            losses.append((value[:, :1] - value) ** 2)
        if self.hashes == 1:
            return axes[0].astype(np.int64)
        choices = np.array(list(islice(_small_products(each, self.hashes), 8 * count)))
        loss = sum(losses[p][:, choices[:, p]] for p in range(self.hashes))
        best = np.argsort(loss, axis=1, kind="stable")[:, :count]
        out = np.zeros(best.shape, np.int64)
        for part in range(self.hashes):
            out = out * (2 * self.width) + np.take_along_axis(
                axes[part], choices[best, part], axis=1
            )
        return out


def _small_products(each: int, parts: int) -> Iterator[tuple[int, ...]]:
    """Combinations of ranks, those with a small product of (rank + 1) first."""
    side = range(min(each, 64 if parts == 2 else 16 if parts == 3 else 6))
    yield from sorted(product(side, repeat=parts), key=lambda c: np.prod(np.array(c) + 1))


def fitted(
    sample: np.ndarray, rows: int, longest: float, hashes: int
) -> tuple[Rotations, int]:
    """The first index, and probes per table, that find TARGET of the sample's neighbours.

    Twice the tables cost twice the work, an axis less makes buckets larger by their number of axes, so
    tables grow first.
    """
    size = sample.shape[1]
    for parts in range(hashes, 0, -1):
        for tables in (TABLES, 2 * TABLES, 4 * TABLES):
            rotations = Rotations(size, longest, parts, tables)
            probes = fitted_probes(sample, rows, rotations)
            if probes is not None:
                return rotations, probes
    whole = Rotations(size, longest, 1, 1)
    return whole, 2 * whole.width


def fitted_probes(sample: np.ndarray, rows: int, rotations: Rotations) -> int | None:
    """The fewest probes per table that find TARGET of the sample's neighbours; none if MOST_PROBES do not.

    Neighbours are as rare in the sample as the wanted ones are among all rows, one at least, so the
    fit is on neighbours that are as far away or farther.
    """
    queries = sample[:: max(1, len(sample) // SAMPLE_QUERIES)][:SAMPLE_QUERIES]
    wanted = max(1, min(len(sample) - 1, round(NEIGHBOURS * len(sample) / max(rows, 1))))
    inner = queries @ sample.T
    own = np.arange(len(queries))
    inner[own, own * max(1, len(sample) // SAMPLE_QUERIES)] = -np.inf
    true = np.argsort(-inner, axis=1)[:, :wanted]
    as_rows, as_queries = rotations.units(sample, False), rotations.units(queries, True)
    first_probe = np.full(true.shape, MOST_PROBES)
    for t in range(rotations.tables):
        held = rotations.buckets(as_rows, t)[true]
        probed = rotations.probes(as_queries, t, MOST_PROBES)
        hit = held[:, :, None] == probed[:, None, :]
        place = np.where(hit.any(axis=2), hit.argmax(axis=2), MOST_PROBES)
        first_probe = np.minimum(first_probe, place)
    share = [(first_probe < p).mean() for p in range(1, MOST_PROBES + 1)]
    return next((p for p, s in enumerate(share, 1) if s >= TARGET), None)


def _as_matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _bucketed(
    classes: DataFrame, rotations: Rotations, probes: int | None
) -> DataFrame:
    """key, vector and bucket: the buckets a row is in, or (with ``probes``) those a query visits."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _as_matrix(batch.column("vector"), rotations.size)
            units = rotations.units(vectors, probes is not None)
            for t in range(rotations.tables):
                found = (
                    rotations.buckets(units, t)[:, None]
                    if probes is None
                    else rotations.probes(units, t, probes)
                )
                row = np.repeat(np.arange(len(units)), found.shape[1])
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [
                        taken.column("key"),
                        taken.column("vector"),
                        pa.array(np.full(len(row), t, np.int32)),
                        pa.array(found.ravel()),
                    ],
                    ["key", "vector", "t", "bucket"],
                )

    return classes.select("key", "vector").mapInArrow(
        hashed, "key binary, vector array<double>, t int, bucket long"
    )


def _best_in_blocks(rows: DataFrame, queries: DataFrame, size: int, keep: int) -> DataFrame:
    """query, key, score: the best ``keep`` rows of every block for every query of its bucket."""
    per_bucket = [
        side.groupBy("t", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
        for side, name in ((rows, "row_blocks"), (queries, "query_blocks"))
    ]
    blocks = per_bucket[0].join(per_bucket[1], ["t", "bucket"])

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        """Each vector in one block of its own side, and once for every block of the other."""
        return side.join(blocks, ["t", "bucket"]).select(
            "key",
            "vector",
            "t",
            "bucket",
            F.pmod(F.xxhash64("key"), F.col(own)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other),
        )

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query": [], "key": [], "score": []}
        if left.num_rows and right.num_rows:
            vectors = _as_matrix(left.column("vector").combine_chunks(), size)
            keys = left.column("key").combine_chunks()
            for at in range(0, right.num_rows, 64):
                part = right.slice(at, 64)
                wanted = _as_matrix(part.column("vector").combine_chunks(), size)
                for name, vector in zip(part.column("key").to_pylist(), wanted, strict=True):
                    # One sum per row, in the order of components: equal wherever a pair meets.
                    scores = (vectors * vector).sum(axis=1)
                    top = np.arange(len(scores))
                    if len(top) > keep:
                        least = np.partition(scores, len(scores) - keep)[len(scores) - keep]
                        top = np.flatnonzero(scores >= least)
                    out["query"] += [name] * len(top)
                    out["key"] += keys.take(pa.array(top)).to_pylist()
                    out["score"].append(scores[top])
        scores = np.concatenate(out["score"]) if out["score"] else np.empty(0)
        return pa.table(
            {
                "query": pa.array(out["query"], pa.binary()),
                "key": pa.array(out["key"], pa.binary()),
                "score": pa.array(scores, pa.float64()),
            }
        )

    by = ["t", "bucket", "row_blocks", "query_blocks"]
    left = dealt(rows, "row_blocks", "query_blocks").select("key", "vector", *by).groupBy(*by)
    right = dealt(queries, "query_blocks", "row_blocks").select("key", "vector", *by).groupBy(*by)
    found = left.cogroup(right).applyInArrow(best, "query binary, key binary, score double")
    return found.groupBy("query", "key").agg(F.max("score").alias("score"))


def _ranked(found: DataFrame, members: DataFrame, queries: DataFrame, keep: int) -> DataFrame:
    """query_id, rank, vec_id, score from scored classes; a class stands for its smallest ids."""
    near = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    at_least = found.withColumn("place", F.row_number().over(near)).where(
        F.col("place") <= keep + 1
    )
    # Classes with the score of the last place count too: their ids may be smaller.
    last = at_least.groupBy("query").agg(F.min("score").alias("least"))
    short = found.join(last, "query").where("score >= least").select("query", "key", "score")
    by_id = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ids = (
        short.join(members, "key")
        .select("query", "vec_id", "score")
        .groupBy("query", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("place", F.row_number().over(by_id))
        .where(F.col("place") <= keep + 1)
    )
    nearest = ids.groupBy("query").agg(
        F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near")
    )
    named = queries.join(nearest, queries["key"] == nearest["query"]).select(
        "query_id",
        F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, keep).alias("near"),
    )
    return named.select("query_id", F.posexplode("near").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score"
    )


def search(
    spark: SparkSession,
    rows: DataFrame,
    is_query: Column,
    keep: int = NEIGHBOURS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows of every row that ``is_query`` picks.

    ``rows`` has vec_id and embedding. The driver sees a bounded sample and a few sums.
    """
    values = F.col("vector")
    usable = (
        rows.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
        .where(F.col("vec_id").isNotNull() & values.isNotNull())
        .where(F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        .where(F.exists(values, lambda x: x != 0))
    )
    sizes = usable.groupBy(F.size("vector").alias("size")).count()
    size = sizes.orderBy(F.desc("count"), "size").first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = size["size"]
    hashed = [F.xxhash64(F.lit(seed), values) for seed in (1, 2)]
    keyed = written(
        usable.where(F.size("vector") == size).withColumn(
            "key", F.unhex(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in hashed]))
        ),
        new_work_dir(spark, "vectors"),
    )
    classes = written(
        keyed.groupBy("key").agg(F.first("vector").alias("vector"), F.max(is_query).alias("asks")),
        new_work_dir(spark, "classes"),
    )
    by_key = Window.partitionBy("key").orderBy("vec_id")
    members = (
        keyed.select("key", "vec_id")
        .withColumn("place", F.row_number().over(by_key))
        .where(F.col("place") <= keep + 1)
        .select("key", "vec_id")
    )
    queries = keyed.where(is_query).select("key", F.col("vec_id").alias("query_id")).distinct()
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    n, longest = classes.agg(F.count("*"), F.sqrt(F.max(square))).first()
    width = 2 << max(1, size).bit_length()
    hashes = max(1, round(float(np.log(max(n, 2) / BUCKET) / np.log(width))))
    sample = classes.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vector").collect()
    rotations, probes = fitted(np.array([r[0] for r in sample]), n, longest, hashes)
    asking = classes.where("asks")
    found = written(
        _best_in_blocks(
            _bucketed(classes, rotations, None), _bucketed(asking, rotations, probes), size, keep + 1
        ),
        new_work_dir(spark, "found"),
    )
    # What the tables left short visits every row.
    enough = found.groupBy("query").agg(F.count("*").alias("n")).where(
        F.col("n") >= min(keep + 1, n)
    )
    missing = written(
        asking.join(enough, asking["key"] == enough["query"], "left_anti"),
        new_work_dir(spark, "missing"),
    )
    if not missing.isEmpty():
        one = F.lit(0).alias("t"), F.lit(0).cast("long").alias("bucket")
        all_rows = classes.select("key", "vector", *one)
        more = _best_in_blocks(all_rows, missing.select("key", "vector", *one), size, keep + 1)
        found = (
            found.join(missing.select(F.col("key").alias("query")), "query", "left_anti")
            .unionByName(more)
        )
    return _ranked(found, members, queries, keep)


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
