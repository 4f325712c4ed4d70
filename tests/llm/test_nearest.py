import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantia.llm import nearest as A

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, keep=20, every=20):
    """All pairs in double precision, components summed in order."""
    usable = {}
    for vec_id, v, *_ in rows:
        if vec_id is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable.setdefault(vec_id, []).append(np.array(v, np.float32).astype(np.float64))
    out = {}
    for q, own in usable.items():
        if q % every == 0:
            scored = [
                (max(float((v[None] * own[0]).sum(axis=1)[0]) for v in vs), vec_id)
                for vec_id, vs in usable.items()
                if vec_id != q
            ]
            out[q] = [(v, s) for s, v in sorted(scored, key=lambda x: (-x[0], x[1]))[:keep]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 64))
    h = A.hadamard(np.eye(8))
    assert np.allclose(h @ h.T, np.eye(8)) and np.allclose(np.abs(h), 8**-0.5)
    assert np.allclose(np.linalg.norm(A.hadamard(x), axis=1), np.linalg.norm(x, axis=1))


def test_first_probe_is_the_own_bucket():
    x = np.random.default_rng(2).normal(size=(50, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for hashes in (1, 2, 3):
        rotations = A.Rotations(16, 1.0, hashes, tables=2)
        units = rotations.units(x, True)
        for t in range(2):
            probes = rotations.probes(units, t, 6)
            assert (probes[:, 0] == rotations.buckets(units, t)).all()
            assert all(len(set(p)) == len(p) for p in probes.tolist())


def odd_rows():
    rng = np.random.default_rng(5)
    rows = [(n, rng.normal(size=8).tolist(), 1) for n in range(120)]
    rows += [(n, rows[3][1], 1) for n in range(200, 260)]  # copies of one vector
    rows += [(300, None, 1), (301, [0.0] * 8, 1), (302, [None] + [1.0] * 7, 1), (303, [], 1)]
    rows += [(304, [float("nan")] * 8, 1), (305, [float("inf")] + [1.0] * 7, 1), (None, [1.0] * 8, 1)]
    rows += [rows[40], rows[41]]  # repeated rows, one of them a query
    rows += [(306, [9.0] * 3, 1)]
    return rows


def test_small_and_odd_tables_are_exact(spark):
    """With few rows every query falls short in its buckets or finds them all."""
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    got = answers(A.search(spark, df, F.col("vec_id") % 20 == 0))
    want = brute([r for r in rows if r[0] != 306])
    assert set(got) == set(want)
    found = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert found >= 0.9 * sum(map(len, want.values()))
    scores = {q: dict(brute([r for r in rows if r[0] != 306], keep=10**6)[q]) for q in want}
    for q, near in got.items():
        assert len(near) == len(want[q])
        assert all(s == pytest.approx(scores[q][v], rel=1e-14) for v, s in near)
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))


def test_blocks_change_nothing(spark, monkeypatch):
    rows = odd_rows()[:180]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = answers(A.search(spark, df, F.col("vec_id") % 20 == 0))
    monkeypatch.setattr(A, "BLOCK", 3)
    assert answers(A.search(spark, df, F.col("vec_id") % 20 == 0)) == whole


def test_index_grows_until_the_target_is_reached(monkeypatch):
    """Too few tables and probes: more tables, then coarser buckets, and recall on other queries follows."""
    monkeypatch.setattr(A, "TABLES", 4)
    monkeypatch.setattr(A, "MOST_PROBES", 8)
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(4_000, 16))
    longest = np.linalg.norm(rows, axis=1).max()
    narrow = A.Rotations(16, longest, 2, 4)
    assert A.fitted_probes(rows, len(rows), narrow) is None
    rotations, probes = A.fitted(rows, len(rows), longest, 2)
    assert (rotations.tables, rotations.hashes) != (4, 2)
    queries = rng.normal(size=(200, 16))
    near = np.argsort(-(queries @ rows.T), axis=1)[:, : A.NEIGHBOURS]
    hit = np.zeros(near.shape, bool)
    as_rows, as_queries = rotations.units(rows, False), rotations.units(queries, True)
    for t in range(rotations.tables):
        held, probed = rotations.buckets(as_rows, t)[near], rotations.probes(as_queries, t, probes)
        hit |= (held[:, :, None] == probed[:, None, :]).any(axis=2)
    assert hit.mean() >= 0.9


def test_what_no_index_reaches_is_exact(spark, monkeypatch):
    monkeypatch.setattr(A, "TARGET", 1.1)
    rows = [r for r in odd_rows() if r[0] != 306]
    df = spark.createDataFrame(rows, SCHEMA)
    got, want = answers(A.search(spark, df, F.col("vec_id") % 20 == 0)), brute(rows)
    assert {q: [v for v, _ in near] for q, near in got.items()} == {
        q: [v for v, _ in near] for q, near in want.items()
    }


def test_fewer_rows_than_neighbours(spark):
    rows = [(n, [1.0, float(n)], 0) for n in range(4)]
    got = answers(A.search(spark, spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0))
    assert got == brute(rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert A.search(spark, empty, F.col("vec_id") % 20 == 0).count() == 0


def test_recall_on_the_whole_table(spark):
    small = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got, want = answers(A.op2_cross_polytope(spark, small)), brute(rows)
    assert set(got) == set(want)
    found = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert found >= 0.9 * sum(map(len, want.values()))
