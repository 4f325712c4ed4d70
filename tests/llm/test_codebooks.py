import hashlib

import numpy as np
import pytest

from tests.conftest import SMALL
from vacantia.llm import codebooks as C
from vacantia.llm.common import table


def plain(vectors: np.ndarray, parts: int, entries: int, rounds: int):
    """Every distance in every round, on Python-sized integers."""
    x = vectors.reshape(len(vectors), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def nearest():
        d = np.stack([((x[:, p, None] - books[p]) ** 2).sum(2) for p in range(parts)], 1)
        return d.argmin(2), d.min(2)

    for _ in range(rounds):
        code, _ = nearest()
        for p in range(parts):
            for j in range(books.shape[1]):
                own = x[code[:, p] == j, p]
                if len(own):
                    books[p, j] = [int(s) // len(own) for s in own.sum(0)]
    code, d = nearest()
    return code, d.sum(1), books


def brute(rows: list[tuple], parts=4, entries=256, rounds=4):
    kept = [
        r for r in rows
        if r[1] and all(v is not None and np.isfinite(v) for v in r[1])
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(np.array([r[1] for r in kept], np.float64) * 1024).astype(np.int64)
    code, error, books = plain(x, parts, entries, rounds)
    totals: dict = {}
    for r, e in zip(kept, error.tolist(), strict=True):
        totals[r[2]] = totals.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(v) for v in books.reshape(-1)).encode()).hexdigest()
    return sorted(
        (str(r[0]), bytes(c.astype("u1").tolist()).hex(), e, totals[r[2]], digest)
        for r, c, e in zip(kept, code, error.tolist(), strict=True)
    )


@pytest.mark.parametrize("group", [1, 3, 64])
@pytest.mark.parametrize("spread", [3, 1000])
def test_bounds_never_change_an_assignment(group, spread):
    """Small spread: many ties. Every round's assignment equals that of all distances."""
    draw = np.random.default_rng(spread + group)
    x = draw.integers(-spread, spread, (3000, 4))
    history, entry = [x[:20].copy()], None
    low = stamp = None
    scanned = []
    for _ in range(8):
        assigner = C.Assigner(history, True, group)
        if low is None:
            low = np.zeros((len(x), len(assigner.starts)))
            stamp = np.zeros(low.shape, np.uint8)
        entry, distance, scans = assigner.assign(x, entry, low, stamp)
        low = low.astype(np.float32).astype(np.float64) - 1e-4
        scanned.append(scans)
        d = ((x[:, None] - history[-1]) ** 2).sum(2)
        assert (entry == d.argmin(1)).all() and (distance == d.min(1)).all()
        moved = history[-1].copy()
        for j in range(len(moved)):
            if (entry == j).any():
                moved[j] = np.floor_divide(x[entry == j].sum(0), (entry == j).sum())
        history.append(moved)
    assert group == 64 or scanned[-1] < scanned[0]


def test_net_displacement_is_tighter_than_drifts():
    there = np.zeros((2, 3), np.int64)
    away = there + 10
    moved = C.Assigner([there, away, there], True, 2).moved
    assert moved[0, 0] == 0 and moved[1, 0] > 17


def rows_of(df):
    return sorted(
        (str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()
    )


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "embeddings").collect()]
    assert rows_of(C.op12_vector_codes(spark, SMALL)) == brute(rows)


@pytest.fixture
def odd_rows():
    draw = np.random.default_rng(1)
    rows = [(n, draw.normal(size=8).tolist(), n % 3 or None) for n in range(40)]
    return rows + [
        (None, [0.5] * 8, 1), (3, rows[3][1], 0), (3, [9.0] * 8, 7), (50, None, 1), (51, [], 1), (52, [1.0] * 7 + [None], 1),
        (53, [float("nan")] * 8, 1), (54, [float("inf")] + [0.0] * 7, 1), (55, [0.0] * 8, None), (-7, [-0.0001] * 8, 2),
        (56, [31.9999, -32.0, 40.0] + [0.0] * 5, 2),
    ]


def _answer(spark, rows, **given):
    schema = "vec_id long, embedding array<double>, label int, code string, error string"
    vectors = spark.createDataFrame([(*r, "x", "y") for r in rows], schema)
    codes, books = C.compressed(vectors, **given)
    found = C.with_label_error(spark, codes).selectExpr(
        "vec_id", "lower(hex(code)) code", "error", "label_error", f"'{C.codebook_digest(books)}' codebooks_sha256"
    )
    return rows_of(found), codes, books


@pytest.mark.parametrize("entries", [5, 256])
def test_odd_rows_equal_brute_force(spark, odd_rows, entries):
    got, _, _ = _answer(spark, odd_rows, entries=entries)
    assert got == brute(odd_rows, entries=entries)


def test_large_components_stay_exact(spark, odd_rows):
    rows = [(i, [v * 2_000 for v in e], label) if e and None not in e else (i, e, label) for i, e, label in odd_rows]
    got, _, _ = _answer(spark, rows, entries=6)
    assert got == brute(rows, entries=6)


def test_codes_decode_to_their_entries(spark, odd_rows):
    _, codes, books = _answer(spark, odd_rows, entries=7)
    given = {r[0]: np.floor(np.array(r[1]) * 1024) for r in odd_rows[:40]}
    errors = {r.vec_id: r.error for r in codes.collect()}
    for row in C.decoded(codes, books).where("vec_id between 4 and 39").collect():
        apart = np.array(row.embedding) * 1024 - given[row.vec_id]
        assert int((apart**2).sum()) == errors[row.vec_id]


def test_no_rows_and_wrong_shapes(spark, odd_rows):
    got, _, _ = _answer(spark, [r for r in odd_rows if r[0] in (50, 51, 52)])
    assert got == []
    with pytest.raises(ValueError, match="equal parts"):
        _answer(spark, [(1, [1.0] * 6, 1)])
    with pytest.raises(ValueError, match="equal parts"):
        _answer(spark, [(1, [1.0] * 8, 1), (2, [1.0] * 4, 1)])
    with pytest.raises(ValueError, match="overflow"):
        _answer(spark, [(1, [1e30] * 8, 1)])
