import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from vacantia.llm import repeats as R
from vacantia.llm.common import table


def brute(rows: list[tuple]) -> list[tuple]:
    """All strings of all documents in one dictionary."""
    span = R.SPAN
    data = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    least: dict = {}
    for i, t in data:
        for p in range(len(t) - span + 1):
            key = t[p : p + span]
            least[key] = min(i, least.get(key, i))
    out = []
    for (i, t), (given, _) in zip(data, rows, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - span + 1):
            if least[t[p : p + span]] < i:
                gone[p : p + span] = True
        edges = np.flatnonzero(np.diff(gone, prepend=False))
        spans = [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
        kept = bytes(c for c, g in zip(t, gone, strict=False) if not g)
        out.append((str(given), len(t), spans, kept))
    return sorted(out)


def answered(df) -> list[tuple]:
    return sorted(
        (str(r.doc_id), r.n_bytes, [tuple(s) for s in r.removed], bytes(r.kept)) for r in df.collect()
    )


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefgh"])
@pytest.mark.parametrize("copied", [0.0, 0.9])
def test_strings_are_sorted(alphabet, copied):
    draw = random.Random(alphabet + str(copied))
    text = "".join(draw.choices(alphabet, k=3000))
    while len(text) < 9000:
        a = draw.randrange(len(text) - 200)
        text += text[a : a + draw.randint(20, 200)] if draw.random() < copied else draw.choice(alphabet)
    data = text.encode()
    places = np.array(draw.sample(range(len(data) - R.SPAN), 4000))
    order, equal = R.sorted_strings(R._buffer([data]), places)
    found = [data[p : p + R.SPAN] for p in places[order].tolist()]
    assert sorted(order.tolist()) == list(range(len(places)))
    assert found == sorted(found)
    assert equal.tolist() == [n > 0 and found[n] == found[n - 1] for n in range(len(found))]


def test_tries_order_what_quicksort_leaves():
    """Long common beginnings, equal strings, and branches below branches."""
    draw = random.Random(5)
    strings = []
    for head in ("x" * 40, "y" * 33, "z" * 49):
        for _ in range(300):
            strings.append((head + "".join(draw.choices("pq", k=R.SPAN - len(head)))).encode())
    draw.shuffle(strings)
    data = b"".join(strings)
    places = np.arange(len(strings)) * R.SPAN
    order, equal = R.sorted_strings(R._buffer([data]), places)
    found = [strings[n] for n in order]
    assert found == sorted(strings)
    assert (~equal).sum() == len(set(strings))


def test_equal_strings_have_equal_anchors():
    draw = random.Random(3)
    common = bytes(draw.choices(b"abc ", k=400))
    texts = [bytes(draw.choices(b"abc ", k=n)) + common + bytes(draw.choices(b"abc ", k=9)) for n in (0, 7, 999)]
    seen = []
    for t in texts:
        away = R._anchors(R._buffer([t]), len(t))
        start = t.index(common)
        seen.append(away[start : start + 400 - R.SPAN + 1].tolist())
    assert seen[0] == seen[1] == seen[2]


def test_buckets_are_even():
    draw = random.Random(2)
    text = bytes(draw.choices(b"abcdefgh ", k=60_000))
    pieces = R.Pieces(R._buffer([text]), np.array([0, len(text)]))
    sizes = np.bincount(R._bucket(pieces.hash, 16), minlength=16)
    assert sizes.max() < 1.3 * sizes.mean()


def test_pieces_hold_every_string_once():
    texts = [b"", b"short", b"word " * 60, bytes(range(32, 127)) * 3, b"x" * 49, b"x" * 50]
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    pieces = R.Pieces(R._buffer(texts), bounds)
    found = [s + k for s, n in zip(pieces.start, pieces.count, strict=True) for k in range(n)]
    wanted = [b + p for b, t in zip(bounds, texts, strict=False) for p in range(len(t) - R.SPAN + 1)]
    assert found == wanted


def planted_rows() -> list[tuple]:
    draw = random.Random(11)
    vocabulary = ["".join(draw.choices("abcdefghij\u00e9\u65e5", k=draw.randint(1, 9))) for _ in range(400)]

    def prose(n: int) -> str:
        return " ".join(draw.choices(vocabulary, k=n))

    passage, licence = prose(60), prose(14)
    rows: list[tuple] = [
        (None, None), (None, passage), (None, passage), (-5, prose(30)), (7, None), (8, ""), (9, "x" * 49),
        (10, "x" * 50), (11, "x" * 400), (12, "ab" * 100), (13, "ba" * 100), (14, "\u65e5" * 40), (15, "z\u65e5" * 40),
        (3, passage), (3, passage), (3, prose(20) + passage),
    ]
    for n in range(20, 120):
        text = prose(draw.randint(0, 120))
        if n % 3 == 0:
            text += passage[draw.randint(0, 40) : draw.randint(60, 300)] + prose(10)
        if n % 4 == 0:
            text = licence + text + licence
        if n % 5 == 0 and rows[-1][1]:
            text = rows[-1][1][: draw.randint(0, 900)] + text
        rows.append((n, text))
    rows += [(n + 1000, passage + licence) for n in range(40)] + [(5000, prose(4000))]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1, 3_000, R.BLOCK_BYTES])
def test_equals_brute_force(spark, block):
    rows = planted_rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, block int, data string")
    assert answered(R.without_repeats(docs.repartition(3), block, 500)) == brute(rows)


def test_bounds_on_what_is_sorted_at_a_time():
    """A bucket gives the same answer in one part or in many."""
    rows = [(n, "same passage of text that is longer than fifty bytes in all " + str(n) * 60) for n in range(9)]
    texts = [t.encode() for _, t in rows]
    ids = np.array([i for i, _ in rows])
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    pieces = R.Pieces(R._buffer(texts), bounds)
    whole = b"".join(texts)
    strings = [whole[s : s + n + R.SPAN - 1] for s, n in zip(pieces.start, pieces.count, strict=True)]
    row = (
        4,
        R.zstandard.ZstdCompressor().compress(b"".join(strings)),
        R._packed(pieces.count.astype("u1"), pieces.away, np.ones(len(strings), "<u4")),
        R._packed(
            pieces.doc.astype("<u4"),
            (pieces.start - bounds[pieces.doc]).astype("<u4"),
            ids[pieces.doc].astype("<i8"),
        ),
    )

    def stretches(at_once: int) -> list[tuple]:
        found = R._bucket_repeats([row], at_once).column("data").to_pylist()
        return list(zip(*(x.tolist() for x in R._unpacked(found[0], "<u4", "<u4", "u1")), strict=True))

    assert stretches(7) == stretches(R.SORTED) != []


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert R.without_repeats(docs).collect() == []
    assert answered(R.without_repeats(spark.createDataFrame([(1, None)], docs.schema))) == [("1", 0, [], b"")]


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    got = sorted(
        (str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
        for r in R.op13_suffix_repeats(spark, SMALL).collect()
    )
    wanted = [
        (i, n, sum(s[1] for s in spans), len(spans), hashlib.sha256(kept).hexdigest())
        for i, n, spans, kept in brute(rows)
    ]
    assert got == wanted
    assert any(w[2] for w in wanted)


def test_other_tasks_and_columns(spark):
    rows = planted_rows()[:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1))
    one = answered(R.without_repeats(docs.coalesce(1)))
    assert one == answered(R.without_repeats(docs.repartition(7))) == brute(rows)
