import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SMALL
from vacantia.llm import runs as R
from vacantia.llm.common import table


def brute(words: list, least: int = R.MIN_LENGTH) -> list[tuple]:
    """Every period tried on every place."""
    found: dict[tuple, int] = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 2 * q):
                found.setdefault((i, length), q)  # the smallest period comes first
            i = max(j, i) + 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def as_words(text: str) -> list[bytes]:
    return [bytes([c]) for c in text.encode()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=4), st.integers(2, 12))
def test_equals_brute_force(texts, least):
    documents = [as_words(t) for t in texts]
    assert R.runs_of(documents, least) == [brute(d, least) for d in documents]


@pytest.mark.parametrize("alphabet", ["a", "ab", "abc", "abcdefgh"])
def test_equals_brute_force_on_repeats_of_repeats(alphabet):
    draw = random.Random(alphabet)
    documents = []
    for _ in range(60):
        text = "".join(draw.choices(alphabet, k=draw.randint(0, 6)))
        while len(text) < 150:
            text = text * draw.randint(1, 6) + "".join(draw.choices(alphabet, k=draw.randint(1, 5)))
        documents.append(as_words(text[: draw.randint(0, 300)]))
    assert R.runs_of(documents) == [brute(d) for d in documents]


def test_collapse_keeps_first_periods():
    document = as_words("xyabcabcabcabcabzabcabc")
    assert R.runs_of([document]) == [[(2, 14, 3)]]
    assert R.collapsed(document, [(2, 14, 3)]) == b" ".join(as_words("xyabczabcabc"))


def test_a_very_long_text_is_whole():
    period = [b"w%d" % n for n in range(7)]
    document = [b"start"] + period * 30_000 + [b"end"]
    assert R.runs_of([document]) == [[(1, 210_000, 7)]]
    assert R.collapsed(document, [(1, 210_000, 7)]) == b" ".join([b"start", *period, b"end"])


def test_edge_rows(spark):
    rows = [
        (1, None, "x"), (2, "", "x"), (3, " \t\n", None), (None, "a b " * 10, "x"), (4, "a b " * 10, "x"),
        (4, "a b " * 10, "x"), (5, "no-break\u00a0space " * 6, "x"), (6, "a " * 11, "x"), (7, "a " * 12, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(
        (r.doc_id or 0, [tuple(x) for x in r.runs], bytes(r.collapsed).decode())
        for r in R.periodic_runs(docs).collect()
    )
    assert got == [
        (0, [(0, 20, 2)], "a b"), (1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 20, 2)], "a b"),
        (4, [(0, 20, 2)], "a b"), (5, [], "no-break\u00a0space " * 5 + "no-break\u00a0space"),
        (6, [], ("a " * 11).strip()), (7, [(0, 12, 1)], "a"),
    ]
    assert R.periodic_runs(docs.limit(0)).collect() == []


def test_query_equals_brute_force(spark):
    given_rows = table(spark, SMALL, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: r.asDict() for r in R.op11_periodic_runs(spark, SMALL).collect()}
    assert len(got) == len(given_rows)
    planted = 0
    for doc_id, text in given_rows:
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        found = brute(words)
        first = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        assert got[doc_id] == {
            "doc_id": doc_id,
            "n_runs": len(found),
            "start": first[0],
            "length": first[1],
            "period": first[2],
            "exponent_milli": 1000 * first[1] // first[2] if found else None,
            "runs_sha256": hashlib.sha256(lines.encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(kept).hexdigest(),
        }
    assert planted > 5
