import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vacantia.llm import hmm as H


def small_model(seed=1, states=3, symbols=5):
    rng = np.random.default_rng(seed)
    return H.Model(
        rng.dirichlet(np.ones(states)),
        rng.dirichlet(np.ones(states), states),
        rng.dirichlet(np.ones(symbols), states),
    )


def paths(model, seq):
    """Probability of every path of states, by multiplication."""
    states = len(model.start)
    out = {}
    for path in product(range(states), repeat=len(seq)):
        p = model.start[path[0]] * model.emit[path[0], seq[0]]
        for a, b, s in zip(path, path[1:], seq[1:], strict=False):
            p *= model.move[a, b] * model.emit[b, s]
        out[path] = p
    return out


SEQUENCES = [np.array(s) for s in ([0, 1, 4, 2], [3], [2, 2], [1, 0, 3, 4, 4], [0])]


def test_likelihood_equals_the_sum_over_paths():
    model = small_model()
    out = np.zeros(len(SEQUENCES))
    for group, steps, active in H.side_by_side(SEQUENCES):
        out[group] = model.log10_likelihood(steps, active)
    want = [np.log10(sum(paths(model, s).values())) for s in SEQUENCES]
    assert out == pytest.approx(want)


def test_expected_counts_equal_the_sum_over_paths():
    model = small_model()
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
    for s in SEQUENCES:
        found = paths(model, s)
        total = sum(found.values())
        for path, p in found.items():
            start[path[0]] += p / total
            for a, b in zip(path, path[1:], strict=False):
                move[a, b] += p / total
            for state, symbol in zip(path, s, strict=True):
                emit[state, symbol] += p / total
    got = np.zeros(3 + 9 + 15)
    first = np.ones(len(SEQUENCES), bool)
    for group, steps, active in H.side_by_side(SEQUENCES):
        got += model.expected(steps, active, first[group])
    assert got == pytest.approx(np.concatenate((start, move.ravel(), emit.ravel())))


def test_training_never_lowers_the_likelihood(monkeypatch):
    monkeypatch.setattr(H, "PRIOR", 0.0)
    rng = np.random.default_rng(6)
    texts = [rng.integers(0, 5, n) for n in (40, 31, 7, 60)]
    model, before = small_model(9), -np.inf
    for _ in range(8):
        counts, total = np.zeros(27), 0.0
        for group, steps, active in H.side_by_side(texts):
            counts += model.expected(steps, active, np.ones(len(group), bool))
            total += model.log10_likelihood(steps, active).sum()
        assert total >= before - 1e-9
        before, model = total, H.Model.from_counts(counts, 3, 5)


def brute_base(rows):
    def tokens(text):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", lower), ""]

    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in rows]
    counts = Counter(t for (_, x), h in zip(rows, held, strict=True) if not h for t in tokens(x))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for (d, text), h in zip(rows, held, strict=True):
        found = tokens(text)
        base = sum(np.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in found)
        out.append((d, h, len(found), sum(counts[t] > 0 for t in found), total, base))
    return out


def check(got, rows):
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    want = sorted(brute_base(rows), key=key)
    got = sorted((tuple(r) for r in got), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)
        assert np.isfinite(g[6]) and g[6] < 1e-9


def score(spark, frame):
    from vacantia.llm.common import crc_fold

    return H.score(spark, frame, crc_fold(F.col("doc_id"), 1)).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def test_base_scores_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "FREQUENT", 12)
    monkeypatch.setattr(H, "OWN", 4)
    monkeypatch.setattr(H, "SYMBOLS", 4 + 1 + H.CLASSES)
    rows = [(n, f"The cat {n} sat on THE mat Éa{n % 3}\x0bend") for n in range(40)]
    rows += [(100, None), (101, ""), (102, " \n"), (None, "no id"), (3, rows[3][1]), (103, "nb sp")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int")
    check(score(spark, frame).collect(), rows)


def test_no_training_documents_and_empty_table(spark):
    held = next(n for n in range(99) if zlib.crc32(str(n).encode()) % 5 == 1)
    frame = spark.createDataFrame([(held, "all held out")], "doc_id long, text string")
    row = score(spark, frame).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (4, 0, 0, 0.0)
    assert score(spark, frame.limit(0)).count() == 0


def test_whole_table_and_what_states_add(spark):
    small = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = H.op10_hidden_markov(spark, small).collect()
    check(got, rows)


def test_trained_states_predict_held_out_order(spark):
    """Two kinds of words that take turns: states must learn it, counts cannot."""
    rng = np.random.default_rng(8)
    rows = []
    for n in range(300):
        words = [f"{'ab'[k % 2]}{rng.integers(0, 5)}" for k in range(40)]
        rows.append((n, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    gain = score(spark, frame).where("held_out").agg(F.avg(F.col("score") - F.col("base_score")))
    assert gain.first()[0] > 5


def test_words_are_split_at_ascii_white_space_only():
    texts = ["", " \n", "Ab  aB\x0b\x0cÄB c d\u0085e \x1cf", "\tx X\r", "ÀÉ i̇ İI"]
    text, place, distinct = H._words(pa.array(["cut off", *texts]).slice(1))
    words = distinct.to_pylist()
    got = [[words[p] for t, p in zip(text, place, strict=True) if t == n] for n in range(len(texts))]
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    assert got == [[w.decode() for w in t.encode().translate(lower).split()] for t in texts]


def test_words_of_many_small_batches_are_counted_together():
    """Before, every Arrow batch had rows of its own for the same words."""
    batches = [pa.RecordBatch.from_pydict({"text": ["a B b", " "]}) for _ in range(5)]
    got = [b.to_pylist() for b in H._counted(iter(batches))]
    rows = {(r["word"], r["class"]): r["n"] for r in got[0]}
    assert len(got) == 1 and len(got[0]) == 3
    assert rows == {("a", 0): 5, ("b", 0): 10, (H.END, -1): 10}
