from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from vacantia.llm import near_dedup as N


def brute_similarity(x, y):
    """Straight from the definition, over all pairs of elements."""
    x, y = (dict(zip(*(a.tolist() for a in s), strict=True)) for s in (x, y))
    nx, ny = sum(x.values()), sum(y.values())
    total = 0.0
    for i in set(x) & set(y):
        xi, yi = x[i] / nx, y[i] / ny
        total += 1 / sum(
            max(x.get(j, 0) / nx / xi, y.get(j, 0) / ny / yi) for j in set(x) | set(y)
        )
    return total


def test_similarity_and_its_estimate():
    rng = np.random.default_rng(1)
    for _ in range(5):
        base = [f"w{n}" for n in rng.integers(0, 60, 120)]
        other = [w if rng.random() > 0.03 else "new" for w in base]
        x, y = (N.shingles(" ".join(t).encode()) for t in (base, other))
        exact = N.probability_jaccard(x, y)
        assert exact == pytest.approx(brute_similarity(x, y))
        left, right = N.signatures([x, y], 4000)
        assert (left == right).mean() == pytest.approx(exact, abs=0.05)
    one = N.shingles(b"a b c")
    assert N.probability_jaccard(one, one) == pytest.approx(1)
    assert N.probability_jaccard(one, N.shingles(b"")) == 0


def test_signatures_do_not_depend_on_neighbours():
    docs = [N.shingles(t) for t in (b"a", b"a b c d e f g h", b"x y " * 50, b"one two three")]
    together = N.signatures(docs, 64)
    for doc, row in zip(docs, together, strict=True):
        assert (N.signatures([doc], 64)[0] == row).all()
        assert set(row.tolist()) <= set(doc[0].tolist())


def test_shingles_count_windows():
    keys, counts = N.shingles(b"a b c d e a b c d e")
    assert counts.sum() == 6 and sorted(counts) == [1, 1, 1, 1, 2]
    assert len(N.shingles(b"one two")[0]) == 1 and len(N.shingles(b"  ")[0]) == 0


def docs_with_groups():
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for group in range(6):
        base = [f"g{group}w{k}" for k in rng.integers(0, 500, 150)]
        for copy in range(12):
            words = list(base)
            for _ in range(copy % 4):
                words[int(rng.integers(0, 150))] = f"x{copy}"
            rows.append((n, ("  " if copy % 5 == 0 else " ").join(words)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "Short text"), (n + 4, "short  TEXT")]
    rows += [(5, rows[5][1]), (None, rows[7][1]), (None, None)]
    return rows


def brute_classes(rows):
    sets = [N.shingles(" ".join((t or "").lower().split()).encode()) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        if N.probability_jaccard(sets[a], sets[b]) >= N.THRESHOLD - 1e-12:
            root[find(b)] = find(a)
    groups = {}
    for k, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(doc_id)
    named = {k: min((d for d in g if d is not None), default=None) for k, g in groups.items()}
    return Counter((rows[k][0], named[find(k)]) for k in range(len(rows)))


def test_classes_equal_brute_force(spark):
    rows = docs_with_groups()
    docs = spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, key string")
    got = Counter((r.doc_id, r.class_id) for r in N.classes(spark, docs).collect())
    assert got == brute_classes(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert N.classes(spark, docs).count() == 0


def test_components_of_chains_and_stars(spark):
    keys = [bytes([0, n]) for n in range(40)]
    chain = [(keys[n], keys[n + 1]) for n in range(0, 19)]
    star = [(keys[30], keys[n]) for n in range(20, 40) if n != 30]
    links = spark.createDataFrame(chain + star, "a binary, b binary")
    got = {bytes(r.key): bytes(r.root) for r in N.components(spark, links).collect()}
    assert got == {k: keys[0] for k in keys[1:20]} | {k: keys[20] for k in keys[21:]}


@pytest.mark.parametrize("block", [1, 2, 256])
def test_no_pair_of_a_mixed_bucket_is_left_undecided(spark, monkeypatch, block):
    """Whatever the leaders' stars did not decide: all links between components, and no other."""
    monkeypatch.setattr(N, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in range(100)]
    texts = []
    for _ in range(14):
        words = list(base)
        for at in rng.choice(100, rng.integers(0, 4), replace=False):
            words[at] = f"x{rng.integers(0, 3)}"
        texts.append(" ".join(words))
    keys = [bytes([n]) for n in range(14)]
    roots = {keys[1]: keys[0], keys[2]: keys[0], keys[5]: keys[4]}
    root = lambda k: roots.get(k, k)
    sets = [N.shingles(t.encode()) for t in texts]
    groups = {1: range(0, 10), 2: range(8, 14), 3: (0, 1, 2)}
    want = {
        (keys[x], keys[y])
        for members in groups.values()
        for x, y in combinations(members, 2)
        if root(keys[x]) != root(keys[y]) and N.probability_jaccard(sets[x], sets[y]) >= 0.8 - 1e-12
    }
    assert 0 < len(want) < 60
    got = N._links_apart(
        spark.createDataFrame([(b, keys[k]) for b, g in groups.items() for k in g], "bucket long, key binary"),
        spark.createDataFrame(list(roots.items()), "key binary, root binary"),
        spark.createDataFrame(list(zip(keys, texts, strict=True)), "key binary, normal string"),
    ).collect()
    assert {tuple(sorted((bytes(r.a), bytes(r.b)))) for r in got} == want


def test_stage_keeps_one_of_each_class(spark):
    rows = [(n, t, "en", "s", 1) for n, t in docs_with_groups()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    classes = brute_classes([(r[0], r[1]) for r in rows if r[0] is not None])
    kept = [r.doc_id for r in N.stage_near_dedup(spark, docs, "").collect()]
    assert sorted(k for k in kept if k is not None) == sorted({c for _, c in classes})
    assert kept.count(None) == 2


def test_stage_keeps_different_texts_with_one_id(spark):
    one = " ".join(f"a{k}" for k in range(60))
    two = " ".join(f"b{k}" for k in range(60))
    rows = [(1, one), (1, two), (1, two), (2, one), (3, None), (3, "")]
    docs = spark.createDataFrame(
        [(*r, "en", "s", 1) for r in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    got = sorted((r.doc_id, r.text or "") for r in N.stage_near_dedup(spark, docs, "").collect())
    assert got == [(1, one), (1, two), (3, "")]


def test_stage_counts_rows_equal_in_all_columns_once(spark):
    one = " ".join(f"a{k}" for k in range(60))
    two = " ".join(f"b{k}" for k in range(60))
    rows = [(1, one, "en", None, 1)] * 3 + [(2, one, "en", "s", 1), (4, one, None, "s", None)]
    rows += [(5, two, "en", "s", 1), (5, two, None, "s", 1), (6, "", "en", "s", 0), (6, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in N.stage_near_dedup(spark, docs, "").collect()]
    assert sorted(got) == [(1, one), (5, two), (6, "")]


def test_stage_moves_texts_against_the_rows_that_leave_only(spark, tmp_path):
    rows = [(n, t, "en", "s", 1) for n, t in docs_with_groups() if n is not None]
    path = str(tmp_path / "docs")
    spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(path)
    plan = N.stage_near_dedup(spark, spark.read.parquet(path), "")._jdf.queryExecution().executedPlan()
    assert "Window" not in plan.toString()
    assert plan.toString().count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan.toString()


def test_bitmap_rules_out_only_what_is_not_there(spark, monkeypatch):
    monkeypatch.setattr(N, "PLACES", 1 << 16)
    keys = [n.to_bytes(16, "big") for n in range(2_000)]
    rows = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "key binary, n int")
    some = spark.createDataFrame([(k,) for k in keys[:400]], "key binary")
    got = {r.n: r.perhaps for r in N._perhaps_in(rows, "key", some).collect()}
    assert len(got) == 2_000 and all(got[n] for n in range(400))
    assert sum(got.values()) < 450
    none = N._perhaps_in(rows, "key", some.limit(0))
    assert none.where("perhaps").count() == 0 and none.count() == 2_000


def test_only_nodes_with_a_partner_are_written(spark, monkeypatch):
    """Sketches of the others are not landed, nor are their texts."""
    landed = {}

    def counted(df, path):
        out = N_written(df, path)
        landed.setdefault(path.rsplit("/", 1)[1].split("-")[0], out.count())
        return out

    N_written = N.written
    monkeypatch.setattr(N, "written", counted)
    rng = np.random.default_rng(9)
    rows = [(n, " ".join(f"w{k}" for k in rng.integers(0, 9_000, 80)), "en", "s", 1) for n in range(30)]
    rows.append((30, rows[7][1] + " more", "en", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = N.stage_near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(30))
    assert landed["texts"] == 2
    assert all(n <= N.BANDS for label, n in landed.items()), landed


def test_stage_keeps_the_same_rows_without_broadcast(spark, monkeypatch):
    rows = [(n, t, "en", "s", 1) for n, t in docs_with_groups()] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = Counter(N.stage_near_dedup(spark, docs, "").collect())
    monkeypatch.setattr(N, "MOST_BROADCAST", 0)
    monkeypatch.setattr(N, "PLACES", 1 << 15)
    assert Counter(N.stage_near_dedup(spark, docs, "").collect()) == want
