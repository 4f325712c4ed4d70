import re
from collections import Counter
from math import log2, sqrt

import pytest
import regex
from pyspark.sql import functions as F

from vacantia.llm import quality as Q

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    n = len(words)
    windows = Counter(tuple(words[k : k + 5]) for k in range(n - 4))
    covered = set()
    for k in range(n - 4):
        if windows[tuple(words[k : k + 5])] > 1:
            covered.update(range(k, k + 5))
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return (
        n,
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
        n < 10 or 100 * len(covered) > 20 * n,
    )


TEXTS = [
    None, "", " \n\t ", "one", "a b c d e a b c d e", "x " * 30, "a\nb\na\n\n a\nb", "é|| ** é",
    "the cat sat on the mat and the dog sat on the rug by the door of the house",
    "w1 w2 w3 w4 w5 w6 w1 w2 w3 w4 w5 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17",
    "the the the of of and and x\x0by\x0cz", "\r\na b\r\na b\r\n",
]


def test_base_numbers_equal_brute_force(spark):
    rows = [(n, t, "en", "extra") for n, t in enumerate(TEXTS)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    features = Q.measure(spark, docs)
    got = Q.judge(features, Q.references(features)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (
            r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed
        ) == brute(TEXTS[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_common_words_are_all_counted(spark):
    docs = spark.createDataFrame([(1, "the the, THE of xyz", "en")], "doc_id long, text string, lang string")
    counts = Q.measure(spark, docs).first()["common_by_lang"]["en"]
    assert counts[:2] == [3, 1] and counts[-1] == 1 and sum(counts) == 5


def test_distance(spark):
    p, q = [0.5, 0.5, 0.0], [0.1, 0.2, 0.7]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    part = [sum(x * log2(x / y) for x, y in zip(s, m, strict=True) if x) for s in (p, q)]
    df = spark.range(1).select(
        Q.js_distance(Q._literals(p), Q._literals(q)).alias("d"),
        Q.js_distance(Q._literals(p), Q._literals(p)).alias("same"),
        Q.js_distance(Q._literals([1.0, 0]), Q._literals([0, 1.0])).alias("far"),
    )
    row = df.first()
    assert row.d == pytest.approx(sqrt(sum(part) / 2))
    assert row.same == pytest.approx(0) and row.far == pytest.approx(1)


def test_odd_documents_go_and_clean_ones_stay(spark):
    small = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = Q.op9_quality_rules(spark, small).join(docs, "doc_id")
    marked = kept.withColumn(
        "symbols", F.size(F.filter(F.split("text", " "), lambda w: w.rlike(r"(\*\*\*|%%%|###|&&&|\$\$\$)$")))
    )
    assert marked.where("symbols > n_words * 0.8 and kept").count() == 0
    good = kept.join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").where("quality = 1")
    assert good.where("not kept and not base_failed").count() <= 0.01 * good.count()


def test_main_path_is_native_and_null_languages_are_judged(spark):
    rows = [(n, "the house of the man and the dog was in the street by the sea " * 1 + str(n), None) for n in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    features = Q.measure(spark, docs)
    judged = Q.judge(features, Q.references(features))
    plan = judged._jdf.queryExecution().toString() + Q._measured(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert [r.kept for r in judged.collect()] == [True] * 3
    empty = Q.measure(spark, docs.limit(0))
    assert Q.judge(empty, Q.references(empty)).count() == 0


def test_classes_are_counted_in_what_others_left(spark):
    """One pattern goes over the whole text; each later one over what is left. Together they miss nothing."""
    texts = ["Ab c, É²!? #*$ 12-3\t\r\n日本ǅ|<x>'", "", None, "  ", "ΑΣς;:.-%&"]
    frame = spark.createDataFrame([(n, t, "en") for n, t in enumerate(texts)], "doc_id long, text string, lang string")
    measured = Q._measured(frame)
    plan = measured._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") - plan.count("regexp_replace(rest#") - plan.count(
        "regexp_replace(less#"
    ) == 1, plan
    for row in measured.collect():
        text = texts[row.doc_id] or ""
        each = [len(text) - len(regex.sub(p, "", text)) for p in Q.CHAR_CLASSES]
        numbers = len(text) - len(regex.sub(Q.LEFT_OUT, "", text))
        assert row.classes == [*each, len(text) - numbers - sum(each)]
        assert row.word_chars == sum(map(len, regex.findall(r"[^\x20\x09-\x0D]+", text)))
