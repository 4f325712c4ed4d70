from collections import Counter

from pyspark.sql import functions as F

from vacantia.llm import language_id as L


def brute_grams(text):
    word, words = "", []
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    counts = Counter()
    for w in words:
        counts.update(w)
        padded = f"\x01{w}\x01"
        counts.update(padded[k : k + 2] for k in range(len(padded) - 1))
        counts.update(padded[k : k + 3] for k in range(len(padded) - 2))
    return counts


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def test_gram_counts_equal_brute_force(monkeypatch):
    for text in ("", "  12 ", "a", "Été, là-bas! x1y", "The the\nTHE ß", "word " * 50):
        want = {code(g): n for g, n in brute_grams(text).items()}
        assert dict(zip(*(x.tolist() for x in L.gram_counts(text)), strict=True)) == want
    monkeypatch.setattr(L, "_BLOCK", 7)
    text = "one two three four five six seven"
    want = {code(g): n for g, n in brute_grams(text).items()}
    assert dict(zip(*(x.tolist() for x in L.gram_counts(text)), strict=True)) == want


def brute_predict(text, profiles, size):
    ranked = sorted(brute_grams(text).items(), key=lambda x: (-x[1], code(x[0])))[:size]
    if not ranked:
        return "und"
    totals = {}
    for lang, profile in profiles.items():
        place = {g: n for n, g in enumerate(profile)}
        totals[lang] = sum(
            abs(n - place[g]) if g in place else size for n, (g, _) in enumerate(ranked)
        )
    return min(sorted(totals), key=totals.get)


DOCS = [
    (1, "the cat and the dog and the bird", "en", "x"),
    (2, "der hund und die katze und das tier", "de", "x"),
    (3, "and then there were the others", "en", "x"),
    (4, None, "en", "x"),
    (5, "", None, "x"),
    (6, "123 456 !!!", "de", "x"),
    (7, "und dann der die das", None, "x"),
    (7, "und dann der die das", None, "x"),
    (None, "the end", "en", "x"),
]


def test_predictions_equal_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, lang_score2 string")
    profiles = L.learn_profiles(docs, F.lit(True), 40)
    by_lang = {}
    for lang in ("en", "de"):
        counts = Counter()
        for _, text, own, _ in DOCS:
            if own == lang and text:
                counts.update(brute_grams(text))
        by_lang[lang] = [
            g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:40]
        ]
    got = L.identify(docs, profiles, 40).collect()
    assert len(got) == len(DOCS)
    for r in got:
        assert r.lang_pred == brute_predict(r.text or "", by_lang, 40)
        assert 0 <= r.lang_score <= 1
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {4, 5, 6}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "words here", None)], "doc_id long, text string, lang string")
    rows = L.identify(docs.select("doc_id", "text"), L.learn_profiles(docs, F.lit(True))).collect()
    assert [(r.lang_pred, r.lang_score) for r in rows] == [("und", 0.0)]
    none = docs.limit(0)
    assert L.identify(none.select("doc_id", "text"), L.learn_profiles(none, F.lit(True))).count() == 0


def test_held_out_accuracy(spark):
    small = "/root/testdata/sf0.01"
    got = L.op5_language_id(spark, small)
    known = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang")
    right = got.where("held_out").join(known, "doc_id").agg(F.avg(F.expr("int(lang = lang_pred)")))
    assert right.first()[0] > 0.97


def test_stage_drops_texts_that_match_no_profile(spark):
    rows = [(n, "the cat and the dog", "en", "s", 19) for n in range(20)]
    rows += [(n, "der Hund und die Katze", "de", "s", 22) for n in range(20, 40)]
    rows += [(100, "η γάτα και ο σκύλος", None, "s", 19), (101, "ж" * 50, None, "s", 50)]
    rows += [(102, "the hat", None, "s", 7), (103, "123", None, "s", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    got = L.stage_language(spark, spark.createDataFrame(rows, schema), "").collect()
    assert {r.doc_id: r.lang for r in got} == {
        n: "de" if 20 <= n < 40 else "en" for n in (*range(40), 102)
    }
