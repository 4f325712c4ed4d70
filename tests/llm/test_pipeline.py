import corpus_pipeline
from vacantia.llm.language_id import identify, learn_profiles
from vacantia.llm.near_dedup import classes
from vacantia.llm.pii import find_spans, redact
from vacantia.llm.quality import judge, measure, references

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SMALL = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language ID", "quality rules", "MinHash near-dedup", "PII", "best-fit packing",
    ]


def test_run_equals_its_operators_one_by_one(spark):
    from pyspark.sql import functions as F

    from tests.llm.test_packing import check
    from vacantia.llm.common import crc_fold, prepared

    docs = prepared(spark).read.parquet(f"{SMALL}/documents.parquet")
    profiles = learn_profiles(docs, ~crc_fold(F.col("doc_id"), 0))
    langs = {r.doc_id: r.lang_pred for r in identify(docs, profiles).collect()}
    rows = [(r.doc_id, r.text, langs[r.doc_id]) for r in docs.collect() if langs[r.doc_id] != "und"]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    features = measure(spark, frame)
    kept = {r.doc_id for r in judge(features, references(features)).where("kept").collect()}
    frame = frame.where(F.col("doc_id").isin(list(kept)))
    first = {r.class_id for r in classes(spark, frame).collect()}
    left = [(d, redact(t, find_spans(t))) for d, t, _ in rows if d in first]
    assert 0 < len(left) < len(kept) < len(rows)
    check(corpus_pipeline.run(spark, SMALL).collect(), left)


def test_stages_keep_columns_and_odd_rows(spark):
    text = "the house of the man and the dog was in the street by the sea for a day with him"
    rows = [
        (1, text, "en", "s", 80), (1, text, "en", "s", 80), (2, None, None, None, None), (3, "", "en", "s", 0),
        (None, text + " again and again", "en", "s", 90), (4, "1 2 3", "de", "s", 5),
        (5, text.replace("dog", "cat") + " " + " ".join(f"w{n}" for n in range(40)), None, "s", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SMALL)
        if n < 4:
            assert docs.columns == COLUMNS
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {1, None, 5}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SMALL)
    assert empty.count() == 0
