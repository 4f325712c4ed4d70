import datetime as dt

import pytest
from pyspark.sql import functions as F

from vacantia import schemas as S
from vacantia.operators.store import KeyedStore, store_item, store_scored_item
from vacantia.session import written

POSTING = (
    "seq long, job_id string, source string, source_id string, company string, title string, "
    "url string, location string, remote boolean, salary string, salary_is_estimated boolean, "
    "description string, posted_at timestamp, fetched_at timestamp"
)
AT = dt.datetime(2026, 7, 16, 9, 30, tzinfo=dt.UTC)


def posting(seq, job_id, **over):
    base = {
        "source": "lever", "source_id": str(seq), "company": "c", "title": "t", "url": "u",
        "location": "Tampa", "remote": False, "salary": "$1", "salary_is_estimated": False,
        "description": "long", "posted_at": AT, "fetched_at": AT,
    } | over
    return (seq, job_id, *base.values())


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, str(tmp_path / "store")).create()


def frame(spark, *rows):
    return spark.createDataFrame(rows, POSTING)


def contents(store):
    return {r["job_id"]: r.asDict() for r in store.read().collect()}


def test_item_shape(spark):
    full = store_item(frame(spark, posting(1, "a", posted_at=AT.replace(microsecond=5000)))).collect()[0]
    assert full["status"] == "new" and "description" not in full
    assert full["fetched_at"] == AT.isoformat()
    assert full["posted_at"] == AT.replace(microsecond=5000).isoformat()
    bare = store_item(frame(spark, posting(1, "a", location="", salary="", posted_at=None))).collect()[0]
    assert [bare[c] for c in ("location", "salary", "salary_is_estimated", "posted_at")] == [None] * 4


def test_mark_seen_is_idempotent_and_last_write_wins(spark, store):
    store.mark_seen(frame(spark, posting(1, "a1"), posting(2, "b1"), posting(3, "a1", title="later")))
    first = contents(store)
    assert set(first) == {"a1", "b1"} and first["a1"]["title"] == "later"
    batch = frame(spark, posting(9, "b1", title="new"), posting(10, "b2"))
    store.mark_seen(batch)
    store.mark_seen(batch)
    after = contents(store)
    assert set(after) == {"a1", "b1", "b2"} and after["b1"]["title"] == "new"
    assert after["a1"] == first["a1"]
    assert store.read().count() == 3
    store.mark_seen(batch.where("false"))
    assert contents(store) == after


def test_scored_items(spark, store):
    scored = frame(spark, posting(1, "a1"), posting(2, "a2")).withColumns(
        {
            "score": F.lit(80), "reason": F.lit("r"), "location_tier": F.lit(3),
            "skip_flags": F.when(F.col("seq") == 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")),
            "skip_reason": F.when(F.col("seq") == 2, "because"),
            "status": F.when(F.col("seq") == 2, "skipped").otherwise("ranked"),
        }
    )
    store.mark_seen(frame(spark, posting(1, "a1")))
    store.save_new(scored)
    got = contents(store)
    assert (got["a1"]["status"], got["a1"]["fit_score"], got["a1"]["skip_flags"]) == ("new", 80, ["x"])
    assert (got["a2"]["status"], got["a2"]["skip_reason"], got["a2"]["skip_flags"]) == ("skipped", "because", None)
    assert {r["fit_reason"] for r in store_scored_item(scored).collect()} == {"r"}


def test_mark_emailed_keeps_the_rest_and_creates_unknown_ids(spark, store):
    store.mark_seen(frame(spark, posting(1, "a1"), posting(2, "a2")))
    store.mark_emailed(spark.createDataFrame([("a1",), ("ff",)], "job_id string"))
    got = contents(store)
    assert (got["a1"]["status"], got["a1"]["title"]) == ("emailed", "t")
    assert got["a2"]["status"] == "new"
    assert got["ff"]["status"] == "emailed" and got["ff"]["source"] is None


def test_get_filters_in_the_scan(spark, store):
    store.mark_seen(frame(spark, posting(1, "a1"), posting(2, "b2")))
    assert store.get("b2").collect()[0]["source_id"] == "2"
    assert store.get("zz").isEmpty()
    assert "EqualTo(job_id,b2)" in store.get("b2")._jdf.queryExecution().toString()


def test_a_write_adds_its_own_rows_only(spark, store):
    store.mark_seen(frame(spark, *[posting(n, f"a{n}") for n in range(500)]))
    before = set(store._rows().inputFiles())
    store.mark_seen(frame(spark, *[posting(n, f"a{n}", title="new") for n in range(490, 520)]))
    added = set(store._rows().inputFiles()) - before
    assert before <= set(store._rows().inputFiles())
    assert spark.read.parquet(*added).count() == 30
    assert store.read().count() == 520 and store.ids().distinct().count() == 520
    assert store.read().where("title = 'new'").count() == 30
    assert {r["job_id"] for r in store.near(frame(spark, posting(1, "a3"), posting(2, "x"))).collect()} == {"a3"}


def test_a_run_again_replaces_what_it_wrote(spark, store):
    for title in ("once", "again"):
        store.mark_seen(frame(spark, posting(1, "a1", title=title)), run=f"{1:020d}")
    assert [r["title"] for r in store._rows().where("job_id = 'a1'").collect()] == ["again"]


def test_compaction_keeps_the_latest_rows(spark, store, tmp_path):
    store.mark_seen(frame(spark, posting(1, "a1"), posting(2, "b2")))
    store.mark_seen(frame(spark, posting(3, "b2", title="later")))
    before = contents(store)
    small = store.compacted(str(tmp_path / "compacted"))
    assert contents(small) == before == contents(store)
    assert small.ids().count() == 2
    small.mark_seen(frame(spark, posting(4, "a1", title="after")))
    assert contents(small)["a1"]["title"] == "after"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_buckets_answer_as_the_plain_store_does(spark, tmp_path):
    """Compacted, written to again, and opened by a session that does not know the table."""
    names = [f.name for f in S.STORE.fields]

    def rows(ids, status):
        df = spark.createDataFrame([(i,) for i in ids], "job_id string")
        return df.select(*[
            F.col("job_id") if n == "job_id"
            else F.lit(status if n == "status" else None).cast(S.STORE[n].dataType).alias(n)
            for n in names
        ])

    plain = KeyedStore(spark, str(tmp_path / "plain")).create()
    plain.upsert(rows([f"j{k}" for k in range(50)], "new"))
    plain.upsert(rows(["j7", "j8"], "emailed"))
    store = plain.compacted(str(tmp_path / "buckets"), buckets=4)
    again = [f"j{k}" for k in range(40, 60)]
    for s in (plain, store):
        s.upsert(rows(again, "skipped"))
    spark.sql(f"DROP TABLE {store._table()}")  # its files stay
    store = KeyedStore(spark, str(tmp_path / "buckets"), 4)
    key = lambda df: sorted((r.job_id, r.status) for r in df.collect())
    assert key(store.read()) == key(plain.read()) and store.read().count() == 60
    asked = written(spark.createDataFrame([("j7",), ("j45",), ("j99",)], "job_id string"), str(tmp_path / "asked"))
    assert key(store.near(asked)) == key(plain.near(asked)) == [("j45", "skipped"), ("j7", "emailed")]
    assert [r.job_id for r in store.unseen(asked).collect()] == ["j99"]
    assert key(store.get("j8")) == [("j8", "emailed")] and key(store.get("j55")) == [("j55", "skipped")]
    store.mark_emailed(asked.where("job_id = 'j45'"))
    assert key(store.get("j45")) == [("j45", "emailed")]
    # One id: one bucket, and its filter at the scan. A big batch: the base is joined where it lies.
    one = plan_of(store.get("j8"))
    assert "SelectedBucketsCount: 1 out of 4" in one and "EqualTo(job_id,j8)" in one
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        looked_up = plan_of(store._parts()[0].join(asked, "job_id", "left_semi"))
        assert looked_up.count("Exchange hashpartitioning") == 1
        assert "SelectedBucketsCount: 4 out of 4" in looked_up
        assert "Exchange" not in looked_up.split("FileScan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
