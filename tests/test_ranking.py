import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vacantia.functions import fit
from vacantia.operators import dedup, gate, ranking, selection

SCHEMA = (
    "seq long, job_id string, company string, title string, location string, remote boolean, "
    "posted_at timestamp, score int, skip_flags array<string>, workplace string, "
    "office_days_per_month double, years_required double, work_authorization string"
)
DAY = dt.datetime(2026, 7, 1, tzinfo=dt.UTC)


def row(seq, **over):
    base = {
        "job_id": f"j{seq}", "company": f"c{seq}", "title": f"t{seq}", "location": "Remote (US)",
        "remote": True, "posted_at": DAY, "score": 70, "skip_flags": [], "workplace": None,
        "office_days_per_month": None, "years_required": None, "work_authorization": None,
    } | over
    return (seq, *base.values())


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def seqs(df):
    return [r["seq"] for r in df.collect()]


def test_order_terms(spark):
    rows = [
        row(0, score=99, years_required=9.0),
        row(1, score=92, location="San Francisco, CA", remote=False),
        row(2, score=72),
        row(3, score=80, location="Chicago, IL", remote=False),
        row(4, score=72, location="Venice, FL", remote=False, workplace="hybrid"),
        row(5, score=72, posted_at=None),
        row(6, score=72, posted_at=DAY + dt.timedelta(days=1)),
        row(7, score=72),
    ]
    assert seqs(ranking.rank(frame(spark, rows))) == [3, 6, 2, 7, 5, 4, 1, 0]


def python_digest(rows, limit, min_score, per_company, workable_only):
    out, roles, used = [], set(), {}
    for r in rows:
        if r["status"] != "ranked" or r["score"] < min_score:
            continue
        if workable_only and r["location_tier"] == 6:
            continue
        company = (r["company"] or "").strip().lower()
        role = (company, " ".join((r["title"] or "").split()).lower())
        if company:
            if role in roles:
                continue
            roles.add(role)
            if used.get(company, 0) >= per_company:
                continue
            used[company] = used.get(company, 0) + 1
        out.append(r["seq"])
    return out[:limit]


@pytest.mark.parametrize("seed", range(4))
def test_rank_and_digest_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [
        row(
            n,
            company=rng.choice(["", " ", "Acme", " ACME ", "B  C", "b  c", "D", None]),
            title=rng.choice(["DE", " d E ", "d  e", "Other", "Data Engineer"]),
            location=rng.choice(["Remote", "Austin, TX", "Tampa, FL", "Chicago", None]),
            remote=rng.random() < 0.2,
            score=rng.randint(55, 75),
            posted_at=rng.choice([None, DAY, DAY - dt.timedelta(days=3)]),
            workplace=rng.choice([None, "remote", "hybrid", "onsite"]),
            office_days_per_month=rng.choice([None, 1.0, 5.0]),
            years_required=rng.choice([None, 3.0, 8.0]),
        )
        for n in range(300)
    ]
    ranked = ranking.rank_one(frame(spark, rows))
    ordered = [r.asDict() for r in ranked.orderBy(*fit.rank_keys()).collect()]
    epoch = dt.datetime(1970, 1, 1)
    key = lambda r: (
        r["status"] != "ranked", r["location_tier"] == 6, -r["score"], r["location_tier"],
        -((r["posted_at"] or epoch) - epoch).total_seconds(), r["seq"],
    )
    assert [r["seq"] for r in ordered] == [r["seq"] for r in sorted(ordered, key=key)]
    for args in ((10, 65, 2, True), (500, 60, 3, False), (500, 0, 1, True)):
        got = selection.for_digest(ranked, *args).orderBy(*fit.rank_keys())
        assert seqs(got) == python_digest(ordered, *args)


def test_global_rank_is_dense_with_one_hot_key(spark):
    n = 20_000
    df = spark.range(n).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k")
    )
    got = ranking.with_global_rank(df, [F.col("k").asc(), F.col("seq").desc()]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, n + 1))
    pairs = [(r["k"], -r["seq"]) for r in got]
    assert pairs == sorted(pairs)


def test_dedup_keeps_the_first_of_a_hot_id(spark):
    df = spark.range(5000).select(
        (5000 - F.col("id")).alias("seq"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 100).cast("string")).alias("job_id"),
    )
    got = {r["job_id"]: r["seq"] for r in dedup.dedup_in_batch(df).collect()}
    want = {}
    for r in df.collect():
        want[r["job_id"]] = min(r["seq"], want.get(r["job_id"], 10**9))
    assert got == want
    stored = spark.createDataFrame([("hot",), ("1",), ("1",), ("zz",)], "job_id string")
    new = dedup.new_jobs_only(df, stored)
    assert {r["job_id"] for r in new.collect()} == set(want) - {"hot", "1"}
    assert dedup.unseen(dedup.dedup_in_batch(df), stored).count() == new.count()


NOW = dt.datetime(2026, 7, 16, tzinfo=dt.UTC)


def test_budget(spark):
    ages = [1, 14, 15, None, 3, 3]
    rows = [row(n, posted_at=None if a is None else NOW - dt.timedelta(days=a)) for n, a in enumerate(ages)]
    df = frame(spark, rows)
    pick = lambda **k: seqs(gate.select_within_budget(df, NOW, **k))
    assert sorted(pick()) == [0, 1, 2, 3, 4, 5]
    assert sorted(pick(max_age_days=14)) == [0, 1, 3, 4, 5]
    assert pick(max_score_per_run=4) == [0, 4, 5, 1]
    assert sorted(pick(max_age_days=14, max_score_per_run=2)) == [0, 4]
    assert sorted(seqs(gate.deferred(df, df.where("seq < 4")))) == [4, 5]


def test_gate_reads_the_location_only(spark):
    rows = [
        row(0, location="Denver, CO", remote=False, workplace="hybrid", office_days_per_month=1.0),
        row(1, location="Denver, CO", remote=True),
        row(2, location="Chicago", remote=False),
    ]
    assert seqs(gate.workable_gate(frame(spark, rows))) == [1, 2]
    assert seqs(gate.workable_gate(frame(spark, rows), workable_only=False)) == [0, 1, 2]


def test_rank_by_location_drops_nothing(spark):
    rows = [row(0, location="Austin", remote=False), row(1), row(2, location="Tampa", remote=False), row(3)]
    assert seqs(ranking.rank_by_location(frame(spark, rows))) == [1, 3, 2, 0]
