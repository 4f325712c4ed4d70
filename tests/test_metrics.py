import datetime as dt

import pytest
from pyspark.sql import functions as F

from vacantia.operators import metrics

COUNTS = ["fetched", "eligible", "new", "scored", "skipped", "digest", "source_failures", "deferred"]
T0 = dt.datetime(2026, 7, 16, tzinfo=dt.UTC)


def runs(spark, *rows):
    base = dict.fromkeys(COUNTS, 0) | {"fetched": 100, "source_count": 4, "emailed": 0, "message_id": None}
    names = list(base)
    schema = ", ".join(f"{n} {'string' if n == 'message_id' else 'long'}" for n in names)
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], schema)


@pytest.mark.parametrize(
    ("run", "health", "headline"),
    [
        ({"source_failures": 4, "fetched": 0}, "error", "all sources failed — fetched nothing"),
        ({"new": 9, "deferred": 2}, "error", "scored 0 of 7 — scorer down (API/credit?)"),
        ({"new": 9, "deferred": 9}, "ok", "healthy"),
        ({"source_failures": 1, "new": 2, "scored": 1}, "warn", "1/4 sources failed"),
        ({"fetched": 0}, "warn", "0 jobs fetched with no failures — boards empty/changed?"),
        ({}, "ok", "healthy"),
        ({"source_count": 0}, "ok", "healthy"),
    ],
)
def test_health(spark, run, health, headline):
    got = metrics.assess_run(runs(spark, run)).collect()[0]
    assert (got["health"], got["headline"]) == (health, headline)


def test_heartbeat_round_trip(spark):
    rows = runs(spark, {"scored": 91, "emailed": 10, "message_id": "m-1", "new": 91}, {"message_id": ""})
    lines = metrics.heartbeat_line(metrics.assess_run(rows), marker="my run").select("message")
    texts = [r["message"] for r in lines.collect()]
    assert texts[0] == (
        "my run health=ok (healthy) | fetched=100 eligible=0 new=91 scored=91 skipped=0 digest=0 "
        "deferred=0 sources_failed=0/4 emailed=10 msg=m-1"
    )
    assert texts[1].endswith("emailed=0 msg=-")
    extra = spark.createDataFrame(
        [("HTTP Request: POST ... 200 OK",), ("health=ok scored=5",), ("my run health=warn",), ("my run",)],
        "message string",
    )
    got = metrics.parse_heartbeat(lines.union(extra), marker="my run").collect()
    assert [(r["health"], r["scored"], r["emailed"]) for r in got] == [("ok", 91, 10), ("ok", 0, 0), ("warn", 0, 0)]


def test_spend(spark):
    rows = runs(spark, {"scored": 75, "digest": 6}, {"scored": 1, "digest": 1})
    many, one = (r["note"] for r in metrics.spend_estimate(rows, "vendor/HAIKU-x").collect())
    assert " 75 new jobs " in many and " the 6 " in many and "~$0.30" in many
    assert " 1 new job " in one and "jobs" not in one
    costs = [metrics.spend_estimate(rows, model).first()["cost"] for model in ("a-sonnet-b", "other")]
    assert costs == pytest.approx([0.9, 0.6])
    assert metrics.daily_score_rate("haiku-9") < metrics.daily_score_rate("other")


def test_summary_and_text(spark):
    parsed = spark.createDataFrame(
        [("ok", 10, 1), ("warn", 15, 3), ("ok", 15, 1)], "health string, scored long, emailed long"
    )
    row = metrics.daily_text(metrics.summarize(parsed, 0.004), app="app").collect()[0]
    assert (row["runs"], row["scored"], row["emailed"], row["warns"], row["errors"]) == (3, 40, 5, 1, 0)
    assert row["healthy"] and round(row["cost"], 3) == 0.16
    assert row["subject"] == "app daily check — 5 matches, 3 runs"
    assert "Everything healthy. (1 run(s) had a minor warning.)" in row["text"] and "$0.16" in row["text"]
    bad = parsed.union(spark.createDataFrame([("error", 0, 0)], parsed.schema))
    row = metrics.daily_text(metrics.summarize(bad, 0.004)).collect()[0]
    assert "1 run(s) reported an ERROR" in row["text"] and "minor warning" not in row["text"]
    empty = metrics.summarize(parsed.where("false"), 0.004).collect()[0]
    assert (empty["runs"], empty["scored"], empty["cost"], empty["healthy"]) == (0, 0, 0.0, True)


def lines(spark, *rows):
    data = [(T0 + dt.timedelta(seconds=s), m) for s, m in rows]
    return spark.createDataFrame(data, "ts timestamp, message string")


def test_daily_window(spark):
    df = lines(spark, (0, "posting run a"), (1, "posting run b"), (86400, "posting run c"), (86401, "x"), (86402, "posting run z"))
    end = T0 + dt.timedelta(seconds=86401)
    assert {r["message"][-1] for r in metrics.daily_window(df, end).collect()} == {"c", "b"}
    assert [r["message"][-1] for r in metrics.daily_window(df, end, limit=1).collect()] == ["c"]
    many = spark.range(5000).select(
        F.lit(end).alias("ts"), F.concat(F.lit(metrics.DEFAULT_MARKER), F.col("id")).alias("message")
    )
    assert metrics.daily_window(many, end).count() == 5000


def test_alarms(spark):
    df = lines(spark, (0, "x health=error"), (299, "x health=error"), (300, "ok"), (28800 * 3, "y"))
    got = {r["period_start"]: (r["unhealthy"], r["alarm"]) for r in metrics.alarm_unhealthy(df).collect()}
    first = T0.replace(tzinfo=None)
    assert got[first] == (2, True) and got[first + dt.timedelta(seconds=300)] == (0, False)
    assert len(got) == 3
    span = T0, T0 + dt.timedelta(seconds=28800 * 6)
    runs_ = metrics.alarm_no_runs(df, *span).orderBy("period_start").collect()
    assert [r["runs"] for r in runs_] == [3, 0, 0, 1, 0, 0]
    assert [r["alarm"] for r in runs_] == [False, True, True, False, True, True]
    errors = metrics.alarm_errors(df, F.lit(2)).orderBy("period_start").collect()
    assert [r["errors"] for r in errors] == [4, 2, 2]
    never = metrics.alarm_no_runs(df.where("false"), *span).collect()
    assert len(never) == 6 and all(r["alarm"] for r in never)
    assert metrics.alarm_no_runs(df, T0, T0).isEmpty()
