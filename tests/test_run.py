"""Whole runs and streams, with invariants between runs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from vacantia.checks import views as W
from vacantia.operators import dedup, digest_mail, gate, metrics, scoring
from vacantia.operators.store import KeyedStore
from vacantia.plans.run import run_cycle, run_report
from vacantia.session import written
from vacantia.sources import normalise, payloads, registry
from vacantia.streaming import ingest, monitor, receipts
from vacantia.streaming.backlog import Backlog
from vacantia.streaming.run import stream_run

NOW = F.lit  # applied lazily, once there is a session


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, str(tmp_path / "store")).create()


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Postings and replies, written once."""
    path = tmp_path_factory.mktemp("feed")
    return (
        written(W.postings(spark, SMALL), str(path / "postings")),
        written(W.replies(spark, SMALL), str(path / "replies")),
    )


def run(spark, feed, store, **knobs):
    result = run_cycle(
        spark, feed[0], store, replies=feed[1], profile=W.PROFILE, now=NOW(W.NOW), **knobs
    )
    return result, result.counts.collect()[0].asDict()


def test_counts_and_second_run(spark, feed, store):
    result, c = run(spark, feed, store)
    assert c["fetched"] == 200 and c["eligible"] == 143 and c["new"] == 133
    assert c["fetched"] >= c["eligible"] >= c["new"] >= c["scored"] > 0
    assert c["scored"] == result.ranked.count() and c["digest"] == result.digest.count()
    assert c["skipped"] + result.ranked.where("status = 'ranked'").count() == c["scored"]
    assert store.read().count() == c["scored"]
    unscored = c["new"] - c["scored"]
    again, c2 = run(spark, feed, store)
    # Only what was never stored is new again: deferred postings and failed scores.
    assert c2["new"] == unscored and c2["scored"] == 0 and again.digest.isEmpty()
    assert store.read().count() == c["scored"]


def test_budget_drains_over_runs(spark, feed, store):
    everything = run(spark, feed, KeyedStore(spark, store.path + "2").create())[1]["scored"]
    total = 0
    for _ in range(12):
        _, c = run(spark, feed, store, max_score_per_run=20)
        assert c["scored"] <= 20 and c["deferred"] == c["new"] - min(c["new"] - c["deferred"], 20)
        total += c["scored"]
    # Failed scores come back and hold their place in the budget, so not all may be reached.
    assert 0 < total <= everything


def test_knobs(spark, feed, store):
    result, c = run(
        spark, feed, store, workable_only=False, digest_limit=3, min_score=0, per_company=1, max_age_days=700
    )
    assert c["digest"] == 3 and result.ranked.where("location_tier = 6").count() > 0
    # The digest leaves out the last tier whatever the gate does.
    assert result.digest.where("location_tier = 6").isEmpty()
    companies = [r["company"] for r in result.digest.collect() if r["company"]]
    assert len(companies) == len(set(companies))
    order = result.ranked.select("status").collect()
    assert [r["status"] for r in order] == sorted(r["status"] for r in order)


def test_nothing_new_asks_for_no_score(spark, feed, store):
    store.mark_seen(feed[0])

    def scorer(batches):
        for _ in batches:
            raise AssertionError("asked to score")
        yield from ()

    result = run_cycle(spark, feed[0], store, scorer=scorer, now=NOW(W.NOW))
    c = result.counts.collect()[0]
    assert c["new"] == c["scored"] == 0
    with pytest.raises(ValueError, match="either"):
        run_cycle(spark, feed[0], store, now=NOW(W.NOW))


def test_repeated_run_pays_only_for_unusable_replies(spark, feed, store, tmp_path):
    def scorer(batches):
        for batch in batches:
            broken = batch["job_id"].str[0].isin(list("01234567"))
            reply = broken.map({True: "oops", False: '{"score": 70}'})
            yield batch[["job_id"]].assign(reply=reply)

    def second(batches):
        for batch in batches:
            assert batch["job_id"].str[0].isin(list("01234567")).all()
            yield batch[["job_id"]].assign(reply='{"score": 60}')

    log = str(tmp_path / "log")
    attempt = lambda s: run_cycle(
        spark, feed[0], store, scorer=s, now=NOW(W.NOW), reply_log=log, save=False, score_tasks=2
    )
    first = {r["job_id"] for r in attempt(scorer).ranked.collect()}
    scores = {r["job_id"]: r["score"] for r in attempt(second).ranked.collect()}
    assert first and first < set(scores)
    assert {j for j, s in scores.items() if s == 70} == first
    # Everything is in the log now, so nobody is asked.
    assert attempt(second).ranked.count() == len(scores)


def test_landed_documents_to_mail(spark, store, tmp_path):
    landed = str(tmp_path / "landed")
    made = W.payloads(W.postings(spark, SMALL))
    broken = made.where("payload_id = 'lever-0'").withColumns(
        {"slug": F.lit("finix"), "body": F.lit('{"ok": false}')}
    )
    payloads.land_payloads(made.unionByName(broken), landed)
    docs = payloads.payload_scan(spark, landed, NOW(W.NOW))
    status = normalise.source_status(normalise.payload_validate(docs))
    postings = normalise.combine_sources(
        docs,
        registry.boards(spark),
        registry.workday_boards(spark),
        normalise.REGISTRY_CAPS,
        raw=True,
    )

    def scorer(batches):
        for batch in batches:
            score = 40 + batch["prompt"].str.len() % 60
            yield batch[["job_id"]].assign(reply='{"score": ' + score.astype(str) + ', "reason": "ok"}')

    result = run_cycle(
        spark,
        postings,
        store,
        scorer=scorer,
        profile=W.PROFILE,
        now=NOW(W.NOW),
        source_status=status,
        score_tasks=4,
    )
    c = result.counts.collect()[0]
    assert c["source_failures"] == status.where("status = 'failed'").count() > 0
    assert c["digest"] > 0
    outbox = digest_mail.digest_outbox(result.digest, "r1", note="spent")
    receipts = spark.createDataFrame([("r1", "m-1")], "run_id string, message_id string")
    store.mark_emailed(digest_mail.delivered_ids(outbox, receipts))
    emailed = store.read().where("status = 'emailed'")
    assert {r["job_id"] for r in emailed.collect()} == {r["job_id"] for r in result.digest.collect()}
    line = run_report(
        result.counts, status.count(), F.lit(c["digest"]), F.lit("m-1")
    ).collect()[0]["message"]
    parsed = metrics.parse_heartbeat(spark.createDataFrame([(line,)], "message string")).collect()[0]
    assert parsed["health"] == "warn" and parsed["emailed"] == c["digest"]


# --- streams ------------------------------------------------------------------------


def test_stream_ingest_equals_batch(spark, tmp_path):
    landed, out, check = (str(tmp_path / n) for n in ("landed", "out", "check"))
    docs = W.payloads(W.postings(spark, SMALL))
    first = docs.where("source in ('lever', 'ashby')")
    payloads.land_payloads(first, landed)
    ingest.stream_ingest(spark, landed, out, check, NOW(W.NOW)).awaitTermination()
    payloads.land_payloads(docs.where("source not in ('lever', 'ashby')"), landed)
    ingest.stream_ingest(spark, landed, out, check, NOW(W.NOW)).awaitTermination()
    batch = normalise.combine_sources(
        payloads.payload_scan(spark, landed, NOW(W.NOW)),
        registry.boards(spark),
        registry.workday_boards(spark),
    )
    got = spark.read.parquet(out)
    assert {r["batch_id"] for r in got.select("batch_id").distinct().collect()} == {0, 1}
    key = ["source", "job_id", "title", "location", "remote", "description", "posted_at"]
    assert sorted(map(str, got.select(key).collect())) == sorted(map(str, batch.select(key).collect()))


@pytest.mark.parametrize("first", ["path is null", "path is not null"])
def test_stream_ingest_joins_what_lands_apart(spark, tmp_path, first):
    """Searches before their details, and details before their searches."""
    landed, out, check = (str(tmp_path / n) for n in ("landed", "out", "check"))
    docs = W.payloads(W.postings(spark, SMALL)).where("source = 'workday'")
    for part in (first, f"not ({first})"):
        payloads.land_payloads(docs.where(part), landed)
        ingest.stream_ingest(spark, landed, out, check, NOW(W.NOW)).awaitTermination()
    batch = normalise.combine_sources(
        payloads.payload_scan(spark, landed, NOW(W.NOW)),
        registry.boards(spark),
        registry.workday_boards(spark),
    )
    key = ["source", "job_id", "title", "location", "description"]
    got = sorted(map(str, spark.read.parquet(out).select(key).collect()))
    assert got == sorted(map(str, batch.select(key).collect())) and got
    # Nothing comes twice when the same details land again.
    payloads.land_payloads(docs.where("path is not null"), landed)
    ingest.stream_ingest(spark, landed, out, check, NOW(W.NOW)).awaitTermination()
    assert sorted(map(str, spark.read.parquet(out).select(key).collect())) == got


def test_stream_ingest_reads_what_has_just_landed(spark, tmp_path):
    """Hits wait for their first detail, later ones take the newest copy, and no batch reads an earlier one."""
    landed, out, check = (str(tmp_path / n) for n in ("landed", "out", "check"))

    def search(n, *paths):
        hits = [{"title": "T", "externalPath": p} for p in paths]
        body = json.dumps({"jobPostings": hits, "total": len(hits)})
        return (f"s{n}", "acme", f"q{n}", 1, None, body, "workday", f"f{n}", None)

    def detail(n, path, title, day):
        info = {"title": title, "externalUrl": f"https://x/{path}", "jobReqId": path}
        at = dt.datetime(2026, 1, day)
        body = json.dumps({"jobPostingInfo": info})
        return (f"d{n}", "acme", None, None, path, body, "workday", None, at)

    schema = (
        "payload_id string, slug string, query string, page int, path string, body string, "
        "source string, fetch_id string, fetched_at timestamp"
    )
    steps = [
        [search(1, "a", "b", "b"), search(2, "c"), (*search(3, "a")[:1], None, *search(3, "a")[2:])],
        [detail(1, "a", "old", 2), detail(2, "b", None, 2), detail(3, "z", "early", 2)],
        [detail(4, "a", "new", 3), detail(5, "a", "older", 1), search(4, "a", "z")],
    ]
    read = []
    for rows in steps:
        payloads.land_payloads(spark.createDataFrame(rows, schema), landed, packed=True)
        query = ingest.stream_ingest(
            spark, landed, out, check, NOW(W.NOW), packed=True, fetches=True
        )
        query.awaitTermination()
        read.append(sum(p["numInputRows"] for p in query.recentProgress))
    got = spark.read.parquet(out).select("batch_id", "query", "title").collect()
    # b has no title: what its query's fetch gives in that batch goes, "a" with it. c never had a detail.
    assert sorted(map(tuple, got)) == [(2, "q4", "early"), (2, "q4", "new")]
    # Three documents land each time; hits and details are two scans of them.
    assert all(0 < n <= 2 * 3 for n in read)


def split_stream(spark, feed, path, halves):
    """The feed's postings as files that arrive one by one."""
    rows = feed[0].where(halves[0])
    rows.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(feed[0].schema).parquet(path)


def test_stream_dedup_emits_once(spark, feed, store, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    for half in ("seq < 120", "seq >= 80", "seq < 200"):
        stream = split_stream(spark, feed, src, [half])
        ingest.stream_dedup(spark, stream, store, out, check).awaitTermination()
    got = [r["job_id"] for r in spark.read.parquet(out).collect()]
    want = {r["job_id"] for r in feed[0].select("job_id").collect()}
    assert len(got) == len(want) and set(got) == want
    assert store.read().count() == len(want)


def test_stream_replay_after_lost_progress(spark, feed, store, tmp_path):
    """The same files again under a new progress log: written batches are not computed again."""
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    stream = split_stream(spark, feed, src, ["seq >= 0"])
    for attempt in ("check1", "check2"):
        ingest.stream_dedup(spark, stream, store, out, str(tmp_path / attempt)).awaitTermination()
    assert spark.read.parquet(out).count() == dedup.dedup_in_batch(feed[0]).count()


def test_stream_run_equals_batch_runs(spark, feed, store, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    other = KeyedStore(spark, str(tmp_path / "other")).create()
    knobs = {"profile": W.PROFILE, "now": NOW(W.NOW), "max_score_per_run": 15}
    left = feed[0].where("false")
    for n, half in enumerate(("seq < 100", "seq >= 50")):
        stream = split_stream(spark, feed, src, [half])
        stream_run(spark, stream, store, out, check, replies=feed[1], **knobs).awaitTermination()
        # What the first run left over comes with the second one's postings.
        batch = feed[0].where(half).unionByName(left).distinct()
        want = run_cycle(spark, batch, other, replies=feed[1], **knobs)
        left = want.pending
        got = spark.read.parquet(f"{out}/counts/batch_id={n}").collect()[0].asDict()
        assert got == want.counts.collect()[0].asDict()
    assert sorted(map(str, store.read().collect())) == sorted(map(str, other.read().collect()))
    # A replay of both batches changes neither results nor store.
    before = sorted(map(str, spark.read.parquet(f"{out}/ranked").collect()))
    again = spark.readStream.schema(feed[0].schema).option("maxFilesPerTrigger", 1).parquet(src)
    stream_run(
        spark, again, store, out, str(tmp_path / "check2"), replies=feed[1], **knobs
    ).awaitTermination()
    assert sorted(map(str, spark.read.parquet(f"{out}/ranked").collect())) == before
    assert store.read().count() == other.read().count()


def test_stream_run_drains_what_the_budget_defers(spark, feed, store, tmp_path):
    """Five small batches with nothing new: each scores some more of what the first one left, and writes
    no more than arrives and departs."""
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    knobs = {"profile": W.PROFILE, "now": NOW(W.NOW), "max_score_per_run": 12}
    backlog = Backlog(spark, f"{out}-backlog", feed[0].schema)
    scored, left, events = [], [], []
    for n in range(5):
        part = "seq < 60" if n == 0 else "seq = 0"
        stream = split_stream(spark, feed, src, [part])
        stream_run(spark, stream, store, out, check, replies=feed[1], **knobs).awaitTermination()
        scored.append(spark.read.parquet(f"{out}/counts/batch_id={n}").first()["scored"])
        left.append({r.job_id for r in backlog.waiting(n).collect()})
        events.append(spark.read.parquet(f"{out}-backlog/events/batch_id={n}").count())
    assert 0 < scored[0] <= 12 and scored[1] > 0
    assert all(b <= a for a, b in zip(left, left[1:], strict=False)) and len(left[1]) < len(left[0])
    assert events[0] == len(left[0]) > 12
    assert events[1:] == [len(a - b) for a, b in zip(left, left[1:], strict=False)]
    wide = spark.read.schema("job_id string, batch_id long").parquet(f"{out}-backlog/postings")
    assert wide.where("batch_id = 0").count() == len(left[0]) and wide.count() == len(left[0])
    assert store.read().count() == sum(scored)
    usable = {r.job_id for r in scoring.score_many(feed[0].where("seq < 60"), feed[1]).collect()}
    stored = {r.job_id for r in store.read().collect()}
    assert left[0] & usable <= stored | left[-1]


def test_backlog_of_many_batches(spark, tmp_path):
    """Snapshots or none, replays or none: what waits is what a set would hold."""
    schema = "seq long, job_id string, location string, remote boolean, posted_at timestamp, description string"
    names = ("b", "c")
    found = {n: [] for n in names}
    for name, every in zip(names, (2, 100), strict=True):
        waits: dict[str, int] = {}
        for n in range(5):
            ids = [f"j{k}" for k in range(2 * n, 2 * n + 4)]
            rows = [(100 * n + k, j, None, None, None, f"text {j} of {n}") for k, j in enumerate(ids)]
            batch = spark.createDataFrame(rows, schema)
            log = Backlog(spark, str(tmp_path / name), batch.schema, every)
            for _ in range(2 if n == 3 else 1):
                held = log.waiting(n - 1)
                both = log.arrivals(batch, n, held).unionByName(held)
                pending = both.groupBy("job_id").agg(F.min_by(F.struct(*both.columns), "seq").alias("r"))
                pending = pending.select("r.*").where(f"job_id not in ('j{n}', 'j{n + 2}')")
                log.record(batch, n, held, pending)
            for k, j in enumerate(ids):
                waits.setdefault(j, 100 * n + k)
            waits = {j: s for j, s in waits.items() if j not in (f"j{n}", f"j{n + 2}")}
            rows = log.waiting(n).collect()
            assert {r.job_id: r.seq for r in rows} == waits
            texts = log.texts(log.waiting(n), batch, n + 1)
            assert {r.job_id: r.description for r in texts.collect()} == {
                j: f"text {j} of {s // 100}" for j, s in waits.items()
            }
            found[name].append(waits)
    assert found["b"] == found["c"]


def lines_stream(spark, src, rows):
    df = spark.createDataFrame([(t, m) for t, m in rows], "ts string, message string")
    df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema("ts timestamp, message string").parquet(src)


def test_stream_daily_summary_drops_late_lines(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    line = "posting run health={} scored={} emailed=1"
    batches = [
        [("2026-07-01 10:00:00", line.format("ok", 5)), ("2026-07-02 09:00:00", line.format("error", 7))],
        [("2026-07-01 23:00:00", line.format("ok", 100)), ("2026-07-03 09:00:00", line.format("ok", 1))],
        [("2026-07-05 00:00:00", "unrelated"), ("2026-07-05 02:00:00", line.format("ok", 1))],
    ]
    for rows in batches:
        days = monitor.stream_daily_summary(lines_stream(spark, src, rows), 0.004)
        monitor.write_stream(days, out, check).awaitTermination()
    got = spark.read.parquet(out).orderBy("day").collect()
    assert [(str(r["day"])[:10], r["runs"], r["scored"], r["errors"]) for r in got] == [
        ("2026-07-01", 1, 5, 0), ("2026-07-02", 1, 7, 1), ("2026-07-03", 1, 1, 0),
    ]


def test_stream_alarms_update_open_periods(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    for second, message in (("10", "x health=ok"), ("20", "x health=error")):
        stream = lines_stream(spark, src, [(f"2026-07-01 00:00:{second}", message)])
        monitor.write_updates(monitor.stream_alarms(stream), out, check).awaitTermination()
    got = spark.read.parquet(out).groupBy("period_start").agg(F.max_by("alarm", "batch_id").alias("alarm"))
    assert [r["alarm"] for r in got.collect()] == [True]


def test_stream_no_runs_alarms_while_nothing_comes(spark, tmp_path):
    """An outage that lasts until now: only the clock goes on. The stream ends up as the batch form."""
    lines, ticks, out, check = (str(tmp_path / n) for n in ("lines", "ticks", "out", "check"))
    start, hour = dt.datetime(2026, 7, 1), dt.timedelta(hours=1)
    arrivals = [(["2026-07-01 02:00:00", "2026-07-01 02:05:00"], 0, 5), ([], 5, 9), ([], 9, 14)]
    found = []
    for runs, a, b in arrivals:
        run_stream = lines_stream(spark, lines, [(t, "run") for t in runs])
        tick_stream = lines_stream(spark, ticks, [(str(start + n * hour), "tick") for n in range(a, b + 1)])
        alarms = monitor.stream_no_runs(run_stream, tick_stream, F.lit(start), 4 * 3600)
        monitor.write_stream(alarms, out, check).awaitTermination()
        rows = spark.read.schema(alarms.schema).parquet(out).orderBy("period_start").collect()
        found.append([(r.runs, r.alarm) for r in rows])
    assert found == [[(2, False)], [(2, False), (0, True)], [(2, False), (0, True), (0, True)]]
    every = spark.read.schema("ts timestamp, message string").parquet(lines)
    batch = metrics.alarm_no_runs(every, F.lit(start), F.lit(start + 12 * hour), 4 * 3600)
    assert batch.orderBy("period_start").collect() == rows


def test_stream_receipts_marks_once_and_reports_lost_mail(spark, store, tmp_path):
    sent, got, out, check = (str(tmp_path / n) for n in ("sent", "got", "out", "check"))
    mail = "run_id string, sent_at timestamp, job_ids array<string>"
    receipt = "run_id string, message_id string, received_at timestamp"

    def at(day, hour=0):
        return dt.datetime(2026, 7, day, hour)

    def step(mails, receipts_):
        for path, rows, schema in ((sent, mails, mail), (got, receipts_, receipt)):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        receipts.stream_receipts(
            spark,
            spark.readStream.schema(mail).parquet(sent),
            spark.readStream.schema(receipt).parquet(got),
            store, out, check,
        ).awaitTermination()
        rows = spark.read.parquet(out).collect()
        emailed = {r.job_id for r in store.read().where("status = 'emailed'").collect()}
        return sorted({(r.run_id, r.message_id) for r in rows}, key=str), emailed

    first = step(
        [("a", at(1), ["j1", "j2"]), ("b", at(1, 1), ["j3"]), ("c", at(1, 2), ["j4"])],
        [("a", "m-1", at(1, 3)), ("a", "m-1", at(1, 4)), ("nobody", "m-9", at(1, 3))],
    )
    assert first == ([("a", "m-1")], {"j1", "j2"})
    # Late by the mail's patience; the mails given up are named once both streams have passed them.
    second = step([("d", at(9), ["j5"])], [("b", "m-2", at(4)), ("a", "m-1", at(1, 5)), ("x", "m-8", at(9))])
    assert second[1] == {"j1", "j2"}
    assert second[0] == [("a", "m-1"), ("b", None), ("c", None)]
    third = step([("e", at(20), [])], [("d", "m-3", at(9, 1)), ("y", "m-7", at(20))])
    assert third[1] == {"j1", "j2", "j5"}
    assert third[0] == [("a", "m-1"), ("b", None), ("c", None), ("d", "m-3")]


# --- plans --------------------------------------------------------------------------


def plan(df):
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "5000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, feed, tmp_path):
    new = plan(dedup.new_jobs_only(gate.keep_worth_scoring(feed[0]), feed[1]))
    assert new.count("WindowGroupLimit") == 2 and "CartesianProduct" not in new
    # The feed is shuffled by id once, for the dedup, and the anti-join reuses it.
    assert new.count("Exchange hashpartitioning") <= 2
    docs = written(W.payloads(feed[0]), str(tmp_path / "docs"), partition_by="source")
    for source in ("greenhouse", "ashby", "adzuna", "usajobs"):
        parsed = plan(normalise.normalise(docs, source, registry.boards(spark)))
        assert parsed.count("from_json") == 1, source
        assert "PartitionFilters: [isnotnull(source" in parsed
        assert "Exchange hashpartitioning" not in parsed, source
    # Text is cleaned after the selected rows are picked, and the gate cleans none but one source's.
    feed_ = normalise.combine_sources(docs, registry.boards(spark), raw=True)
    picked = written(feed_.select("job_id", "seq").limit(9), str(tmp_path / "picked"))
    wide = plan(normalise.described(feed_.join(picked, ["job_id", "seq"], "left_semi")))
    for branch in wide.split("FileScan")[:-1]:
        assert "ArrowEvalPython" not in branch or branch.index("ArrowEvalPython") < branch.index("LeftSemi")
    assert plan(feed_.select("seq", "job_id", "location", "remote")).count("ArrowEvalPython") == 1
    top = plan(gate.select_within_budget(feed[0], NOW(W.NOW), 14, 200))
    assert "TakeOrderedAndProject" in top and "PushedFilters: [Or(IsNull(posted_at)" in top


def test_every_document_status_is_counted(spark, feed):
    docs = W.payloads(feed[0])
    status = normalise.payload_validate(docs)
    assert status.count() == docs.where("path is null").count()
    bodies = docs.where("source = 'usajobs'").select("body").collect()
    assert all(isinstance(json.loads(r["body"]), dict) for r in bodies)
