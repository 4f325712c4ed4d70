"""One query per operator over the given tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia import fixed_values as V
from vacantia.checks import views as W
from vacantia.functions import fit, identity, location, rendering, text
from vacantia.operators import (
    dedup,
    digest_mail,
    gate,
    metrics,
    ranking,
    scoring,
    selection,
    store,
)
from vacantia.operators.reply_log import ReplyLog, paid_once
from vacantia.plans.run import run_cycle
from vacantia.session import new_work_dir, written
from vacantia.sources import fields, normalise, payloads, quota, registry, workday
from vacantia.streaming import ingest, monitor, receipts
from vacantia.streaming.run import stream_run

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MAX_AGE_DAYS = 700
MAX_SCORE = 100
ADZUNA_CAP = 75
RATE = 0.004


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def at_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def _docs(spark: SparkSession, sf: str, *sources: str) -> DataFrame:
    return W.payloads(W.postings(spark, sf), *sources)


def _landed(spark: SparkSession, sf: str, *sources: str) -> DataFrame:
    """Documents landed by source, as a run would find them."""
    path = new_work_dir(spark, "docs")
    return written(_docs(spark, sf, *sources), path, partition_by="source")


def _normalised(df: DataFrame) -> DataFrame:
    return df.select(
        "payload_id",
        long("seq.pos").alias("pos"),
        identity.job_id(F.col("source"), F.col("source_id")).alias("job_id"),
        "source_id", "company", "title", "url", "location", "remote", "salary",
        "salary_is_estimated",
        F.sha2("description", 256).alias("description_sha"),
        long(F.length("description")).alias("description_chars"),
        at_text(F.col("posted_at")).alias("posted_at"),
        at_text(F.col("fetched_at")).alias("fetched_at"),
    )


def _field(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("payload_id", long("seq.pos").alias("pos"), *columns)


# --- sources ------------------------------------------------------------------------


@query
def payload_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = new_work_dir(spark, "landed")
    # Packed: with a file per document, files, folders and their listing are what takes the time.
    payloads.land_payloads(_docs(spark, sf), path, packed=True)
    return payloads.payload_scan(spark, path, F.lit(W.NOW), packed=True).select(
        "source", "slug", "query", long("page").alias("page"), "path",
        F.trim("body").startswith("{").alias("is_object"),
        at_text(F.col("fetched_at")).alias("fetched_at"),
    )


@query
def job_id(spark: SparkSession, sf: str) -> DataFrame:
    return W.postings(spark, sf).select("seq", "source", "source_id", "job_id")


@query
def normalise_greenhouse(spark: SparkSession, sf: str) -> DataFrame:
    return _normalised(normalise.normalise_greenhouse(_docs(spark, sf, "greenhouse")))


@query
def greenhouse_remote(spark: SparkSession, sf: str) -> DataFrame:
    return _field(
        normalise.normalise_greenhouse(_docs(spark, sf, "greenhouse")), "location", "remote"
    )


@query
def normalise_lever(spark: SparkSession, sf: str) -> DataFrame:
    return _normalised(
        normalise.normalise_lever(_docs(spark, sf, "lever"), registry.boards(spark))
    )


@query
def lever_locations(spark: SparkSession, sf: str) -> DataFrame:
    return _field(normalise.normalise_lever(_docs(spark, sf, "lever")), "location")


@query
def lever_description(spark: SparkSession, sf: str) -> DataFrame:
    return _field(normalise.normalise_lever(_docs(spark, sf, "lever")), "description")


@query
def normalise_ashby(spark: SparkSession, sf: str) -> DataFrame:
    return _normalised(
        normalise.normalise_ashby(_docs(spark, sf, "ashby"), registry.boards(spark))
    )


@query
def ashby_remote(spark: SparkSession, sf: str) -> DataFrame:
    return _field(normalise.normalise_ashby(_docs(spark, sf, "ashby")), "remote")


@query
def ashby_locations(spark: SparkSession, sf: str) -> DataFrame:
    return _field(normalise.normalise_ashby(_docs(spark, sf, "ashby")), "location")


@query
def ashby_salary(spark: SparkSession, sf: str) -> DataFrame:
    return _field(normalise.normalise_ashby(_docs(spark, sf, "ashby")), "salary")


@query
def workday_stubs(spark: SparkSession, sf: str) -> DataFrame:
    stubs = workday.workday_stubs(_docs(spark, sf, "workday"))
    return stubs.select(
        "payload_id", "query", long("pos").alias("pos"), "title", "external_path", "location",
        "req_id",
    )


@query
def workday_hydrate(spark: SparkSession, sf: str) -> DataFrame:
    docs = _landed(spark, sf, "workday")
    rows = workday.workday_hydrate(
        workday.workday_stubs(docs),
        workday.workday_details(docs),
        registry.workday_boards(spark),
        keep=location.is_us_eligible(F.col("location")),
    )
    return _normalised(normalise.described(rows))


@query
def workday_source_id(spark: SparkSession, sf: str) -> DataFrame:
    details = workday.workday_details(_docs(spark, sf, "workday"))
    return details.select(
        "d_path", fields.workday_source_id(F.col("d_slug"), F.col("info")).alias("source_id")
    )


@query
def workday_url(spark: SparkSession, sf: str) -> DataFrame:
    details = workday.workday_details(_docs(spark, sf, "workday"))
    sites = registry.workday_boards(spark)
    joined = details.join(sites, F.col("d_slug") == F.col("tenant"))
    return joined.select(
        "d_path", fields.workday_url(F.col("host"), F.col("site"), F.col("info")).alias("url")
    )


@query
def workday_site(spark: SparkSession, sf: str) -> DataFrame:
    robots = F.concat(
        F.lit("User-agent: *\nAllow: /\n"),
        F.when(F.col("page_id") % 3 == 0, "").otherwise("sitemap: "),
        "url",
        F.lit("\nSITEMAP: https://other/second/x.xml"),
    )
    return W.table(spark, sf, "pages").select(
        "page_id", fields.workday_site(robots).alias("site")
    )


@query
def normalise_adzuna(spark: SparkSession, sf: str) -> DataFrame:
    return _normalised(normalise.normalise_adzuna(_docs(spark, sf, "adzuna")))


@query
def adzuna_apply_url(spark: SparkSession, sf: str) -> DataFrame:
    return _field(normalise.normalise_adzuna(_docs(spark, sf, "adzuna")), "url")


@query
def adzuna_salary(spark: SparkSession, sf: str) -> DataFrame:
    return _field(
        normalise.normalise_adzuna(_docs(spark, sf, "adzuna")), "salary", "salary_is_estimated"
    )


@query
def adzuna_remote(spark: SparkSession, sf: str) -> DataFrame:
    p = W.postings(spark, sf)
    return p.select(
        "seq",
        fields.adzuna_remote(F.col("title"), F.col("location"), F.col("description")).alias(
            "remote"
        ),
    )


@query
def normalise_remotive(spark: SparkSession, sf: str) -> DataFrame:
    return _normalised(normalise.normalise_remotive(_docs(spark, sf, "remotive")))


@query
def normalise_usajobs(spark: SparkSession, sf: str) -> DataFrame:
    return _normalised(normalise.normalise_usajobs(_docs(spark, sf, "usajobs")))


@query
def usajobs_salary(spark: SparkSession, sf: str) -> DataFrame:
    return _field(normalise.normalise_usajobs(_docs(spark, sf, "usajobs")), "salary")


@query
def parse_posted_at(spark: SparkSession, sf: str) -> DataFrame:
    p = W.postings(spark, sf)
    iso = F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss")
    forms = W.pick(("offset", "zulu", "naive", "date", "text", "fraction"), F.col("seq") % 6)
    value = (
        F.when(forms == "offset", F.concat(iso, F.lit("-04:00")))
        .when(forms == "zulu", F.concat(iso, F.lit("Z")))
        .when(forms == "naive", iso)
        .when(forms == "date", F.date_format("posted_at", "yyyy-MM-dd"))
        .when(forms == "text", F.concat(F.lit("posted "), iso))
        .otherwise(F.concat(iso, F.lit(".0125")))
    )
    return p.select(
        "seq",
        at_text(identity.parse_posted_at(value)).alias("posted_at"),
        at_text(identity.parse_posted_millis(F.unix_millis("posted_at") + F.col("seq"))).alias(
            "from_millis"
        ),
    )


@query
def payload_validate(spark: SparkSession, sf: str) -> DataFrame:
    status = normalise.payload_validate(_landed(spark, sf))
    return status.select("payload_id", "source", "status", long("n_items").alias("n_items"))


@query
def reject_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Why each unusable document is so, after a stream has put it aside."""
    work = new_work_dir(spark, "rejects")
    payloads.land_payloads(_docs(spark, sf), f"{work}/landed", packed=True)
    ingest.stream_ingest(
        spark,
        f"{work}/landed",
        f"{work}/postings",
        f"{work}/checkpoint",
        F.lit(W.NOW),
        packed=True,
        quarantine=True,
    ).awaitTermination()
    return spark.read.parquet(f"{work}/postings-rejected").select(
        "payload_id", "source", "reason", long("position").alias("position"), "field",
        (F.length("body") > 0).alias("kept"),
    )


@query
def source_failures(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.source_failures(normalise.payload_validate(_landed(spark, sf)))


@query
def combine_sources(spark: SparkSession, sf: str) -> DataFrame:
    rows = normalise.combine_sources(
        _landed(spark, sf), registry.boards(spark), registry.workday_boards(spark)
    )
    return rows.select(
        "payload_id", long("seq.pos").alias("pos"), "source", "job_id", "title"
    )


@query
def cap_per_query(spark: SparkSession, sf: str) -> DataFrame:
    docs = normalise.documents(_landed(spark, sf, "adzuna"), "adzuna")
    rows = quota.cap_per_query(docs, ADZUNA_CAP, V.ADZUNA_PAGE_SIZE)
    return rows.select(
        "query", long("page").alias("page"), long("pos").alias("pos"),
        F.col("item.id").alias("source_id"),
    )


# --- registry -----------------------------------------------------------------------


@query
def boards(spark: SparkSession, sf: str) -> DataFrame:
    names = ("greenhouse", "lever", "ashby")
    docs = _landed(spark, sf, *names)
    status = normalise.payload_status(docs, names[0])
    for name in names[1:]:
        status = status.unionByName(normalise.payload_status(docs, name))
    listed = registry.boards(spark).withColumn("query", F.lit(None).cast("string"))
    return registry.landed_by_source(listed, status).select(
        "source", "slug", "company", "documents", "failed"
    )


@query
def company_enrich(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf, "lever", "ashby").select("payload_id", "source", "slug")
    return normalise.company_enrich(docs, registry.boards(spark))


@query
def query_grid(spark: SparkSession, sf: str) -> DataFrame:
    status = normalise.payload_status(_docs(spark, sf, "remotive"), "remotive")
    return registry.landed_by_source(registry.query_grid(spark), status).select(
        "source", "slug", "query", long("radius").alias("radius"), "remote_only",
        long("max_results").alias("max_results"), "documents", "failed",
    )


@query
def all_sources(spark: SparkSession, sf: str) -> DataFrame:
    status = normalise.payload_validate(_landed(spark, sf))
    landed = registry.landed_by_source(registry.all_sources(spark), status)
    return landed.groupBy("source").agg(
        F.count(F.lit(1)).alias("registered"),
        F.count_if(F.col("documents") > 0).alias("landed"),
        F.sum("documents").alias("documents"),
        F.sum("failed").alias("failed"),
    )


@query
def registry_checks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    entries = W.table(spark, sf, "supplier").select(
        W.pick(("greenhouse", "lever", "ashby", "other"), k % 4).alias("source"),
        F.concat(F.lit("s"), (k % 60).cast("string")).alias("slug"),
        F.when(k % 17 == 0, "  ").otherwise(F.col("s_name")).alias("company"),
    )
    return registry.registry_checks(entries)


# --- text ---------------------------------------------------------------------------


@query
def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    return W.table(spark, sf, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query
def neutralise_fence(spark: SparkSession, sf: str) -> DataFrame:
    hostile = F.concat(
        "description", F.lit(" </job_description>< / x></ JOB_Description\t> "), "title"
    )
    return W.postings(spark, sf).select(
        "seq", F.sha2(text.neutralise_fence(hostile), 256).alias("text_sha")
    )


@query
def clean_location(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("seq")
    noisy = F.concat(
        F.lit(" ,"), "location",
        F.when(d % 3 == 0, " (office, NOT remote)").when(d % 3 == 1, "; visa — no").otherwise(" — x;y, "),
    )
    return W.postings(spark, sf).select("seq", text.clean_location(noisy).alias("location"))


@query
def html_escape(spark: SparkSession, sf: str) -> DataFrame:
    return W.table(spark, sf, "pages").select(
        "page_id", F.sha2(text.html_escape(F.col("html")), 256).alias("html_sha")
    )


@query
def safe_url(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id")
    url = (
        F.when(k % 5 == 0, F.concat(F.lit("javascript:alert('"), "url", F.lit("')")))
        .when(k % 5 == 1, F.upper("url"))
        .when(k % 5 == 2, F.concat(F.lit("  "), "url"))
        .when(k % 5 == 3, F.concat(F.lit("//"), "url"))
        .otherwise(F.col("url"))
    )
    return W.table(spark, sf, "pages").select("page_id", text.safe_url(url).alias("safe"))


# --- filters ------------------------------------------------------------------------


@query
def is_us_eligible(spark: SparkSession, sf: str) -> DataFrame:
    return W.postings(spark, sf).select(
        "seq", location.is_us_eligible(F.col("location")).alias("eligible")
    )


@query
def keep_worth_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return gate.keep_worth_scoring(W.postings(spark, sf)).select("seq", "location")


@query
def workable_gate(spark: SparkSession, sf: str) -> DataFrame:
    return gate.workable_gate(W.postings(spark, sf)).select("seq", "location", "remote")


@query
def freshness_cut(spark: SparkSession, sf: str) -> DataFrame:
    kept = gate.freshness_cut(W.postings(spark, sf), W.NOW, MAX_AGE_DAYS)
    return kept.select("seq", at_text(F.col("posted_at")).alias("posted_at"))


@query
def mentions_target_metro(spark: SparkSession, sf: str) -> DataFrame:
    return W.postings(spark, sf).select(
        "seq", location.mentions_target_metro(F.col("location")).alias("mentions")
    )


# --- dedup and store ----------------------------------------------------------------


@query
def dedup_in_batch(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.dedup_in_batch(W.postings(spark, sf)).select("seq", "job_id", "title")


def _new(spark: SparkSession, sf: str) -> DataFrame:
    p = W.postings(spark, sf)
    return dedup.new_jobs_only(gate.keep_worth_scoring(p), W.seen(p))


@query
def new_jobs_only(spark: SparkSession, sf: str) -> DataFrame:
    return _new(spark, sf).select("seq", "job_id")


@query
def seen_lookup(spark: SparkSession, sf: str) -> DataFrame:
    p = W.postings(spark, sf)
    return dedup.seen_lookup(gate.keep_worth_scoring(p), W.seen(p))


def _store_rows(df: DataFrame) -> DataFrame:
    """Store columns in comparable types."""
    return df.select(
        *[
            long(c).alias(c)
            if c in ("fit_score", "location_tier")
            else F.array_join("skip_flags", "|").alias("skip_flags")
            if c == "skip_flags"
            else F.col(c)
            for c in store.S.STORE.fieldNames()
        ]
    )


@query
def store_item(spark: SparkSession, sf: str) -> DataFrame:
    return _store_rows(store.store_item(dedup.dedup_in_batch(W.postings(spark, sf))))


@query
def store_scored_item(spark: SparkSession, sf: str) -> DataFrame:
    return _store_rows(store.store_scored_item(_ranked(spark, sf)))


def _new_store(spark: SparkSession) -> store.KeyedStore:
    return store.KeyedStore(spark, new_work_dir(spark, "store")).create()


@query
def mark_seen(spark: SparkSession, sf: str) -> DataFrame:
    """Two overlapping writes, the second one twice."""
    stored = _new_store(spark)
    p = W.postings(spark, sf)
    stored.mark_seen(gate.workable_gate(p))
    later = gate.keep_worth_scoring(p).withColumn("title", F.lower("title"))
    stored.mark_seen(later)
    stored.mark_seen(later)
    return _store_rows(stored.read())


@query
def save_new(spark: SparkSession, sf: str) -> DataFrame:
    p = W.postings(spark, sf)
    stored = _seeded_store(spark, p)
    stored.save_new(_ranked(spark, sf))
    return _store_rows(stored.read())


@query
def mark_emailed(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that are stored and ids that are not."""
    stored = _new_store(spark)
    p = W.postings(spark, sf)
    stored.mark_seen(gate.workable_gate(p))
    stored.mark_emailed(W.earlier(p))
    return _store_rows(stored.read())


@query
def store_get(spark: SparkSession, sf: str) -> DataFrame:
    """The stored row of the newest order's posting id, looked up in the whole store."""
    p = W.postings(spark, sf)
    wanted = p.agg(F.max_by("job_id", F.struct("posted_at", "seq"))).first()[0]
    stored = _new_store(spark)
    stored.upsert(store.store_item(p.where("false")))
    stored.upsert(store.store_item(dedup.dedup_in_batch(p)))
    return _store_rows(stored.get(wanted))


# --- tiers and ranking --------------------------------------------------------------


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct eligible posting with its facts, so that all tiers occur."""
    kept = dedup.dedup_in_batch(gate.keep_worth_scoring(W.postings(spark, sf)))
    return scoring.score_many(kept, W.replies(spark, sf))


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.rank_one(_scored(spark, sf), W.PROFILE)


@query
def is_remote(spark: SparkSession, sf: str) -> DataFrame:
    place, flag = F.col("location"), F.col("remote")
    return _scored(spark, sf).select(
        "seq",
        location.is_remote(place, flag, F.col("workplace")).alias("is_remote"),
        location.is_remote(place, flag).alias("hinted_remote"),
    )


@query
def rare_travel_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    rare = location.rare_travel_hybrid(F.col("workplace"), F.col("office_days_per_month"))
    return _scored(spark, sf).select("seq", rare.alias("rare"))


@query
def location_tier(spark: SparkSession, sf: str) -> DataFrame:
    tier = location.location_tier(F.col("location"), F.col("remote"))
    return W.postings(spark, sf).select("seq", long(tier).alias("tier"))


@query
def rank_by_location(spark: SparkSession, sf: str) -> DataFrame:
    ranked = ranking.rank_by_location(W.postings(spark, sf))
    keys = [F.col("location_tier").asc(), F.col("seq").asc()]
    return ranking.with_global_rank(
        ranked.select("seq", "location_tier"), keys
    ).select("seq", long("location_tier").alias("tier"), long("rank").alias("rank"))


@query
def to_workplace(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select(
        "seq", location.to_workplace(F.col("workplace")).alias("workplace")
    )


@query
def scored_tier(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("seq", long(ranking.scored_tier()).alias("tier"))


@query
def skip_reason(spark: SparkSession, sf: str) -> DataFrame:
    reason = fit.skip_reason(
        F.col("years_required"), F.col("work_authorization"), F.col("skip_flags"), W.PROFILE
    )
    return _scored(spark, sf).select("seq", reason.alias("skip_reason"))


@query
def rank_one(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf).select(
        "seq", long("location_tier").alias("tier"), "status", "skip_reason"
    )


@query
def rank(spark: SparkSession, sf: str) -> DataFrame:
    narrow = _ranked(spark, sf).select("seq", "score", "location_tier", "status", "posted_at")
    return ranking.with_global_rank(narrow, fit.rank_keys()).select(
        "seq", long("score").alias("score"), long("location_tier").alias("tier"), "status",
        long("rank").alias("rank"),
    )


# --- digest and budget --------------------------------------------------------------


def _row(df: DataFrame) -> DataFrame:
    return df.select("seq", "company", "title", long("score").alias("score"))


@query
def digest_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _row(selection.digest_filter(_ranked(spark, sf)))


@query
def collapse_roles(spark: SparkSession, sf: str) -> DataFrame:
    return _row(selection.collapse_roles(_ranked(spark, sf)))


@query
def cap_per_company(spark: SparkSession, sf: str) -> DataFrame:
    return _row(selection.cap_per_company(_ranked(spark, sf)))


@query
def digest_top_n(spark: SparkSession, sf: str) -> DataFrame:
    return _row(selection.digest_top_n(_ranked(spark, sf), 25))


def _selected(spark: SparkSession, sf: str) -> DataFrame:
    return gate.select_within_budget(
        gate.workable_gate(_new(spark, sf)), W.NOW, MAX_AGE_DAYS, MAX_SCORE
    )


def _digest(spark: SparkSession, sf: str) -> DataFrame:
    scored = scoring.score_many(gate.workable_gate(_new(spark, sf)), W.replies(spark, sf))
    return selection.for_digest(ranking.rank_one(scored, W.PROFILE))


@query
def for_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Which ten new, workable postings should be sent today?"""
    return selection.with_digest_rank(_digest(spark, sf)).select(
        long("rank").alias("rank"), "seq", "job_id", "company", "title", "url", "location",
        long("location_tier").alias("tier"), long("score").alias("score"), "reason",
        at_text(F.col("posted_at")).alias("posted_at"),
    )


@query
def select_within_budget(spark: SparkSession, sf: str) -> DataFrame:
    return _selected(spark, sf).select("seq", at_text(F.col("posted_at")).alias("posted_at"))


@query
def deferred(spark: SparkSession, sf: str) -> DataFrame:
    return gate.deferred(_new(spark, sf), _selected(spark, sf)).select("seq")


# --- scoring boundary ---------------------------------------------------------------


@query
def build_prompt(spark: SparkSession, sf: str) -> DataFrame:
    prompt = scoring.build_prompt(F.col("title"), F.col("description"), W.PROFILE)
    return W.postings(spark, sf).select("seq", F.sha2(prompt, 256).alias("prompt_sha"))


@query
def reply_openrouter(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("seq")
    message = F.array(F.struct(F.struct(F.col("reply").alias("content")).alias("message")))
    body = F.to_json(F.struct(F.when(d % 5 != 1, message).alias("choices")))
    error = F.concat(F.lit('{"error":null,'), F.substring(body, 2, 1 << 30))
    payload = F.when(d % 11 == 0, error).when(d % 13 == 0, "<html>").otherwise(body)
    return W.replies(spark, sf).select("seq", scoring.reply_openrouter(payload).alias("reply"))


@query
def reply_bedrock(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("seq")
    part = F.struct(F.lit("text").alias("type"), F.col("reply").alias("text"))
    body = F.to_json(F.struct(F.when(d % 5 != 1, F.array(part)).alias("content")))
    payload = F.when(d % 13 == 0, "<html>").otherwise(body)
    return W.replies(spark, sf).select("seq", scoring.reply_bedrock(payload).alias("reply"))


@query
def parse_response(spark: SparkSession, sf: str) -> DataFrame:
    parsed = scoring.parse_response(W.replies(spark, sf))
    return parsed.select("seq", "parsed", long("score").alias("score"))


@query
def to_scored(spark: SparkSession, sf: str) -> DataFrame:
    facts = scoring.to_scored(scoring.parse_response(W.replies(spark, sf)).where("parsed"))
    return facts.select(
        "seq", long("score").alias("score"), "reason",
        F.array_join("skip_flags", "|").alias("skip_flags"), "workplace",
        "office_days_per_month", "years_required", "work_authorization",
    )


@query
def score_many(spark: SparkSession, sf: str) -> DataFrame:
    kept = dedup.dedup_in_batch(gate.keep_worth_scoring(W.postings(spark, sf)))
    scored = scoring.score_many(kept, W.mixed_replies(spark, sf))
    return scored.select("seq", "job_id", long("score").alias("score"))


@query
def unscored(spark: SparkSession, sf: str) -> DataFrame:
    """Together with ``score_many`` every posting, and none twice."""
    kept = dedup.dedup_in_batch(gate.keep_worth_scoring(W.postings(spark, sf)))
    return scoring.unscored(kept, W.mixed_replies(spark, sf)).select("seq", "job_id")


def _stand_in(batches):
    """A scorer whose reply follows from the prompt: no JSON for some, else a score."""
    for batch in batches:
        digest = [hashlib.sha256(p.encode()).hexdigest() for p in batch["prompt"]]
        score = [int(d[:6], 16) for d in digest]
        reply = ["No verdict." if s % 7 == 0 else f'{{"score": {s % 101}}}' for s in score]
        yield batch[["job_id"]].assign(reply=reply)


@query
def scorer_replies(spark: SparkSession, sf: str) -> DataFrame:
    """The scorer is asked for a part of the postings, then for all of them: what was paid, and how often."""
    kept = dedup.dedup_in_batch(gate.keep_worth_scoring(W.postings(spark, sf)))
    kept = written(kept.select("seq", "job_id", "title", "description"), new_work_dir(spark, "kept"))
    log = ReplyLog(spark, new_work_dir(spark, "replies"))
    paid_once(kept.where("seq % 3 = 0"), log, _stand_in, W.PROFILE, tasks=3)
    replies = paid_once(kept, log, _stand_in, W.PROFILE, tasks=4)
    scored = scoring.score_many(kept, replies).select("job_id", long("score").alias("score"))
    times = log.read().groupBy("job_id").agg(F.count("*").alias("paid"))
    return kept.join(times, "job_id").join(scored, "job_id", "left").select("seq", "score", "paid")


# --- run metrics --------------------------------------------------------------------


@query
def run_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = W.postings(spark, sf)
    new = _new(spark, sf)
    selected = _selected(spark, sf)
    ranked = ranking.rank_one(scoring.score_many(selected, W.replies(spark, sf)), W.PROFILE)
    counts = metrics.run_counts(
        {
            "fetched": p,
            "eligible": gate.keep_worth_scoring(p),
            "new": new,
            "selected": selected,
            "scored": ranked,
            "skipped": ranked.where("status = 'skipped'"),
            "digest": selection.for_digest(ranked),
        }
    )
    return counts.withColumn("deferred", F.col("new") - F.col("selected")).drop("selected")


@query
def assess_run(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.assess_run(W.runs(spark, sf)).select(
        "event_id", "attempted", "health", "headline"
    )


@query
def heartbeat_line(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.heartbeat_line(metrics.assess_run(W.runs(spark, sf))).select(
        "event_id", "message"
    )


@query
def spend_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.spend_estimate(W.runs(spark, sf), F.col("model")).select(
        "event_id", "cost", "note"
    )


@query
def parse_heartbeat(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.parse_heartbeat(W.heartbeats(spark, sf)).select(
        "event_id", "health", "scored", "emailed"
    )


def _last_day(spark: SparkSession, sf: str) -> DataFrame:
    lines = W.heartbeats(spark, sf)
    return metrics.daily_window(lines, lines.agg(F.max("ts")).scalar())


@query
def daily_window(spark: SparkSession, sf: str) -> DataFrame:
    return _last_day(spark, sf).select("event_id", at_text(F.col("ts")).alias("ts"))


def _by_day(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.summarize_by_day(metrics.parse_heartbeat(W.heartbeats(spark, sf)), RATE)


def _summary_row(df: DataFrame) -> DataFrame:
    return df.select(
        at_text(F.col("day")).alias("day"), "runs", "scored", "emailed", "errors", "warns", "cost",
        "healthy",
    )


@query
def summarize(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of the last 24 hours and of every day."""
    last = metrics.summarize(metrics.parse_heartbeat(_last_day(spark, sf)), RATE)
    last = last.withColumn("day", F.lit(None).cast("timestamp"))
    return _summary_row(last).unionByName(_summary_row(_by_day(spark, sf)))


@query
def daily_text(spark: SparkSession, sf: str) -> DataFrame:
    # Every third day loses its errors, so that both verdicts occur.
    quiet = F.dayofmonth("day") % 3 == 0
    days = _by_day(spark, sf).withColumn("errors", F.when(quiet, 0).otherwise(F.col("errors")))
    days = days.withColumn("healthy", F.col("errors") == 0)
    return metrics.daily_text(days).select(
        at_text(F.col("day")).alias("day"), "subject", "text", "html"
    )


def _alarm(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(
        at_text(F.col("period_start")).alias("period_start"),
        at_text(F.col("period_end")).alias("period_end"),
        *columns,
        "alarm",
    )


@query
def alarm_unhealthy(spark: SparkSession, sf: str) -> DataFrame:
    return _alarm(metrics.alarm_unhealthy(W.heartbeats(spark, sf)), "unhealthy")


@query
def alarm_errors(spark: SparkSession, sf: str) -> DataFrame:
    events = W.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    errors = F.when(F.col("event_type") == "error", 1).otherwise(0)
    return _alarm(metrics.alarm_errors(events, errors), "errors")


@query
def alarm_no_runs(spark: SparkSession, sf: str) -> DataFrame:
    """From the first line to three days after the last one, so that the end is an outage."""
    lines = W.heartbeats(spark, sf)
    busy = metrics.parse_heartbeat(lines).where("scored > 150")
    first, last = lines.agg(F.min("ts"), F.max("ts") + F.expr("INTERVAL 3 DAYS")).first()
    return _alarm(metrics.alarm_no_runs(busy, first, last), "runs")


# --- digest rendering ---------------------------------------------------------------


@query
def digest_subject(spark: SparkSession, sf: str) -> DataFrame:
    return digest_mail.digest_subject(_digest(spark, sf))


@query
def salary_text(spark: SparkSession, sf: str) -> DataFrame:
    shown = rendering.salary_text(F.col("salary"), F.col("salary_is_estimated"))
    return W.postings(spark, sf).where("salary is not null").select("seq", shown.alias("salary"))


@query
def location_line(spark: SparkSession, sf: str) -> DataFrame:
    line = rendering.location_line(F.col("location"), F.col("location_tier"))
    return _ranked(spark, sf).select("seq", line.alias("line"))


@query
def score_band(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("seq", rendering.score_band(F.col("score")).alias("colour"))


@query
def linked_title(spark: SparkSession, sf: str) -> DataFrame:
    url = F.when(F.col("seq") % 4 == 0, F.concat(F.lit("data:"), "url")).otherwise(
        F.concat("url", F.lit('?a="1"&b'))
    )
    title = F.concat(F.lit("<b>"), "title", F.lit("</b>"))
    return W.postings(spark, sf).select("seq", rendering.linked_title(url, title).alias("title"))


@query
def digest_html(spark: SparkSession, sf: str) -> DataFrame:
    return digest_mail.digest_html(_digest(spark, sf), note="a < b")


@query
def digest_text(spark: SparkSession, sf: str) -> DataFrame:
    return digest_mail.digest_text(_digest(spark, sf), note="a < b")


@query
def digest_outbox(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of a sent digest; a second mail without a receipt and an empty one give none."""
    digest = _digest(spark, sf)
    sent = digest_mail.digest_outbox(digest, "sent")
    lost = digest_mail.digest_outbox(digest, "lost")
    empty = digest_mail.digest_outbox(digest.where("score > 1000"), "empty")
    receipts = spark.createDataFrame(
        [("sent", "m-1"), ("empty", "m-2")], "run_id string, message_id string"
    )
    outbox = sent.unionByName(lost).unionByName(empty)
    return digest_mail.delivered_ids(outbox, receipts)


# --- whole runs and streams ---------------------------------------------------------

def _knobs() -> dict:
    return {
        "profile": W.PROFILE,
        "max_age_days": MAX_AGE_DAYS,
        "max_score_per_run": MAX_SCORE,
        "now": F.lit(W.NOW),
    }


def _seeded_store(spark: SparkSession, p: DataFrame) -> store.KeyedStore:
    stored = _new_store(spark)
    stored.mark_seen(W.earlier(p))
    return stored


@query
def full_run(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of one run over the whole feed, against a store on disk."""
    p = W.postings(spark, sf)
    result = run_cycle(spark, p, _seeded_store(spark, p), replies=W.replies(spark, sf), **_knobs())
    return result.counts


@query
def full_run_store(spark: SparkSession, sf: str) -> DataFrame:
    """What one run leaves in the store."""
    p = W.postings(spark, sf)
    stored = _seeded_store(spark, p)
    run_cycle(spark, p, stored, replies=W.replies(spark, sf), **_knobs())
    return _store_rows(stored.read()).select(
        "job_id", "status", "fit_score", "location_tier", "skip_reason"
    )


@query
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Three micro-batches: one tenant's details land before its searches, another's after, the rest at once."""
    work = new_work_dir(spark, "ingest")
    docs = written(_docs(spark, sf), f"{work}/docs")
    two_stage, tenant, detail = (
        F.col("source") == "workday",
        F.array_position(F.lit(list(W.WORKDAY_TENANTS)), F.col("slug")),
        F.col("path").isNotNull(),
    )
    step = (
        F.when(~two_stage, F.pmod(F.xxhash64("payload_id"), F.lit(3)))
        .when(tenant == 1, F.when(detail, 0).otherwise(1))
        .when(tenant == 2, F.when(detail, 2).otherwise(0))
        .otherwise(2)
    )
    for n in range(3):
        payloads.land_payloads(docs.where(step == n), f"{work}/landed", packed=True)
        ingest.stream_ingest(
            spark,
            f"{work}/landed",
            f"{work}/postings",
            f"{work}/checkpoint",
            F.lit(W.NOW),
            packed=True,
        ).awaitTermination()
    rows = spark.read.parquet(f"{work}/postings")
    return rows.select(
        "source", "job_id", "title", "location", at_text(F.col("posted_at")).alias("posted_at")
    )


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table's files as a stream; the bracket makes the path a pattern, files or folder alike."""
    schema = W.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name[:-1]}[{name[-1]}].parquet")


def _posting_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The derived postings with the documents as the streamed side."""
    return W.postings(spark, sf, documents=_stream(spark, sf, "documents"))


@query
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    work = new_work_dir(spark, "dedup")
    stored = _seeded_store(spark, W.postings(spark, sf))
    ingest.stream_dedup(
        spark, _posting_stream(spark, sf), stored, f"{work}/new", f"{work}/checkpoint"
    ).awaitTermination()
    return spark.read.parquet(f"{work}/new").select("seq", "job_id")


@query
def stream_run_counts(spark: SparkSession, sf: str) -> DataFrame:
    work = new_work_dir(spark, "stream")
    stored = _seeded_store(spark, W.postings(spark, sf))
    stream_run(
        spark,
        _posting_stream(spark, sf),
        stored,
        f"{work}/out",
        f"{work}/checkpoint",
        replies=W.replies(spark, sf),
        **_knobs(),
    ).awaitTermination()
    return spark.read.parquet(f"{work}/out/counts").drop("batch_id")


@query
def stream_backlog(spark: SparkSession, sf: str) -> DataFrame:
    """The store after eight small runs with a third of the postings as budget: nothing is left over."""
    work = new_work_dir(spark, "drain")
    p = W.postings(spark, sf)
    rows = written(p, f"{work}/postings")
    n = rows.count()
    bounds = rows.approxQuantile("seq", [k / 8 for k in range(1, 8)], 0.0)
    part = sum((F.when(F.col("seq") > b, 1).otherwise(0) for b in bounds), F.lit(0))
    arriving = spark.readStream.schema(rows.schema).parquet
    stored = _seeded_store(spark, rows)
    for k in range(8):
        # As many files as tasks, so that none reads a whole landing; what has landed is one micro-batch.
        rows.where(part == k).write.mode("append").parquet(f"{work}/arriving")
        stream_run(
            spark,
            arriving(f"{work}/arriving"),
            stored,
            f"{work}/out",
            f"{work}/checkpoint",
            replies=W.replies(spark, sf),
            **_knobs() | {"max_score_per_run": n // 3},
        ).awaitTermination()
    return _store_rows(stored.read()).select(
        "job_id", "status", "fit_score", "location_tier", "skip_reason"
    )


def _line_stream(spark: SparkSession, sf: str) -> DataFrame:
    return W.heartbeats_of(_stream(spark, sf, "events"))


@query
def stream_daily_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Days the watermark has closed."""
    work = new_work_dir(spark, "daily")
    days = monitor.stream_daily_summary(_line_stream(spark, sf), RATE)
    monitor.write_stream(days, f"{work}/out", f"{work}/checkpoint").awaitTermination()
    return _summary_row(spark.read.schema(days.schema).parquet(f"{work}/out"))


@query
def stream_alarms(spark: SparkSession, sf: str) -> DataFrame:
    work = new_work_dir(spark, "alarms")
    alarms = monitor.stream_alarms(_line_stream(spark, sf))
    monitor.write_updates(alarms, f"{work}/out", f"{work}/checkpoint").awaitTermination()
    schema = T.StructType([*alarms.schema.fields, T.StructField("batch_id", T.LongType())])
    latest = spark.read.schema(schema).parquet(f"{work}/out")
    last = latest.groupBy("period_start", "period_end").agg(
        F.max_by(F.struct("unhealthy", "alarm"), "batch_id").alias("last")
    )
    return _alarm(last.select("period_start", "period_end", "last.*"), "unhealthy")


@query
def stream_no_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The periods that a clock has closed, which goes on for three days after the last line."""
    work = new_work_dir(spark, "silence")
    first, last = F.min("ts"), F.max("ts") + F.expr("INTERVAL 3 DAYS")
    hours = F.array_append(F.sequence(first, last, F.expr("INTERVAL 1 HOUR")), last)
    ticks = W.heartbeats(spark, sf).agg(hours.alias("h"), first.alias("start"))
    start = written(ticks.select(F.explode("h").alias("ts"), "start"), f"{work}/ticks")
    found = monitor.stream_no_runs(
        metrics.parse_heartbeat(_line_stream(spark, sf)).where("scored > 150"),
        spark.readStream.schema(start.schema).parquet(f"{work}/ticks"),
        F.lit(start.agg(F.min("start")).first()[0]),
    )
    monitor.write_stream(found, f"{work}/out", f"{work}/checkpoint").awaitTermination()
    return _alarm(spark.read.schema(found.schema).parquet(f"{work}/out"), "runs")


@query
def stream_receipts(spark: SparkSession, sf: str) -> DataFrame:
    """A mail per dated posting: of three, one is delivered, one too late and one never."""
    work = new_work_dir(spark, "receipts")
    p = written(W.postings(spark, sf).where("posted_at is not null"), f"{work}/postings")
    stored = _new_store(spark)
    stored.mark_seen(p)
    mail = F.col("seq").cast("string")
    mails = p.select(
        mail.alias("run_id"), F.col("posted_at").alias("sent_at"), F.array("job_id").alias("job_ids")
    )
    late = F.when(F.col("seq") % 3 == 0, F.expr("INTERVAL 2 HOURS")).otherwise(F.expr("INTERVAL 3 DAYS"))
    got = p.where("seq % 3 < 2").select(
        mail.alias("run_id"), F.concat(F.lit("m-"), mail).alias("message_id"),
        (F.col("posted_at") + late).alias("received_at"),
    )
    # A last row of either stream lets the watermark pass all others.
    end = p.agg((F.max("posted_at") + F.expr("INTERVAL 30 DAYS")).alias("at")).where("at is not null")
    none = F.array().cast("array<string>")
    end_mail = end.select(F.lit("end").alias("run_id"), F.col("at").alias("sent_at"), none.alias("job_ids"))
    end_receipt = end.select(
        F.lit("other").alias("run_id"), F.lit("m").alias("message_id"), F.col("at").alias("received_at")
    )
    mails = written(mails.unionByName(end_mail), f"{work}/outbox")
    got = written(got.unionByName(end_receipt), f"{work}/receipts")
    receipts.stream_receipts(
        spark,
        spark.readStream.schema(mails.schema).parquet(f"{work}/outbox"),
        spark.readStream.schema(got.schema).parquet(f"{work}/receipts"),
        stored,
        f"{work}/out",
        f"{work}/checkpoint",
    ).awaitTermination()
    status = stored.read().select("job_id", (F.col("status") == "emailed").alias("emailed"))
    return (
        spark.read.parquet(f"{work}/out")
        .select(
            F.col("run_id").cast("long").alias("seq"),
            F.explode("job_ids").alias("job_id"),
            F.col("message_id").isNotNull().alias("delivered"),
        )
        .join(status, "job_id")
        .select("seq", "job_id", "delivered", "emailed")
    )


def queries() -> dict[str, Query]:
    named = dict(QUERIES)
    named["stream_run"] = named.pop("stream_run_counts")
    return named
