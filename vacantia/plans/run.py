"""One full run over landed documents: the stages in cost order.

The gate works on five narrow columns of all postings. Text is read, and HTML cleaned, for the
selected postings only, in a second pass over the feed; that pass parses the feed again, unless the
feed brings its own way to fetch the selected rows. What a step decides is written to the shared folder before the
next one uses it: the narrow feed, the new ids, the selected postings (before anything is paid
for), the replies and the ranking.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia import schemas as S
from vacantia.functions.fit import rank_keys
from vacantia.functions.location import DEFAULT_GAZETTEER, Gazetteer
from vacantia.operators import dedup, gate, metrics, ranking, scoring, selection
from vacantia.operators.reply_log import ReplyLog, paid_once
from vacantia.operators.store import KeyedStore
from vacantia.session import new_work_dir, use_utc, written
from vacantia.sources.normalise import described

_NARROW = ("seq", "job_id", "location", "remote", "posted_at")


@dataclass(frozen=True)
class RunResult:
    """Tables: the digest, the whole ranking, one row of counts, and what is left for later."""

    digest: DataFrame
    ranked: DataFrame
    counts: DataFrame
    #: Postings that could have been scored but were over the budget, or got no usable reply.
    pending: DataFrame


def run_cycle(
    spark: SparkSession,
    postings: DataFrame,
    stored: KeyedStore,
    *,
    replies: DataFrame | None = None,
    scorer: scoring.Scorer | None = None,
    profile: dict[str, Any] | None = None,
    source_status: DataFrame | None = None,
    digest_limit: int = V.DIGEST_LIMIT,
    min_score: int | None = None,
    per_company: int | None = None,
    max_age_days: int | None = None,
    max_score_per_run: int | None = None,
    workable_only: bool = True,
    now: dt.datetime | Column,
    gazetteer: Gazetteer = DEFAULT_GAZETTEER,
    score_tasks: int | None = None,
    reply_log: str | None = None,
    work_dir: str | None = None,
    save: bool = True,
    text_of: Callable[[DataFrame], DataFrame] | None = None,
) -> RunResult:
    """Run once. Scored postings, skipped ones too, end up in the store (``save``).

    ``postings`` carries ``seq``, unique and the same in every pass, and ``job_id``; its text is in
    ``description`` or still in ``body_parts`` (`combine_sources(..., raw=True)`). Replies are a
    landed table or come from ``scorer``, which ``score_tasks`` tasks call at a time and whose replies
    are logged as they arrive; with a ``reply_log`` folder of its own a run that is repeated after a
    failure, however far it got, does not pay for them again.
    ``source_status`` has a ``status`` per source. With ``text_of`` the postings are narrow rows, all of
    whose columns go through the gate; it gets those of the selected ones and gives their wide rows, and
    ``pending`` is narrow as well.
    """
    if (replies is None) == (scorer is None):
        raise ValueError("give either replies or a scorer")
    use_utc(spark)
    work = work_dir or new_work_dir(spark, "run")

    narrow = postings if text_of else postings.select(*_NARROW)
    fetched = written(narrow, f"{work}/fetched")
    eligible = gate.keep_worth_scoring(fetched)
    unique = written(dedup.dedup_in_batch(eligible), f"{work}/unique")
    new = written(stored.unseen(unique), f"{work}/new")

    chosen = gate.select_within_budget(
        gate.workable_gate(new, workable_only, gazetteer), now, max_age_days, max_score_per_run
    )
    picked = written(chosen, f"{work}/picked")
    wide = text_of(picked) if text_of else postings.join(picked, ["job_id", "seq"], "left_semi")
    selected = written(
        described(wide) if "body_parts" in wide.columns else wide, f"{work}/selected"
    )

    if scorer is not None:
        log = ReplyLog(spark, reply_log or f"{work}/reply_log")
        replies = paid_once(selected, log, scorer, profile, score_tasks)
    else:
        # A big table of landed replies is cut to the selected ids before it is shuffled.
        replies = replies.join(selected.select("job_id"), "job_id", "left_semi")
    scored = scoring.score_many(selected, replies)
    ranked = written(ranking.rank_one(scored, profile, gazetteer), f"{work}/ranked")
    if save:
        stored.save_new(ranked)
    fit = gate.freshness_cut(gate.workable_gate(new, workable_only, gazetteer), now, max_age_days)
    left = written(
        fit.join(ranked.select("job_id"), "job_id", "left_anti").select(fetched.columns), f"{work}/left"
    )
    pending = left if text_of else postings.join(left, ["job_id", "seq"], "left_semi")
    return run_result(
        ranked,
        fetched,
        new,
        selected,
        source_status,
        digest_limit,
        min_score,
        per_company,
        pending,
    )


def run_result(
    ranked: DataFrame,
    fetched: DataFrame,
    new: DataFrame,
    selected: DataFrame,
    source_status: DataFrame | None,
    digest_limit: int,
    min_score: int | None,
    per_company: int | None,
    pending: DataFrame,
) -> RunResult:
    """Digest, ordered ranking and counts over a run's written tables."""
    digest = selection.for_digest(
        ranked,
        limit=digest_limit,
        min_score=V.MIN_SCORE if min_score is None else min_score,
        per_company=V.PER_COMPANY if per_company is None else per_company,
    )
    failed = (
        ranked.limit(0) if source_status is None else source_status.where("status = 'failed'")
    )
    counts = metrics.run_counts(
        {
            "fetched": fetched,
            "eligible": gate.keep_worth_scoring(fetched),
            "new": new,
            "selected": selected,
            "scored": ranked,
            "skipped": ranked.where("status = 'skipped'"),
            "digest": digest,
            "source_failures": failed,
        }
    ).withColumn("deferred", F.col("new") - F.col("selected"))
    return RunResult(digest, ranked.orderBy(*rank_keys()), counts.drop("selected"), pending)


def run_report(
    counts: DataFrame,
    source_count: int,
    emailed: Column,
    message_id: Column,
    marker: str = metrics.DEFAULT_MARKER,
) -> DataFrame:
    """The run's health and heartbeat line."""
    runs = counts.withColumns(
        {"source_count": F.lit(source_count), "emailed": emailed, "message_id": message_id}
    )
    return metrics.heartbeat_line(metrics.assess_run(runs), marker)
