"""Run counts, health, heartbeats, daily summaries and alarms."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.functions.rendering import fill, money
from vacantia.functions.text import html_escape

DEFAULT_MARKER = "posting run"
DEFAULT_APP = "vacantia"


def run_counts(stages: Mapping[str, DataFrame]) -> DataFrame:
    """One row of counts: a column per stage, counted over rows tagged with their stage."""
    tagged = reduce(
        DataFrame.unionByName, [df.select(F.lit(name).alias("stage")) for name, df in stages.items()]
    )
    return tagged.agg(*[F.count_if(F.col("stage") == name).alias(name) for name in stages])


def assess_run(runs: DataFrame) -> DataFrame:
    """Add ``attempted``, ``health`` and ``headline`` to rows of run counts.

    Needs the count columns and ``source_count``. The first rule that holds wins.
    """
    c = {name: F.col(name) for name in runs.columns}
    attempted = c["new"] - c["deferred"]
    rules = [
        (
            (c["source_count"] > 0) & (c["source_failures"] >= c["source_count"]),
            "error",
            F.lit(V.HEADLINE_ALL_FAILED),
        ),
        (
            (attempted > 0) & (c["scored"] == 0),
            "error",
            fill(V.HEADLINE_SCORER_DOWN, attempted=attempted),
        ),
        (
            c["source_failures"] > 0,
            "warn",
            fill(V.HEADLINE_SOME_FAILED, failed=c["source_failures"], sources=c["source_count"]),
        ),
        (c["fetched"] == 0, "warn", F.lit(V.HEADLINE_NOTHING_FETCHED)),
    ]
    health = reduce(lambda w, r: w.when(r[0], r[1]), rules, F).otherwise("ok")
    headline = reduce(lambda w, r: w.when(r[0], r[2]), rules, F).otherwise(V.HEADLINE_HEALTHY)
    return runs.withColumns({"attempted": attempted, "health": health, "headline": headline})


def heartbeat_line(assessed: DataFrame, marker: str = DEFAULT_MARKER) -> DataFrame:
    """Add ``message``: one line per run. Needs ``emailed`` and ``message_id`` too."""
    names = [
        "health", "headline", "fetched", "eligible", "new", "scored", "skipped", "digest",
        "deferred", "source_failures", "source_count", "emailed",
    ]
    values = {name: F.col(name) for name in names}
    message_id = F.when(F.coalesce("message_id", F.lit("")) == "", "-").otherwise(
        F.col("message_id")
    )
    return assessed.withColumn(
        "message", fill(V.HEARTBEAT_FORMAT, marker=marker, message_id=message_id, **values)
    )


def score_rate(model: Column) -> Column:
    """Price of one score by model family."""
    rate = F
    for family, price in V.COST_PER_SCORE.items():
        rate = rate.when(F.contains(F.lower(model), F.lit(family)), price)
    return rate.otherwise(V.COST_PER_SCORE_OTHER)


def spend_estimate(runs: DataFrame, model: Column | str) -> DataFrame:
    """Add ``cost`` and ``note`` from the scored and digest counts."""
    name = F.lit(model) if isinstance(model, str) else model
    note = fill(
        V.SPEND_NOTE_FORMAT,
        scored=F.col("scored"),
        plural=F.when(F.col("scored") == 1, "").otherwise("s"),
        digest=F.col("digest"),
        cost=money(F.col("cost")),
    )
    return runs.withColumn("cost", F.col("scored") * score_rate(name)).withColumn("note", note)


def daily_score_rate(model: str = "haiku") -> float:
    """Price used in the daily summary, which knows one cheap family only."""
    for family, price in V.DAILY_COST_PER_SCORE.items():
        if family in model.lower():
            return price
    return V.DAILY_COST_PER_SCORE_OTHER


def parse_heartbeat(lines: DataFrame, marker: str = DEFAULT_MARKER) -> DataFrame:
    """Heartbeat lines only, with ``health``, ``scored`` and ``emailed``."""
    message = F.col("message")

    def number(pattern: str) -> Column:
        found = F.regexp_extract(message, pattern, 1)
        return F.coalesce(found.try_cast("bigint"), F.lit(0))

    return lines.where(
        F.contains(message, F.lit(marker)) & message.rlike(V.HEALTH_PATTERN)
    ).withColumns(
        {
            "health": F.regexp_extract(message, V.HEALTH_PATTERN, 1),
            "scored": number(V.SCORED_PATTERN),
            "emailed": number(V.EMAILED_PATTERN),
        }
    )


def daily_window(
    lines: DataFrame,
    now: dt.datetime | Column,
    marker: str = DEFAULT_MARKER,
    limit: int | None = None,
) -> DataFrame:
    """Heartbeat lines of the 24 hours up to ``now``; with a ``limit`` the newest ones only."""
    end = (now if isinstance(now, Column) else F.lit(now)).cast("timestamp")
    recent = lines.where(
        (F.col("ts") >= end - F.make_interval(secs=F.lit(V.DAILY_WINDOW_SECONDS)))
        & (F.col("ts") <= end)
        & F.contains("message", F.lit(marker))
    )
    if limit is None:
        return recent
    return recent.orderBy(F.col("ts").desc(), F.col("message").asc()).limit(limit)


def _totals(cost_per_score: float) -> list[Column]:
    scored = F.coalesce(F.sum("scored"), F.lit(0))
    errors = F.count_if(F.col("health") == "error")
    return [
        F.count(F.lit(1)).alias("runs"),
        scored.alias("scored"),
        F.coalesce(F.sum("emailed"), F.lit(0)).alias("emailed"),
        errors.alias("errors"),
        F.count_if(F.col("health") == "warn").alias("warns"),
        (scored * F.lit(float(cost_per_score))).alias("cost"),
        (errors == 0).alias("healthy"),
    ]


def summarize(parsed: DataFrame, cost_per_score: float) -> DataFrame:
    """One summary row over all parsed heartbeats; zeros when there are none."""
    return parsed.agg(*_totals(cost_per_score))


def summarize_by_day(parsed: DataFrame, cost_per_score: float) -> DataFrame:
    """One summary row per UTC day."""
    return (
        parsed.groupBy(F.window("ts", "1 day").alias("w"))
        .agg(*_totals(cost_per_score))
        .select(F.col("w.start").alias("day"), F.col("w.end").alias("day_end"), "*")
        .drop("w")
    )


def daily_text(summary: DataFrame, app: str = DEFAULT_APP) -> DataFrame:
    """Add ``subject``, ``text`` and ``html`` of the daily report to summary rows."""
    v = {name: F.col(name) for name in ("runs", "scored", "emailed", "errors", "warns")}
    healthy = F.col("healthy")
    verdict = F.when(healthy, V.DAILY_HEALTHY_TEXT).otherwise(
        fill(V.DAILY_ERROR_FORMAT, errors=v["errors"])
    )
    warned = F.when(
        (v["warns"] > 0) & healthy, fill(V.DAILY_WARN_FORMAT, warns=v["warns"])
    ).otherwise("")
    body = fill(
        V.DAILY_BODY_FORMAT,
        runs=v["runs"],
        scored=v["scored"],
        emailed=v["emailed"],
        cost=money(F.col("cost")),
    )
    colour = F.when(healthy, "#1a7f37").otherwise("#b42318")
    return summary.withColumns(
        {
            "subject": fill(
                V.DAILY_SUBJECT_FORMAT, app=app, emailed=v["emailed"], runs=v["runs"]
            ),
            "text": fill(
                "{app} daily check.\n\n{body}\n\n{verdict}{warned}\n",
                app=app,
                body=body,
                verdict=verdict,
                warned=warned,
            ),
            "html": fill(
                '<div><h2>{app} — daily check</h2><p>{body}</p><p style="color:{colour}">'
                "{verdict}{warned}</p></div>",
                app=app,
                body=html_escape(body),
                colour=colour,
                verdict=verdict,
                warned=warned,
            ),
        }
    )


# --- alarms -------------------------------------------------------------------------


def _per_period(df: DataFrame, seconds: int, value: Column, name: str) -> DataFrame:
    return (
        df.groupBy(F.window("ts", f"{seconds} seconds").alias("w"))
        .agg(value.alias(name))
        .select(
            F.col("w.start").alias("period_start"),
            F.col("w.end").alias("period_end"),
            name,
            (F.col(name) >= 1).alias("alarm"),
        )
    )


def alarm_unhealthy(lines: DataFrame, seconds: int = V.ALARM_PERIOD_SECONDS) -> DataFrame:
    """Unhealthy heartbeats per period; a period without lines is no alarm and has no row."""
    return _per_period(
        lines, seconds, F.count_if(F.contains("message", F.lit("health=error"))), "unhealthy"
    )


def alarm_errors(
    events: DataFrame, errors: Column, seconds: int = V.ALARM_PERIOD_SECONDS
) -> DataFrame:
    """Sum of ``errors`` per period."""
    return _per_period(events, seconds, F.sum(errors), "errors")


def alarm_no_runs(
    runs: DataFrame,
    start: dt.datetime | Column,
    end: dt.datetime | Column,
    seconds: int = V.NO_RUN_WINDOW_SECONDS,
) -> DataFrame:
    """Runs of every period that begins from ``start`` to before ``end``; one without any is an alarm.

    The span is given, not taken from the runs: an outage that lasts until now, and a schedule that
    never ran, are alarms too.
    """
    first, last = (
        (at if isinstance(at, Column) else F.lit(at)).cast("timestamp") for at in (start, end)
    )
    at = F.col("period_start")
    begin = F.timestamp_seconds(F.ceil(F.unix_micros(first) / (seconds * 1_000_000)) * seconds)
    counted = runs.groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("n")
    )
    step = F.make_interval(secs=F.lit(seconds))
    inside = F.filter(F.sequence(begin, last, step), lambda p: p < last)
    periods = (
        runs.sparkSession.range(1)
        .where(begin < last)
        .select(F.explode(inside).alias("period_start"))
    )
    return periods.join(
        counted.select(F.col("w.start").alias("at"), "n"), at == F.col("at"), "left"
    ).select(
        "period_start",
        (at + step).alias("period_end"),
        F.coalesce("n", F.lit(0)).alias("runs"),
        (F.coalesce("n", F.lit(0)) < 1).alias("alarm"),
    )
