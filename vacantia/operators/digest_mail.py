"""Rendering a digest, and sending it as data: outbox rows out, delivery receipts in.

The input of these operators is a digest, whose size the digest limit bounds; only its rows meet
in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.functions.rendering import fill, html_row, text_lines
from vacantia.functions.text import html_escape
from vacantia.operators.selection import with_digest_rank

DEFAULT_APP = "vacantia"

_ROW = (
    "score", "title", "company", "url", "reason", "salary", "salary_is_estimated", "location",
    "location_tier",
)


def _in_rank_order(parts: Column, rank: Column) -> Column:
    """Ordered concatenation of the digest's parts."""
    ordered = F.sort_array(F.collect_list(F.struct(rank.alias("rank"), parts.alias("part"))))
    return F.array_join(F.transform(ordered, lambda x: x["part"]), "")


def _subject(n: Column, app: str) -> Column:
    one, many = V.DIGEST_NOUNS
    return fill(V.DIGEST_SUBJECT_FORMAT, n=n, noun=F.when(n == 1, one).otherwise(many), app=app)


def _text(n: Column, body: Column, app: str, note: str | None) -> Column:
    head = fill(V.DIGEST_HEADER_FORMAT + " — " + V.DIGEST_ORDER_TEXT + ".\n\n", n=n)
    foot = V.DIGEST_FOOTER_FORMAT.format(app=app) + (f"\n\n{note}" if note else "")
    return F.concat(head, body, F.lit(foot))


def _html(n: Column, body: Column, app: str, note: str | None) -> Column:
    note_part = (
        F.concat(F.lit('<p class="note">'), html_escape(F.lit(note)), F.lit("</p>"))
        if note
        else F.lit("")
    )
    foot = html_escape(F.lit(V.DIGEST_FOOTER_FORMAT.format(app=app)))
    return fill(
        "<div><h2>{head}</h2><p>{order}</p>\n<table>\n{body}</table>\n<p>{foot}</p>{note}</div>",
        head=fill(V.DIGEST_HEADER_FORMAT, n=n),
        order=V.DIGEST_ORDER_TEXT.capitalize(),
        body=body,
        foot=foot,
        note=note_part,
    )


def rendered(
    digest: DataFrame, app: str = DEFAULT_APP, note: str | None = None, seq: str = "seq"
) -> DataFrame:
    """One row: n, subject, html, text, job_ids (in rank order)."""
    row = {c: F.col(c) for c in _ROW}
    rank = F.col("rank")
    parts = with_digest_rank(digest, seq).select(
        "rank",
        "job_id",
        html_row(row).alias("html_part"),
        text_lines(rank, row).alias("text_part"),
    )
    joined = parts.agg(
        F.count(F.lit(1)).alias("n"),
        _in_rank_order(F.col("html_part"), rank).alias("html_body"),
        _in_rank_order(F.col("text_part"), rank).alias("text_body"),
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "job_id"))), lambda x: x["job_id"]
        ).alias("job_ids"),
    )
    n = F.col("n")
    return joined.select(
        "n",
        _subject(n, app).alias("subject"),
        _html(n, F.col("html_body"), app, note).alias("html"),
        _text(n, F.col("text_body"), app, note).alias("text"),
        "job_ids",
    )


def digest_subject(digest: DataFrame, app: str = DEFAULT_APP) -> DataFrame:
    return digest.agg(F.count(F.lit(1)).alias("n")).select("n", _subject(F.col("n"), app).alias("subject"))


def digest_html(digest: DataFrame, app: str = DEFAULT_APP, note: str | None = None) -> DataFrame:
    return rendered(digest, app, note).select("html")


def digest_text(digest: DataFrame, app: str = DEFAULT_APP, note: str | None = None) -> DataFrame:
    return rendered(digest, app, note).select("text")


def digest_outbox(
    digest: DataFrame, run_id: str, app: str = DEFAULT_APP, note: str | None = None
) -> DataFrame:
    """The mail to send for a run; an empty digest gives no row."""
    return (
        rendered(digest, app, note)
        .where(F.col("n") > 0)
        .select(F.lit(run_id).alias("run_id"), "*")
    )


def delivered_ids(outbox: DataFrame, receipts: DataFrame) -> DataFrame:
    """Ids to mark as emailed: only mails with a delivery receipt (run_id, message_id)."""
    return (
        outbox.join(receipts.select("run_id"), "run_id", "left_semi")
        .select(F.explode("job_ids").alias("job_id"))
        .distinct()
    )
