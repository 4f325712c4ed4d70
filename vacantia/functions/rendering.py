"""Text built from columns: format strings, digest lines and digest rows."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.functions.location import mentions_target_metro
from vacantia.functions.text import clean_location, html_escape, null_if_empty, safe_url


def fill(template: str, **values: Column | str) -> Column:
    """``template`` with its {names} replaced by columns or plain text."""
    parts: list[Column] = []
    for n, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if n % 2 == 0:
            if piece:
                parts.append(F.lit(piece))
        else:
            value = values[piece]
            parts.append(F.lit(value) if isinstance(value, str) else value.cast("string"))
    return F.concat(*parts)


def money(amount: Column) -> Column:
    return F.format_string("%.2f", amount)


def salary_text(salary: Column, estimated: Column) -> Column:
    """An estimate is never shown as a stated salary."""
    suffix = F.when(estimated, V.SALARY_ESTIMATED_SUFFIX).otherwise("")
    return F.concat(fill(V.SALARY_FORMAT, salary=salary), suffix)


def location_line(location: Column, tier: Column) -> Column:
    """Label of the tier; the last tier shows the place itself; a target-metro flag if it adds."""
    raw = F.coalesce(location, F.lit(""))
    labels = F.create_map(*[F.lit(x) for x in chain.from_iterable(V.TIER_LABELS.items())])
    label = F.element_at(labels, tier)
    base = F.when(
        tier == V.OTHER_US, F.coalesce(null_if_empty(clean_location(raw)), label)
    ).otherwise(label)
    at_target = tier.isin(V.TARGET_METRO_HYBRID, V.TARGET_METRO_ONSITE)
    flagged = ~at_target & mentions_target_metro(raw)
    return F.concat(base, F.when(flagged, V.METRO_FLAG).otherwise(""))


def score_band(score: Column) -> Column:
    (first, colour), *rest = V.SCORE_COLOURS
    band = F.when(score >= first, colour)
    for threshold, colour in rest:
        band = band.when(score >= threshold, colour)
    return band


def linked_title(url: Column, title: Column) -> Column:
    """A link only when the url is safe; all text is escaped."""
    text = html_escape(title)
    link = fill('<a class="title" href="{href}">{text}</a>', href=html_escape(url), text=text)
    return F.when(safe_url(url), link).otherwise(fill('<span class="title">{text}</span>', text=text))


def html_row(row: dict[str, Column]) -> Column:
    """One table row of the digest."""
    salary = fill(
        '<div class="salary">{text}</div>',
        text=html_escape(salary_text(row["salary"], row["salary_is_estimated"])),
    )
    return fill(
        '<tr><td><div><b style="background:{colour}">{score}</b>&nbsp;{heading}</div>'
        '<div class="where">{company} · {location}</div><div class="why">{reason}</div>'
        "{salary}</td></tr>\n",
        colour=score_band(row["score"]),
        score=row["score"],
        heading=linked_title(row["url"], row["title"]),
        company=html_escape(row["company"]),
        location=html_escape(location_line(row["location"], row["location_tier"])),
        reason=html_escape(row["reason"]),
        salary=F.when(F.coalesce(row["salary"], F.lit("")) != "", salary).otherwise(""),
    )


def text_lines(rank: Column, row: dict[str, Column]) -> Column:
    """The digest's plain-text lines of one posting, with a blank line after them."""
    # The label comes twice in the plain text: once here, once from `salary_text`.
    salary = fill(
        "   Salary: {text}\n", text=salary_text(row["salary"], row["salary_is_estimated"])
    )
    return fill(
        "{rank}. [{score}] {title} — {company}\n   {location}\n   {reason}\n{salary}   {url}\n\n",
        rank=rank,
        score=row["score"],
        title=row["title"],
        company=row["company"],
        location=location_line(row["location"], row["location_tier"]),
        reason=row["reason"],
        salary=F.when(F.coalesce(row["salary"], F.lit("")) != "", salary).otherwise(""),
        url=row["url"],
    )
