"""Derived fields of each source, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.functions.text import null_if_empty, part


def _has_remote(text: Column) -> Column:
    return F.coalesce(F.contains(F.lower(text), F.lit("remote")), F.lit(False))


def dollars(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 0))


def dollar_range(low: Column, high: Column, unit: Column | None = None) -> Column:
    unit = F.lit("") if unit is None else unit
    return F.when(low == high, F.concat(dollars(low), unit)).otherwise(
        F.concat(dollars(low), F.lit(" - "), dollars(high), unit)
    )


def greenhouse_remote(location: Column, metadata: Column) -> Column:
    name, value = V.GREENHOUSE_REMOTE_METADATA
    tagged = F.exists(
        metadata,
        lambda m: F.coalesce((m["name"] == name) & (m["value"] == value), F.lit(False)),
    )
    return F.coalesce(tagged, F.lit(False)) | _has_remote(location)


def lever_locations(categories: Column) -> Column:
    every = categories["allLocations"]
    return F.when(F.size(every) > 0, F.array_join(every, ", ")).otherwise(categories["location"])


def lever_description_parts(intro: Column, lists: Column, closing: Column) -> Column:
    """Intro, then each section's title and its HTML, then the closing."""
    sections = F.transform(
        lists, lambda s: F.array(part(s["text"], html=False), part(s["content"], html=True))
    )
    intro_part, closing_part = part(intro, html=False), part(closing, html=False)
    whole = F.concat(F.array(intro_part), F.flatten(sections), F.array(closing_part))
    return F.coalesce(whole, F.array(intro_part, closing_part))


def ashby_remote(workplace_type: Column) -> Column:
    return F.coalesce(F.lower(workplace_type) == "remote", F.lit(False))


def ashby_locations(primary: Column, secondary: Column) -> Column:
    places = F.concat(
        F.array(primary),
        F.coalesce(F.transform(secondary, lambda s: s["location"]), F.array().cast("array<string>")),
    )
    named = F.filter(places, lambda p: p.isNotNull() & (p != ""))
    return null_if_empty(F.array_join(named, ", "))


def ashby_salary(compensation: Column) -> Column:
    return null_if_empty(compensation["scrapeableCompensationSalarySummary"])


def workday_source_id(tenant: Column, info: Column) -> Column:
    """Requisition numbers are unique only within a tenant."""
    req = F.coalesce(
        null_if_empty(info["jobReqId"]),
        null_if_empty(info["jobPostingId"]),
        info["id"],
        F.lit("None"),
    )
    return F.concat(tenant, F.lit(":"), req)


def workday_url(host: Column, site: Column, info: Column) -> Column:
    built = F.concat(
        F.lit("https://"), host, F.lit("/"), site, F.coalesce(info["externalPath"], F.lit(""))
    )
    return F.coalesce(null_if_empty(info["externalUrl"]), built)


def workday_site(robots: Column) -> Column:
    """Site name on the first Sitemap line of a robots.txt, or NULL."""
    return null_if_empty(F.regexp_extract(robots, "(?im)" + V.WORKDAY_SITEMAP_PATTERN, 1))


def _form_quote(text: Column) -> Column:
    """Form encoding that leaves '~' and quotes '*'."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def adzuna_apply_url(url: Column) -> Column:
    """`/land/ad/<id>` becomes `/details/<id>` with the utm parameters only; others stay."""
    shape = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?/land/ad/(\d+)"
    scheme = F.lower(F.regexp_extract(url, shape, 1))
    prefix = F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.regexp_extract(url, shape, 2),
        F.lit("/details/"),
        F.regexp_extract(url, shape, 3),
    )
    pairs = F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&")

    def side(pair: Column, value: bool) -> Column:
        raw = F.regexp_extract(pair, r"(?s)^([^=]*)=(.+)$", 2 if value else 1)
        return F.coalesce(F.try_url_decode(raw), raw)

    utm = F.filter(pairs, lambda p: p.rlike("(?s)^[^=]*=.") & side(p, False).startswith("utm_"))
    query = F.array_join(
        F.transform(
            utm,
            lambda p: F.concat(_form_quote(side(p, False)), F.lit("="), _form_quote(side(p, True))),
        ),
        "&",
    )
    details = F.when(query == "", prefix).otherwise(F.concat(prefix, F.lit("?"), query))
    return F.when(url.rlike(shape), details).otherwise(url)


def adzuna_salary(low: Column, high: Column) -> Column:
    return dollar_range(F.coalesce(low, high), F.coalesce(high, low))


def adzuna_estimated(low: Column, high: Column, predicted: Column) -> Column:
    """Only the string '1' marks a guess; the number 1 does not."""
    is_guess = (F.schema_of_variant(predicted) == "STRING") & (
        F.try_variant_get(predicted, "$", "string") == V.ADZUNA_PREDICTED
    )
    return F.coalesce(low, high).isNotNull() & F.coalesce(is_guess, F.lit(False))


def adzuna_remote(title: Column, location: Column, description: Column) -> Column:
    return _has_remote(F.concat_ws(" ", title, location, description))


def usajobs_salary(remuneration: Column) -> Column:
    """First pay row; a one-sided range stands for both ends; text that is no number is NULL."""
    row = F.get(remuneration, F.lit(0))
    low, high = null_if_empty(row["MinimumRange"]), null_if_empty(row["MaximumRange"])

    def number(text: Column) -> Column:
        numeric = text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
        return F.when(numeric, F.trim(text).try_cast("double"))

    unit = F.lit("")
    for code, suffix in V.USAJOBS_PAY_INTERVALS.items():
        unit = F.when(row["RateIntervalCode"] == code, suffix).otherwise(unit)
    return dollar_range(number(F.coalesce(low, high)), number(F.coalesce(high, low)), unit)
