"""Text columns: HTML to plain text, escaping, fences, location and url clean-up."""

from __future__ import annotations

import html
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia import fixed_values as V

# What Python calls white space, spelled for java.util.regex.
WS = r"[\p{IsWhite_Space}\x1c-\x1f]"

_TAG = re.compile(V.TAG_PATTERN)

# The helpers below travel to executors inside the task, so the package need not be there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def strip_ws(text: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def collapse_ws(text: Column) -> Column:
    """Runs of Unicode white space become one blank; none is left at the ends."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def null_if_empty(text: Column) -> Column:
    return F.when(text != "", text)


def _plain(markup: str) -> str:
    text = html.unescape(markup)
    # No tag can end after the last '>': leaving that tail out keeps the search linear.
    end = text.rfind(">") + 1
    return " ".join(html.unescape(_TAG.sub(" ", text[:end]) + text[end:]).split())


@F.pandas_udf(T.StringType())
def _plain_udf(markup: pd.Series) -> pd.Series:
    return markup.map(_plain, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _plain_each_udf(markups: pd.Series) -> pd.Series:
    return markups.map(lambda row: [_plain(m) for m in row], na_action="ignore")


def _native_plain(markup: Column) -> Column:
    """Plain text of markup without entities."""
    tail = F.substring_index(markup, ">", -1)
    tagged = F.left(markup, F.length(markup) - F.length(tail))
    return collapse_ws(F.concat(F.regexp_replace(tagged, V.TAG_PATTERN, " "), tail))


def _has_entity(markup: Column) -> Column:
    return F.contains(markup, F.lit("&"))


def html_to_text(markup: Column) -> Column:
    """Plain text of HTML that may be escaped once more as a whole.

    Only rows holding an entity go to Python; the others stay in the JVM.
    """
    return F.coalesce(_plain_udf(F.when(_has_entity(markup), markup)), _native_plain(markup))


def part(text: Column, *, html: bool) -> Column:
    """A piece of a posting's text, as it was found."""
    return F.struct(F.lit(html).alias("html"), F.coalesce(text, F.lit("")).alias("text"))


def parts_to_text(parts: Column) -> Column:
    """Description from its parts: HTML ones cleaned, empty ones left out, joined by blanks.

    As in `html_to_text`, only rows with an entity in an HTML part go to Python.
    """
    markup = F.transform(parts, lambda p: F.when(p["html"], p["text"]).otherwise(""))
    cleaned = F.coalesce(
        _plain_each_udf(F.when(F.exists(markup, _has_entity), markup)),
        F.transform(markup, _native_plain),
    )
    texts = F.zip_with(parts, cleaned, lambda p, c: F.when(p["html"], c).otherwise(p["text"]))
    return strip_ws(F.array_join(F.filter(texts, lambda t: t != ""), " "))


def neutralise_fence(text: Column) -> Column:
    """A posting must not close the fence it is quoted in."""
    return F.regexp_replace(text, "(?iU)" + V.CLOSING_FENCE_PATTERN, V.NEUTRAL_FENCE)


def clean_location(raw: Column) -> Column:
    """Head of a noisy location: no parentheses, nothing after ';' or a spaced dash."""
    head = F.regexp_replace(raw, r"\([^)]*\)", "")
    head = F.substring_index(F.substring_index(head, ";", 1), " — ", 1)
    return strip_ws(F.btrim(strip_ws(head), F.lit(",")))


def html_escape(text: Column) -> Column:
    for char, entity in (
        ("&", "&amp;"),
        ("<", "&lt;"),
        (">", "&gt;"),
        ('"', "&quot;"),
        ("'", "&#x27;"),
    ):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def safe_url(url: Column) -> Column:
    """True for http and https only, whatever the case.

    Leading blanks and controls, and tabs and line breaks anywhere, do not count. A host with
    stray brackets is no url.
    """
    bare = F.translate(url, "\t\r\n", "")
    schemes = "|".join(V.SAFE_URL_SCHEMES)
    http = bare.rlike(rf"^[\x00-\x20]*(?i:{schemes}):")
    stray = bare.rlike(r"^[^:]*://[^/?#]*[\[\]]") & ~bare.rlike(
        r"^[^:]*://(?:[^/?#@]*@)?\[[0-9A-Fa-f:.]+\](?::\d*)?(?:[/?#]|$)"
    )
    return F.coalesce(http & ~stray, F.lit(False))
