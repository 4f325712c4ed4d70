"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds are e-mail addresses, IPv4 addresses, payment cards (Luhn) and international phone
numbers. The method adds account numbers (IBAN, cut to their country's length and confirmed by mod 97)
and national phone or id numbers, which count only near a word that says what they are. Every span has a score: what its pattern and
checksum are worth, plus what the words around it say. Base spans stay whatever their score; added
ones need MIN_SCORE.

Defined results: a null text is an empty one and has no spans. Spans count code points and the end is
exclusive. Repeated rows are searched one by one; texts are searched whole, in time linear in their
length. Columns other than doc_id and text are passed by.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.common import slices, table

KINDS = ("email", "ip", "card", "phone")
ADDED = ("iban", "number")
#: Characters on either side in which context words count.
CONTEXT = 48
MIN_SCORE = 0.6

# --- fixed values: what a span is worth, and the words that speak for it ----------------
BASE_SCORE = {
    "email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "number": 0.3,
}
CONTEXT_WORDS = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel", "kontakt"),
    "ip": ("ip", "address", "server", "host", "adresse", "dirección", "login"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "mobile", "call", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta", "bic", "swift"),
    "number": ("phone", "tel", "mobile", "fax", "telefon", "téléphone", "teléfono", "ssn"),
}
CONTEXT_BONUS = 0.35
#: Places of an IBAN by country (ISO 13616); of other countries any length is tried.
IBAN_LENGTHS = {
    country: places
    for places, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI",
        20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
        27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# Possessive runs that start where no digit stands before: the same matches, without retries.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NUMBER = re.compile(r"(?<![0-9.+-])\(?[0-9](?:[ ()/.-]{0,2}[0-9]){6,11}(?![0-9])")
_NOT_DIGIT = re.compile(r"[^0-9]")


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        total += digit if place % 2 == 0 else digit * 2 - 9 * (digit > 4)
    return total % 10 == 0


def mod_97(account: str) -> bool:
    """The check of an IBAN: letters count from 10, the first four places stand last."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The run of local characters before each @ is taken whole, so no start is tried twice."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = last + len(text[last:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        last = domain.end() if domain else at + 1
        at = text.find("@", last)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The base kinds: leftmost matches that do not overlap, less those that fail their check."""
    found = [(s, e, "email") for s, e in _emails(text)]
    if "." in text:
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
                found.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


_WORDS_NEAR = {k: re.compile("|".join(rf"\b{w}\b" for w in v)) for k, v in CONTEXT_WORDS.items()}


def _score(text: str, start: int, end: int, kind: str) -> float:
    around = f"{text[max(0, start - CONTEXT) : start]} \n {text[end : end + CONTEXT]}".lower()
    bonus = CONTEXT_BONUS if _WORDS_NEAR[kind].search(around) else 0.0
    return min(1.0, BASE_SCORE[kind] + bonus)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers, less the upper-case words and numbers that follow them.

    A candidate ends where one of its groups does, at the length of its country or, for a country not
    listed, at the longest one that passes. Within a candidate that fails the next one is looked for.
    """
    m = _IBAN.search(text)
    while m:
        want = IBAN_LENGTHS.get(m[0][:2])
        ends, at, places = [], m.start(), 0
        for group in m[0].split(" "):
            at, places = at + len(group), places + len(group)
            if places == want or (want is None and 15 <= places <= 34):
                ends.append(at)
            at += 1
        passed = (e for e in reversed(ends) if mod_97(text[m.start() : e].replace(" ", "")))
        end = next(passed, None)
        if end:
            yield m.start(), end
        m = _IBAN.search(text, end or m.start() + 1)


def find_spans(text: str | None) -> list[Span]:
    """All spans of a text: base ones, and added ones that reach MIN_SCORE and overlap no other."""
    text = text or ""
    base = base_spans(text)
    added = [(s, e, "iban") for s, e in _ibans(text)]
    if _WORDS_NEAR["number"].search(text.lower()):
        added += [(*m.span(), "number") for m in _NUMBER.finditer(text)]
    spans = [Span(s, e, k, _score(text, s, e, k)) for s, e, k in base]
    taken = sorted((s, e) for s, e, _ in base)
    for s, e, k in added:
        at = bisect_left(taken, (s, e))
        clear = all(b <= s or e <= a for a, b in taken[max(0, at - len(KINDS)) : at + 1])
        if clear and (score := _score(text, s, e, k)) >= MIN_SCORE:
            taken.insert(at, (s, e))
            spans.append(Span(s, e, k, score))
    order = (*KINDS, *ADDED)
    return sorted(spans, key=lambda x: (x.start, order.index(x.kind)))


def redact(text: str, spans: list[Span]) -> str:
    """Each span gives way to its kind in brackets; overlapping spans give way together."""
    parts, last = [], 0
    for span in spans:
        if span.start >= last:
            parts += [text[last : span.start], f"[{span.kind.upper()}]"]
        last = max(last, span.end)
    return "".join((*parts, text[last:]))


_SPANS = "array<struct<start:long,end:long,kind:string,score:double>>"


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, spans and redacted text of every row."""
    kind = pa.list_(
        pa.struct(
            [("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]
        )
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = [t or "" for t in part.column("text").to_pylist()]
            found = [find_spans(t) for t in texts]
            clean = [redact(t, s) if s else t for t, s in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([[s._asdict() for s in spans] for spans in found], kind),
                    pa.array(clean, pa.string()),
                ],
                ["doc_id", "spans", "redacted"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        search, f"doc_id {id_type}, spans {_SPANS}, redacted string"
    )


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias(
            "highest_score"
        ),
    )


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its personal data gives way to the kind's name in brackets."""

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = [t or "" for t in part.column("text").to_pylist()]
            clean = [redact(t, find_spans(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(clean, pa.string()),
                    part.column("lang"),
                    part.column("source"),
                    pa.array([len(t) for t in clean], pa.int64()),
                ],
                ["doc_id", "text", "lang", "source", "n_chars"],
            )

    rows = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long"))
    return rows.mapInArrow(masked, rows.schema)
