"""Language identification by rank-order profiles of character n-grams.

The most frequent 1- to 3-grams of letters of a language, in order of frequency, are its profile.
A document's own most frequent n-grams are compared with each profile by the out-of-place distance:
how far each n-gram stands from its place in the profile, or the profile's length if it is missing.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if
there is nothing to learn from. Equal counts order by code point, equal distances by language name.
Repeated rows are answered one by one. Rows without a language are not learned from; a null id has
the fold of an empty text. Long texts are counted whole, a million characters at a time. Columns
other than those named are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia.llm.common import crc_fold, slices, table

PROFILE_SIZE = 400
#: A profile table has this many languages at most; more are refused, not dropped.
MAX_LANGUAGES = 5_000
_BLOCK = 1_000_000
_PAD = 1


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_codes(text: str) -> np.ndarray:
    """Codes of all 1- to 3-grams of letters, lower case, each word padded on both sides."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(_letters()[codes], codes, _PAD).astype(np.int64)
    codes = np.concatenate(([_PAD], codes, [_PAD]))
    codes = codes[np.concatenate(([True], (codes[1:] != _PAD) | (codes[:-1] != _PAD)))]
    ones = codes[codes != _PAD]
    twos = codes[:-1] << 21 | codes[1:]
    threes = (codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])[codes[1:-1] != _PAD]
    return np.concatenate((ones, twos, threes)) if len(ones) else ones


def _blocks(text: str) -> Iterator[str]:
    """Parts of about a million characters, cut between words where there are any."""
    start = 0
    while start < len(text):
        end = start + _BLOCK
        if end < len(text):
            end = max(text.rfind(" ", start + 1, end), text.rfind("\n", start + 1, end)) + 1 or end
        yield text[start:end]
        start = end


def _merged(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(grams, return_inverse=True)
    return keys, np.bincount(place, counts, len(keys)).astype(np.int64)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text in code order, and how often each occurs."""
    parts = [np.unique(gram_codes(b), return_counts=True) for b in _blocks(text)]
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return _merged(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def _count_by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for lang, (grams, counts) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)],
                ["lang", "gram", "n"],
            )
        held.clear()

    for part in slices(batches, "text", 1_000_000):
        by_lang: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(*(part.column(c).to_pylist() for c in ("lang", "text")), strict=True):
            for block in _blocks(text):
                by_lang.setdefault(lang, []).append(gram_codes(block))
        for lang, found in by_lang.items():
            grams, counts = np.unique(np.concatenate(found), return_counts=True)
            if lang in held:
                grams, counts = _merged(
                    np.concatenate((held[lang][0], grams)), np.concatenate((held[lang][1], counts))
                )
            held[lang] = grams, counts
        if sum(len(g) for g, _ in held.values()) > 500_000:
            yield from flushed()
    yield from flushed()


def learn_profiles(docs: DataFrame, learn: Column, size: int = PROFILE_SIZE) -> DataFrame:
    """lang, gram, rank from 0: the ``size`` most frequent n-grams of each language.

    ``learn`` says which rows of ``docs`` (text, lang) may be learned from. Counts cover them all;
    each task sums its own n-grams before the shuffle.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = (
        rows.select("lang", "text")
        .mapInArrow(_count_by_language, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return (
        counted.select("lang", "gram", place.alias("place"))
        .where(F.col("place") <= size)
        .select("lang", "gram", (F.col("place") - 1).alias("rank"))
    )


class Profiles:
    """Profiles of a bounded number of languages, for use inside tasks."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE_SIZE):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.array(sorted({r[1] for r in rows}), np.int64)
        self.ranks = np.full((len(self.langs), len(self.grams)), -1, np.int64)
        at = {lang: n for n, lang in enumerate(self.langs)}
        for lang, gram, rank in rows:
            self.ranks[at[lang], np.searchsorted(self.grams, gram)] = rank

    @classmethod
    def collect(cls, profiles: DataFrame, size: int = PROFILE_SIZE) -> Profiles:
        """At most MAX_LANGUAGES times ``size`` rows reach the driver; more is an error."""
        rows = profiles.limit(MAX_LANGUAGES * size + 1).collect()
        if len(rows) > MAX_LANGUAGES * size:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        return cls([tuple(r) for r in rows], size)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with the smallest out-of-place distance; 1 less its share of the worst."""
        grams, counts = gram_counts(text or "")
        if not len(grams) or not self.langs:
            return "und", 0.0
        own = grams[np.argsort(-counts, kind="stable")[: self.size]]
        place = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        known = self.ranks[:, place]
        apart = np.abs(known - np.arange(len(own)))
        apart[(known < 0) | (self.grams[place] != own)] = self.size
        total = apart.sum(axis=1)
        best = int(total.argmin())
        return self.langs[best], 1.0 - float(total[best]) / (self.size * len(own))


def identify(docs: DataFrame, profiles: DataFrame, size: int = PROFILE_SIZE) -> DataFrame:
    """``docs`` (with a text column) with lang_pred and lang_score; rows stay where they are."""
    known = Profiles.collect(profiles, size)
    names = docs.columns
    schema = docs.select("*").schema.add("lang_pred", "string").add("lang_score", "double")
    if {"lang_pred", "lang_score"} & set(names):
        raise ValueError("docs already has lang_pred or lang_score")

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [known.predict(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns,
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                [*names, "lang_pred", "lang_score"],
            )

    return docs.mapInArrow(answers, schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_fold(F.col("doc_id"), 0)
    profiles = learn_profiles(docs, ~held_out)
    answered = identify(docs.select("doc_id", "text"), profiles)
    return answered.select(
        "doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language; the rest carry the language found in their text.

    A score of 0 is the distance of no match: not one n-gram of the text is in any profile, all
    languages are equally far, and the name `predict` gives is the first one only by order.
    """
    profiles = learn_profiles(docs, ~crc_fold(F.col("doc_id"), 0))
    answered = identify(docs.select("doc_id", "text", "source", "n_chars"), profiles)
    return answered.where((F.col("lang_pred") != "und") & (F.col("lang_score") > 0)).select(
        "doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars"
    )
