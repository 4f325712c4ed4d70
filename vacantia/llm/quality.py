"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes and its histogram of common words are compared with those
of its language by Jensen-Shannon distance (base 2, so from 0 to 1). References are sums over every
document of a language that passes the base rules. A histogram is judged only where the document is
long enough to have one. Base rules: at least ten words, and at most a fifth of the words inside
five-word windows that occur twice or more.

Defined results: a null or empty text has no words and fails the base rules. A document whose language
is null or has no reference is compared with every reference and keeps the nearest; with no reference
at all, only the base rules decide. Repeated rows are judged one by one. Common words are known for
the languages listed below; in others the word histogram is not judged. Columns other than doc_id,
text and lang are passed by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.common import SPACE, new_work_dir, table, words, written

# --- fixed values: common words by language ------------------------------------------
COMMON_WORDS = {
    "en": (
        "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be",
        "by", "on", "not", "he", "this", "are", "or", "his", "from", "at", "which", "have", "an",
    ),
    "de": (
        "der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für",
        "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "an", "er", "so", "dass",
    ),
    "fr": (
        "de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui",
        "dans", "a", "par", "plus", "pas", "au", "sur", "ne", "se", "il", "sont", "avec", "on",
    ),
    "es": (
        "de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con",
        "no", "una", "su", "para", "es", "al", "lo", "como", "más", "o", "pero", "sus", "le",
    ),
}
#: Character classes besides "anything else", as JVM patterns of what to remove.
CHAR_CLASSES = (
    r"\p{Ll}+", r"\p{Lu}+", r"[.,;:'\-]+", r"[\x20\x09-\x0D]+", r"[!?]+", r"[#*$%&|<>]+",
)
#: Digits are left out: a telephone number in a short text is no sign of a bad one. What consists of
#: numbers is told by the white space and punctuation that are left.
LEFT_OUT = r"\p{N}+"
SYMBOL_CLASS = r"[#*$%&|<>]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Texts shorter than this have no stable histogram.
MIN_CHARS_FOR_CLASSES = 200
MIN_WORDS_FOR_COMMON = 60
MAX_LANGUAGES = 500
#: Of character classes and of common words: within these a document counts for the reference.
REFERENCE_DISTANCE = 0.13, 0.30
MAX_CLASS_DISTANCE = 0.17
MAX_WORD_DISTANCE = 0.45

#: What common words are freed of at either end.
_PUNCTUATION = ".,;:!?'\"()-#*$%&|<>"


def _measured(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang and the narrow features of every text; ``row`` holds the columns to keep.

    Five-word windows are compared by 64-bit hashes of the words' hashes: after a sort, equal
    neighbours are repeats, and overlapping windows count their words once.
    """
    text = F.coalesce("text", F.lit(""))
    carried = F.struct(*keep).alias("row") if keep else F.lit(None).cast("string").alias("row")
    split = docs.select(
        "doc_id",
        "lang",
        carried,
        text.alias("text"),
        words(F.col("text")).alias("words"),
        F.filter(F.split(text, "\n"), lambda s: s.rlike(NOT_SPACE)).alias("lines"),
    )
    common = sorted({w for group in COMMON_WORDS.values() for w in group})
    # The classes share no character, so each is counted in what the ones before it have left: small
    # letters go first, and the other patterns see the rest of the text only.
    rest, patterns = split.withColumn("rest", F.col("text")), (*CHAR_CLASSES, LEFT_OUT)
    for n, pattern in enumerate(patterns):
        rest = rest.withColumn("less", F.regexp_replace("rest", pattern, ""))
        rest = rest.withColumn(f"class{n}", F.length("rest") - F.length("less"))
        rest = rest.drop("rest").withColumnRenamed("less", "rest")
    counted = rest.select(
        "doc_id",
        "lang",
        "row",
        F.size("words").alias("n_words"),
        (F.length("text") - F.col(f"class{CHAR_CLASSES.index(SPACE)}"))
        .cast("long")
        .alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length("text").alias("n_text"),
        F.array(*[F.col(f"class{n}") for n in range(len(patterns))]).alias("classes"),
        F.concat(
            F.lit(" "),
            F.array_join(
                F.filter(
                    F.transform("words", lambda w: F.lower(F.btrim(w, F.lit(_PUNCTUATION)))),
                    lambda w: w.isin(common),
                ),
                "  ",
            ),
            F.lit(" "),
        ).alias("common"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("word_hashes"),
    )
    # An array that a lambda reads at an index must be a column by then, not an expression: it is
    # read several times there, so that the optimizer leaves it so.
    windows = counted.withColumn(
        "windows",
        F.when(
            F.col("n_words") >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.col("n_words") - WINDOW, F.lit(0))),
                lambda i: F.xxhash64(
                    *[F.get(F.col("word_hashes"), i + k) for k in range(WINDOW)]
                ),
            ),
        ),
    )
    # Most texts repeat no window, which a hash set tells without a sort.
    by_hash = windows.withColumn(
        "by_hash",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(
                F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
            ),
        ),
    )
    twice = by_hash.withColumn(
        "places",
        F.sort_array(
            F.transform(
                F.filter(
                    "by_hash",
                    lambda w, n: (w["h"] == F.get(F.col("by_hash"), n - 1)["h"])
                    | (w["h"] == F.get(F.col("by_hash"), n + 1)["h"]),
                ),
                lambda w: w["i"],
            )
        ),
    )
    covered = F.aggregate(
        "places",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(
            p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")
        ),
        lambda acc: acc["n"],
    )
    return twice.select(
        "doc_id",
        "lang",
        "row",
        F.col("n_words").cast("long").alias("n_words"),
        "word_chars",
        F.get("classes", F.lit(CHAR_CLASSES.index(SYMBOL_CLASS))).cast("long").alias("n_symbols"),
        "n_dup_lines",
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        "n_text",
        F.concat(
            F.slice("classes", 1, len(CHAR_CLASSES)),
            F.array(F.col("n_text") - F.aggregate("classes", F.lit(0), lambda a, x: a + x)),
        ).alias("classes"),
        F.create_map(
            *[
                part
                for lang, group in COMMON_WORDS.items()
                for part in (F.lit(lang), _bins(group))
            ]
        ).alias("common_by_lang"),
    )


def _bins(group: tuple[str, ...]) -> Column:
    """How often each common word occurs, and then all other words."""

    def times(word: str) -> Column:
        """The words stand between spaces of their own, so that none hides its neighbour."""
        without = F.length(F.replace("common", F.lit(f" {word} "), F.lit("")))
        return ((F.length("common") - without) / (len(word) + 2)).cast("int")

    each = [times(c) for c in group]
    return F.array(*each, F.col("n_words") - sum(each[1:], each[0]))


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def _shares(counts: Column) -> Column:
    total = F.greatest(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x), F.lit(1.0))
    return F.transform(counts, lambda x: x / total)


def _literals(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares of equal length."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: (part(x, y) + part(y, x)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def measure(spark: SparkSession, docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The features of every text, written once: two passes read them, none splits texts again."""
    return written(_measured(docs, keep), new_work_dir(spark, "quality"))


def references(features: DataFrame) -> DataFrame:
    """lang, classes, common: shares over the documents of a language that are near to most.

    A first reference sums all documents that pass the base rules; the second sums those of them that
    are long enough to judge and lie within REFERENCE_DISTANCE of the first, so that odd documents do
    not move what they are measured by. Both cover the whole table.
    """
    first = _summed(features)
    near = judge(features, first).where(
        (F.col("n_text") >= MIN_CHARS_FOR_CLASSES)
        & (F.col("n_words") >= MIN_WORDS_FOR_COMMON)
        & (F.coalesce("class_distance", F.lit(0.0)) <= REFERENCE_DISTANCE[0])
        & (F.coalesce("word_distance", F.lit(0.0)) <= REFERENCE_DISTANCE[1])
    )
    second = _summed(near)
    only_first = first.join(second, "lang", "left_anti")
    return second.unionByName(only_first)


def _summed(features: DataFrame) -> DataFrame:
    n_classes = len(CHAR_CLASSES) + 1
    n_common = max(len(g) for g in COMMON_WORDS.values()) + 1
    own = F.col("common_by_lang")[F.col("lang")]
    sums = (
        features.where(~_base_failed() & F.col("lang").isNotNull())
        .select("lang", "classes", own.alias("common"))
        .groupBy("lang")
        .agg(
            *[F.sum(F.get("classes", F.lit(k))).alias(f"c{k}") for k in range(n_classes)],
            *[F.sum(F.get("common", F.lit(k))).alias(f"w{k}") for k in range(n_common)],
        )
    )
    return sums.select(
        "lang",
        _shares(F.array(*[F.col(f"c{k}") for k in range(n_classes)])).alias("classes"),
        _shares(
            F.filter(F.array(*[F.col(f"w{k}") for k in range(n_common)]), lambda x: x.isNotNull())
        ).alias("common"),
    )


def judge(features: DataFrame, refs: DataFrame) -> DataFrame:
    """Features with class_distance, word_distance, base_failed and kept.

    ``refs`` has a row per language, MAX_LANGUAGES at most (more is an error), and becomes literals:
    no language, however frequent, gathers its documents in one task.
    """
    rows = refs.orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    none = "array<struct<lang:string,classes:array<double>,common:array<double>>>"
    known = (
        F.array(
            *[
                F.struct(
                    F.lit(r["lang"]).alias("lang"),
                    _literals(r["classes"]).alias("classes"),
                    _literals(r["common"]).alias("common"),
                )
                for r in rows
            ]
        )
        if rows
        else F.array().cast(none)
    )
    with_refs = features.withColumn("refs", known)
    own = F.filter("refs", lambda r: r["lang"] == F.col("lang"))
    chosen = with_refs.withColumn("near", F.when(F.size(own) > 0, own).otherwise(F.col("refs")))
    apart = F.transform(
        "near",
        lambda r: F.struct(
            js_distance(_shares(F.col("classes")), r["classes"]).alias("class_distance"),
            F.when(
                F.size(r["common"]) > 0,
                js_distance(_shares(F.col("common_by_lang")[r["lang"]]), r["common"]),
            ).alias("word_distance"),
        ),
    )
    nearest = chosen.withColumn("d", F.array_min(apart)).drop("refs", "near")
    fair = (F.col("n_text") < MIN_CHARS_FOR_CLASSES) | (
        F.coalesce(F.col("d.class_distance"), F.lit(0.0)) <= MAX_CLASS_DISTANCE
    )
    usual = (F.col("n_words") < MIN_WORDS_FOR_COMMON) | (
        F.coalesce(F.col("d.word_distance"), F.lit(0.0)) <= MAX_WORD_DISTANCE
    )
    return nearest.select(
        "doc_id",
        "lang",
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "n_text",
        "classes",
        "common_by_lang",
        "d.class_distance",
        "d.word_distance",
        _base_failed().alias("base_failed"),
        (~_base_failed() & fair & usual).alias("kept"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = measure(spark, table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judge(features, references(features)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the rules reject. Repeated rows are judged one by one."""
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    features = measure(spark, rows, keep=("text", "source", "n_chars"))
    judged = judge(features, references(features)).where("kept")
    return judged.select("doc_id", "row.text", "lang", "row.source", "row.n_chars")
