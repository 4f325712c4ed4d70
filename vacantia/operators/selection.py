"""What goes into a digest: strong, varied, workable, and few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.functions.fit import company_key, rank_keys, title_key


def digest_filter(
    ranked: DataFrame, min_score: int = V.MIN_SCORE, workable_only: bool = True
) -> DataFrame:
    kept = ranked.where((F.col("status") == "ranked") & (F.col("score") >= min_score))
    return kept.where(F.col("location_tier") != V.OTHER_US) if workable_only else kept


def _first_of_each(df: DataFrame, keys: list[Column], n: int, seq: str) -> DataFrame:
    """First ``n`` rows per key in rank order.

    A posting without a company is a group of its own (keyed by ``seq``), so nameless postings
    are neither merged nor piled into one task, and one pass serves both kinds.
    """
    nameless = F.when(company_key(F.col("company")) == "", F.col(seq))
    order = Window.partitionBy(*keys, nameless).orderBy(*rank_keys(seq))
    return (
        df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")
    )


def collapse_roles(ranked: DataFrame, seq: str = "seq") -> DataFrame:
    """Best row of each (company, title)."""
    keys = [company_key(F.col("company")), title_key(F.col("title"))]
    return _first_of_each(ranked, keys, 1, seq)


def cap_per_company(
    ranked: DataFrame, per_company: int = V.PER_COMPANY, seq: str = "seq"
) -> DataFrame:
    """Best ``per_company`` rows of each company."""
    return _first_of_each(ranked, [company_key(F.col("company"))], per_company, seq)


def digest_top_n(ranked: DataFrame, limit: int = V.DIGEST_LIMIT, seq: str = "seq") -> DataFrame:
    return ranked.orderBy(*rank_keys(seq)).limit(limit)


def with_digest_rank(digest: DataFrame, seq: str = "seq") -> DataFrame:
    """Number the rows of a digest; its size is bounded by the digest limit."""
    return digest.withColumn("rank", F.row_number().over(Window.orderBy(*rank_keys(seq))))


def for_digest(
    ranked: DataFrame,
    limit: int = V.DIGEST_LIMIT,
    min_score: int = V.MIN_SCORE,
    per_company: int = V.PER_COMPANY,
    workable_only: bool = True,
    seq: str = "seq",
) -> DataFrame:
    """Filter, collapse roles, cap per company, cut: in this order."""
    strong = digest_filter(ranked, min_score, workable_only)
    varied = cap_per_company(collapse_roles(strong, seq), per_company, seq)
    return digest_top_n(varied, limit, seq)
