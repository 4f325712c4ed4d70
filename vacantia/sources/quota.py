"""The per-query result cap of searched sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantia.session import new_work_dir, written
from vacantia.sources.payloads import PAYLOAD_COLUMNS, item_rows

#: One fetch of a query: the cap is that of a fetch, however many are landed.
_QUERY = ["source", "slug", "query", "fetch_id"]


def scan_ends(documents: DataFrame, page_size: int, max_results: int) -> DataFrame:
    """Where each fetch of a query stops: ``short_page``, and whether it ``failed`` on the way.

    ``documents`` have the number of their items, ``n``, which is NULL for a failed one.
    A scan ends after the first page shorter than ``page_size``, or once the pages before have filled
    the cap. A failed page that it reaches fails the whole query. These are partial aggregates over
    page sizes, so a query that owns a third of all pages is reduced before the shuffle; only queries
    with a failed page are counted a second time.
    """
    n = F.col("n")
    keys = [F.col(k).alias(f"f_{k}") for k in _QUERY]
    named = [f"f_{k}" for k in _QUERY]
    facts = documents.groupBy(*keys).agg(
        F.min(F.when(n < page_size, F.col("page"))).alias("short_page"),
        F.min(F.when(n.isNull(), F.col("page"))).alias("bad_page"),
    )
    broken = facts.where("bad_page is not null").select(
        *[F.col(k).alias(f"b_{k}") for k in named], F.col("bad_page").alias("first_bad")
    )
    sizes = documents.select(*keys, "page", "n")
    before = (
        sizes.join(broken, [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in named])
        .where(F.col("page") < F.col("first_bad"))
        .groupBy(*[F.col(f"b_{k}") for k in named])
        .agg(F.sum("n").alias("rows_before"))
    )
    short, bad = F.col("short_page"), F.col("bad_page")
    reached = (short.isNull() | (bad <= short)) & (
        F.coalesce("rows_before", F.lit(0)) < max_results
    )
    return (
        facts.join(before, [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in named], "left")
        .withColumn("failed", F.coalesce(bad.isNotNull() & reached, F.lit(False)))
        .select(*named, "short_page", "failed")
    )


def cap_rows(rows: DataFrame, max_results: int) -> DataFrame:
    """First ``max_results`` rows of each fetch of a query in page order.

    `row_number() <= n` keeps n rows per query in every map task before the shuffle.
    """
    order = Window.partitionBy(*_QUERY).orderBy("page", "payload_id", "pos")
    return (
        rows.withColumn("n_in_query", F.row_number().over(order))
        .where(F.col("n_in_query") <= max_results)
        .drop("n_in_query")
    )


def cap_per_query(
    documents: DataFrame, max_results: int, page_size: int | None = None
) -> DataFrame:
    """Items of each fetch of a query, cut to ``max_results``; paging stops after a short page.

    The cut comes first. Rows up to the short page lead the page order, so the result is the same,
    and the join sees ``max_results`` rows per query however many pages a query has.

    With ``page_size`` the documents are parsed once and written, each with its size and the items a cap
    can take of it: where a scan ends is read from the sizes alone.
    """
    if page_size is None:
        return cap_rows(item_rows(documents), max_results)
    sized = documents.select(
        *PAYLOAD_COLUMNS,
        F.when(F.col("items").isNotNull(), F.size("items")).alias("n"),
        F.slice("items", 1, max_results).alias("items"),
    )
    documents = written(sized, new_work_dir(documents.sparkSession, "pages"))
    rows = cap_rows(item_rows(documents), max_results)
    same_query = [F.col(k).eqNullSafe(F.col(f"f_{k}")) for k in _QUERY]
    ends = scan_ends(documents, page_size, max_results)
    return (
        rows.join(ends, same_query)
        .where(~F.col("failed"))
        .where(F.col("short_page").isNull() | (F.col("page") <= F.col("short_page")))
        .drop("short_page", "failed", *[f"f_{k}" for k in _QUERY])
    )
