"""Landed documents: reading them, and taking them apart with a whole-document verdict.

A document of the wrong shape, or with one row that lacks a required field, fails as a whole.
The verdict is an expression over the parsed array, so no shuffle is needed to spread it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DETAIL = "workday_detail"
_LINE = (
    "payload_id string, slug string, query string, page int, path string, body string, "
    "source string, fetch_id string, fetched_at timestamp"
)

# What every normalised row carries of its payload.
PAYLOAD_COLUMNS = ("payload_id", "source", "slug", "query", "page", "path", "fetched_at", "fetch_id")


def payload_scan(
    spark: SparkSession,
    path: str,
    fetched_at: dt.datetime | Column,
    *,
    streaming: bool = False,
    packed: bool = False,
    fetches: bool = False,
) -> DataFrame:
    """Landed documents, batch or stream, below one `source=` folder per source.

    Plain: one file per document in `source=/slug=/query=/page=`; detail documents lie under
    `source=workday_detail` with their external path as `query`. Packed: JSON lines of
    (payload_id, slug, query, page, path, body), many documents to a file, which is the form for
    very many documents. Either way each normaliser reads its own source's folder only.

    A folder that more than one fetch of a query is landed in says which one a document is of. With
    ``fetches`` the plain layout has `fetch_id=/fetch_time=` below `source=`; packed lines have both
    as fetch_id and fetched_at. ``fetched_at`` is the time of documents that have none of their own;
    documents without a fetch_id count as one fetch.
    """
    reader = spark.readStream if streaming else spark.read
    when = fetched_at if isinstance(fetched_at, Column) else F.lit(fetched_at)
    when = when.cast("timestamp").alias("fetched_at")
    if packed:
        lines = reader.schema(_LINE).json(path)
        own = F.coalesce("fetched_at", when).alias("fetched_at")
        return lines.select(*[own if c == "fetched_at" else c for c in PAYLOAD_COLUMNS], "body")
    fetch = ", fetch_id string, fetch_time string" if fetches else ""
    fetch_id = F.col("fetch_id") if fetches else F.lit(None).cast("string")
    if fetches:
        own = F.col("fetch_time").try_cast("timestamp")
        when = F.coalesce(own, when).alias("fetched_at")
    files = (
        reader.schema(f"value string, source string, slug string, query string, page int{fetch}")
        .option("wholetext", "true")
        .text(path)
    )
    detail = F.col("source") == _DETAIL
    file_path = F.col("_metadata.file_path")
    return files.select(
        F.regexp_extract(file_path, r"/(source=[^/]*/.*)$", 1).alias("payload_id"),
        F.when(detail, "workday").otherwise(F.col("source")).alias("source"),
        "slug",
        F.when(~detail, F.col("query")).alias("query"),
        F.when(~detail, F.col("page")).alias("page"),
        F.when(detail, F.col("query")).alias("path"),
        F.col("value").alias("body"),
        when,
        fetch_id.alias("fetch_id"),
    )


def land_payloads(payloads: DataFrame, path: str, *, packed: bool = False) -> None:
    """Write documents in the layout `payload_scan` reads.

    In the plain layout source, slug, query and page name one document, and with a fetch_id column
    in ``payloads`` that as well; its time is landed with it.
    """
    fetches = "fetch_id" in payloads.columns
    if packed:
        fetch = ["fetch_id", "fetched_at"] if fetches else []
        lines = payloads.select(
            "payload_id", "slug", "query", "page", "path", "body", "source", *fetch
        )
        lines.write.partitionBy("source").mode("append").json(path)
        return
    detail = F.col("path").isNotNull()
    fetch = {"fetch_id": F.col("fetch_id"), "fetch_time": F.col("fetched_at").cast("string")}
    fetch = fetch if fetches else {}
    (
        payloads.select(
            F.col("body").alias("value"),
            F.when(detail, _DETAIL).otherwise(F.col("source")).alias("source"),
            "slug",
            F.coalesce("path", "query").alias("query"),
            F.coalesce("page", F.lit(1)).alias("page"),
            *[value.alias(name) for name, value in fetch.items()],
        )
        .write.partitionBy("source", *fetch, "slug", "query", "page")
        .mode("append")
        .text(path)
    )


def wrapped(body: Column, ddl: str) -> Column:
    """The document inside a one-element array.

    Parsing it in brackets makes text after the document, a second document, or an array in
    place of an object (or the reverse) a mismatch instead of something from_json forgives.
    """
    return F.from_json(F.concat(F.lit("["), body, F.lit("]")), f"array<{ddl}>")


def only(documents: Column) -> Column:
    """The single document of `wrapped`, or NULL."""
    return F.when(F.size(documents) == 1, F.get(documents, F.lit(0)))


def all_hold(items: Column, row_ok: Callable[[Column], Column]) -> Column:
    return F.forall(items, lambda item: F.coalesce(row_ok(item), F.lit(False)))


REJECT = "struct<reason:string,position:int,field:string>"


def first_fault(items: Column, fault: Callable[[Column], Column]) -> Column:
    """Where the first item is that cannot be read, and what it lacks; NULL if all can be."""
    faults = F.transform(items, fault)
    at = F.array_position(F.transform(faults, lambda f: f.isNotNull()), F.lit(True))
    return F.when(
        at > 0,
        F.struct(
            F.lit("field").alias("reason"),
            (at - 1).cast("int").alias("position"),
            F.element_at(faults, F.greatest(at, F.lit(1)).cast("int")).alias("field"),
        ),
    ).cast(REJECT)


def with_items(
    payloads: DataFrame,
    ddl: str,
    items_of: Callable[[Column], Column],
    row_ok: Callable[[Column], Column],
    fault: Callable[[Column], Column] | None = None,
    *,
    body: bool = False,
) -> DataFrame:
    """Add ``items``: the rows of a valid document, NULL for a failed one.

    Also ``reject``, why it failed: 'document' (not one document of its kind), 'items' (no list of rows
    in it) or 'field', with the position of the first row that lacks one and the field's name.
    """
    if "fetch_id" not in payloads.columns:
        payloads = payloads.withColumn("fetch_id", F.lit(None).cast("string"))
    kept = [*PAYLOAD_COLUMNS, "body"] if body else list(PAYLOAD_COLUMNS)
    # Parsed in a projection of its own, so that each body is parsed once.
    parsed = payloads.select(*kept, wrapped(F.col("body"), ddl).alias("docs"))
    document = only(F.col("docs"))
    parsed = parsed.select(
        *kept, items_of(document).alias("raw"), document.isNotNull().alias("readable")
    )
    raw = F.col("raw")
    if fault is None:
        fault = lambda i: F.when(~F.coalesce(row_ok(i), F.lit(False)), F.lit("item"))
    nothing = F.lit(None).cast(REJECT)
    reason = F.when(~F.col("readable"), "document").when(raw.isNull(), "items")
    shape = F.struct(reason, F.lit(None).cast("int"), F.lit(None).cast("string")).cast(REJECT)
    return parsed.select(
        *kept,
        F.when(raw.isNotNull() & all_hold(raw, row_ok), raw).alias("items"),
        F.when(raw.isNull(), shape)
        .when(~all_hold(raw, row_ok), first_fault(raw, fault))
        .otherwise(nothing)
        .alias("reject"),
    )


def rejects(documents: DataFrame) -> DataFrame:
    """The failed documents, with reason, position and field."""
    kept = [c for c in documents.columns if c not in ("items", "reject")]
    # The generator keeps the filter, and a parse for each mention of the document in it, above the parse.
    found = documents.select(*kept, F.explode_outer(F.array("reject")).alias("reject"))
    return found.where(F.col("reject").isNotNull()).select(*kept, "reject.*")


def item_rows(documents: DataFrame) -> DataFrame:
    """One row per item, ``pos`` in document order; failed documents give none."""
    # The outer form keeps Catalyst from pushing a second parse below the generator.
    return documents.select(
        *PAYLOAD_COLUMNS, F.posexplode_outer("items").alias("pos", "item")
    ).where(F.col("item").isNotNull())


def with_status(documents: DataFrame) -> DataFrame:
    """``status`` of every document: 'ok' or 'failed'."""
    return documents.select(
        *PAYLOAD_COLUMNS,
        F.when(F.col("items").isNull(), "failed").otherwise("ok").alias("status"),
        F.coalesce(F.size("items"), F.lit(0)).alias("n_items"),
    )
