"""The two-stage source: thin search hits, completed by detail documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia import schemas as S
from vacantia.functions.identity import job_id, parse_posted_at
from vacantia.functions.text import null_if_empty, part
from vacantia.sources import fields
from vacantia.sources.payloads import PAYLOAD_COLUMNS, item_rows, only, with_items, wrapped
from vacantia.sources.quota import cap_per_query


def _usable(hit: Column) -> Column:
    return null_if_empty(hit["title"]).isNotNull() & null_if_empty(hit["externalPath"]).isNotNull()


def stub_documents(payloads: DataFrame, *, body: bool = False) -> DataFrame:
    """Search documents with the hits that can be acted on.

    A hit without title or path is skipped and does not fail its document.
    """
    searches = payloads.where((F.col("source") == "workday") & F.col("path").isNull())
    read = with_items(
        searches,
        S.WORKDAY_SEARCH_DOC,
        lambda d: d["jobPostings"],
        lambda i: i.isNotNull(),
        body=body,
    )
    return read.withColumn("items", F.filter("items", _usable))


def detail_documents(payloads: DataFrame, *, body: bool = False) -> DataFrame:
    """Detail documents; what a posting cannot do without is a title."""
    details = payloads.where((F.col("source") == "workday") & F.col("path").isNotNull())
    titled = "jobPostingInfo.title"
    return with_items(
        details,
        S.WORKDAY_DETAIL_DOC,
        lambda d: F.when(d["jobPostingInfo"].isNotNull(), F.array(d["jobPostingInfo"])),
        lambda i: i["title"].isNotNull(),
        lambda i: F.when(i["title"].isNull(), F.lit(titled)),
        body=body,
    )


def workday_stubs(payloads: DataFrame, max_results: int | None = None) -> DataFrame:
    """Search hits that can be acted on; with ``max_results``, as many as a scan would keep."""
    found = stub_documents(payloads)
    hits = item_rows(found) if max_results is None else cap_per_query(found, max_results, 1)
    item = F.col("item")
    return hits.select(
        *[c for c in PAYLOAD_COLUMNS if c != "path"],
        "pos",
        item["title"].alias("title"),
        item["externalPath"].alias("external_path"),
        F.coalesce(item["locationsText"], F.lit("")).alias("location"),
        F.get(item["bulletFields"], F.lit(0)).alias("req_id"),
    )


def readable_details(payloads: DataFrame) -> DataFrame:
    """Every readable copy of a detail document, keyed by tenant (``slug``) and external path."""
    details = payloads.where((F.col("source") == "workday") & F.col("path").isNotNull())
    docs = details.select(
        F.col("slug").alias("d_slug"),
        F.col("path").alias("d_path"),
        "payload_id",
        "fetched_at",
        wrapped(F.col("body"), S.WORKDAY_DETAIL_DOC).alias("docs"),
    )
    # The generator keeps the filter above the parse.
    return docs.select(
        "d_slug",
        "d_path",
        "payload_id",
        "fetched_at",
        F.explode_outer(F.array(only(F.col("docs"))["jobPostingInfo"])).alias("info"),
    ).where(F.col("info").isNotNull())


def workday_details(payloads: DataFrame) -> DataFrame:
    """The latest readable copy of each detail document.

    A path landed twice still completes each stub once.
    """
    same_path = Window.partitionBy("d_slug", "d_path").orderBy(F.desc("fetched_at"), "payload_id")
    return (
        readable_details(payloads)
        .withColumn("copy", F.row_number().over(same_path))
        .where(F.col("copy") == 1)
        .drop("copy", "payload_id", "fetched_at")
    )


def workday_hydrate(
    stubs: DataFrame,
    details: DataFrame,
    boards: DataFrame,
    company: Column | None = None,
    keep: Column | None = None,
) -> DataFrame:
    """Postings, text in ``body_parts``, for the stubs that ``keep`` wants and whose detail could be read.

    A stub without a readable detail is dropped and the rest survive. A detail without a title
    fails the whole fetch of its query: those are found on narrow rows and anti-joined away.
    """
    wanted = stubs if keep is None else stubs.where(keep)
    # The stub's own title and location serve `keep` only; the posting's come from the detail.
    wanted = wanted.drop("title", "location", "req_id")
    same_job = (F.col("slug") == F.col("d_slug")) & (F.col("external_path") == F.col("d_path"))
    query = ["slug", "query", "fetch_id"]
    untitled = details.where(F.col("info")["title"].isNull()).select("d_slug", "d_path")
    failed = (
        wanted.select(*query, "external_path")
        .join(untitled, same_job, "left_semi")
        .select(*[F.col(k).alias(f"f_{k}") for k in query])
        .distinct()
    )
    whole = wanted.join(
        failed, [F.col(k).eqNullSafe(F.col(f"f_{k}")) for k in query], "left_anti"
    )
    return completed(whole.join(details, same_job), boards, company)


def whole_fetches(met: DataFrame) -> DataFrame:
    """Stubs with their detail's ``info``, without those of a fetch that met an untitled one.

    ``met`` is a written table, as it is read twice.
    """
    query = ["slug", "query", "fetch_id"]
    untitled = met.where(F.col("info")["title"].isNull())
    failed = untitled.select(*[F.col(k).alias(f"f_{k}") for k in query]).distinct()
    return met.join(failed, [F.col(k).eqNullSafe(F.col(f"f_{k}")) for k in query], "left_anti")


def completed(met: DataFrame, boards: DataFrame, company: Column | None = None) -> DataFrame:
    """Postings, text in ``body_parts``, of stubs beside their detail's ``info``."""
    sites = boards.select(
        F.col("tenant").alias("b_tenant"), "site", "host", F.col("company").alias("b_company")
    )
    rows = met.join(sites, F.col("slug") == F.col("b_tenant"), "left")
    info = F.col("info")
    source_id = fields.workday_source_id(F.col("slug"), info)
    place = F.coalesce(info["location"], F.lit(""))
    name = F.coalesce(F.col("b_company"), F.col("slug"))
    return rows.select(
        F.struct(
            F.array_position(F.lit(list(V.SOURCES)), F.col("source")).alias("source_order"),
            F.col("payload_id").alias("payload_id"),
            F.col("pos").alias("pos"),
        ).alias("seq"),
        "payload_id",
        "slug",
        "query",
        job_id(F.col("source"), source_id).alias("job_id"),
        "source",
        source_id.alias("source_id"),
        (name if company is None else F.coalesce(company, F.col("slug"))).alias("company"),
        info["title"].alias("title"),
        fields.workday_url(F.col("host"), F.col("site"), info).alias("url"),
        null_if_empty(place).alias("location"),
        F.contains(F.lower(place), F.lit("remote")).alias("remote"),
        F.lit(None).cast("string").alias("salary"),
        F.lit(False).alias("salary_is_estimated"),
        F.array(part(info["jobDescription"], html=True)).alias("body_parts"),
        parse_posted_at(info["startDate"]).alias("posted_at"),
        "fetched_at",
    )


def extract_workday(
    payloads: DataFrame,
    boards: DataFrame,
    max_results: int | None = None,
    keep: Column | None = None,
) -> DataFrame:
    return workday_hydrate(
        workday_stubs(payloads, max_results), workday_details(payloads), boards, keep=keep
    )
