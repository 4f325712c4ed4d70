"""One normaliser per source: landed documents in, postings out."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia import schemas as S
from vacantia.functions.identity import job_id, parse_posted_at, parse_posted_millis
from vacantia.functions.text import null_if_empty, part, parts_to_text
from vacantia.sources import fields
from vacantia.sources.payloads import item_rows, rejects, with_items, with_status
from vacantia.sources.quota import cap_per_query
from vacantia.sources.workday import detail_documents, extract_workday, stub_documents


def _filled(*values: Column) -> Column:
    return reduce(lambda a, b: a & b, [v.isNotNull() for v in values])


def _or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _no_text() -> Column:
    return F.lit(None).cast("string")


@dataclass(frozen=True)
class Source:
    """How one kind of document is read. Functions take the item and the row's company.

    A row that lacks a ``required`` field fails its document. One that ``keep`` drops is dropped before it
    is read, so it may lack anything.
    """

    ddl: str
    items_of: Callable[[Column], Column]
    required: tuple[str, ...]
    keep: Callable[[Column], Column] | None
    project: Callable[[Column, Column], Mapping[str, Column]]

    def row_ok(self, item: Column) -> Column:
        whole = _filled(*[_at(item, path) for path in self.required])
        return whole if self.keep is None else item.isNotNull() & (~self.keep(item) | whole)

    def fault(self, item: Column) -> Column:
        """The first required field that a row lacks, or NULL."""
        missing = [F.when(_at(item, path).isNull(), F.lit(path)) for path in self.required]
        found = F.when(item.isNull(), F.lit("item")).otherwise(F.coalesce(*missing))
        if self.keep is None:
            return found
        return F.when(item.isNull() | self.keep(item), found)


def _at(item: Column, path: str) -> Column:
    return reduce(lambda at, name: at[name], path.split("."), item)


def _greenhouse(i: Column, company: Column) -> Mapping[str, Column]:
    return {
        "source_id": i["id"],
        "company": i["company_name"],
        "title": i["title"],
        "url": i["absolute_url"],
        "location": i["location"]["name"],
        "remote": fields.greenhouse_remote(i["location"]["name"], i["metadata"]),
        "salary": _no_text(),
        "salary_is_estimated": F.lit(False),
        "body_parts": F.array(part(i["content"], html=True)),
        "posted_at": parse_posted_at(i["first_published"]),
    }


def _lever(i: Column, company: Column) -> Mapping[str, Column]:
    return {
        "source_id": i["id"],
        "company": company,
        "title": i["text"],
        "url": i["hostedUrl"],
        "location": fields.lever_locations(i["categories"]),
        "remote": F.coalesce(i["workplaceType"] == "remote", F.lit(False)),
        "salary": _no_text(),
        "salary_is_estimated": F.lit(False),
        "body_parts": fields.lever_description_parts(
            i["descriptionPlain"], i["lists"], i["additionalPlain"]
        ),
        "posted_at": parse_posted_millis(i["createdAt"]),
    }


def _ashby(i: Column, company: Column) -> Mapping[str, Column]:
    return {
        "source_id": i["id"],
        "company": company,
        "title": i["title"],
        "url": i["jobUrl"],
        "location": fields.ashby_locations(i["location"], i["secondaryLocations"]),
        "remote": fields.ashby_remote(i["workplaceType"]),
        "salary": fields.ashby_salary(i["compensation"]),
        "salary_is_estimated": F.lit(False),
        "body_parts": F.array(part(i["descriptionPlain"], html=True)),
        "posted_at": parse_posted_at(i["publishedAt"]),
    }


def _remotive(i: Column, company: Column) -> Mapping[str, Column]:
    return {
        "source_id": i["id"],
        "company": _or_empty(i["company_name"]),
        "title": i["title"],
        "url": i["url"],
        "location": null_if_empty(i["candidate_required_location"]),
        "remote": F.lit(True),
        "salary": null_if_empty(i["salary"]),
        "salary_is_estimated": F.lit(False),
        "body_parts": F.array(part(i["description"], html=True)),
        "posted_at": parse_posted_at(i["publication_date"]),
    }


def _adzuna(i: Column, company: Column) -> Mapping[str, Column]:
    location = i["location"]["display_name"]
    return {
        "source_id": i["id"],
        "company": _or_empty(i["company"]["display_name"]),
        "title": i["title"],
        "url": fields.adzuna_apply_url(i["redirect_url"]),
        "location": location,
        "remote": fields.adzuna_remote(
            i["title"], location, parts_to_text(F.array(part(i["description"], html=True)))
        ),
        "salary": fields.adzuna_salary(i["salary_min"], i["salary_max"]),
        "salary_is_estimated": fields.adzuna_estimated(
            i["salary_min"], i["salary_max"], i["salary_is_predicted"]
        ),
        "body_parts": F.array(part(i["description"], html=True)),
        "posted_at": parse_posted_at(i["created"]),
    }


def _usajobs(i: Column, company: Column) -> Mapping[str, Column]:
    md = i["MatchedObjectDescriptor"]
    details = md["UserArea"]["Details"]
    return {
        "source_id": md["PositionID"],
        "company": _or_empty(md["OrganizationName"]),
        "title": md["PositionTitle"],
        "url": _or_empty(md["PositionURI"]),
        "location": null_if_empty(md["PositionLocationDisplay"]),
        "remote": F.coalesce(details["RemoteIndicator"], F.lit(False)),
        "salary": fields.usajobs_salary(md["PositionRemuneration"]),
        "salary_is_estimated": F.lit(False),
        "body_parts": F.array(part(details["JobSummary"], html=True)),
        "posted_at": parse_posted_at(md["PublicationStartDate"]),
    }


def _listed(i: Column) -> Column:
    return F.coalesce(i["isListed"], F.lit(True))


BOARD_SOURCES: dict[str, Source] = {
    "greenhouse": Source(
        S.GREENHOUSE_DOC,
        lambda d: d["jobs"],
        ("id", "company_name", "title", "absolute_url", "location.name"),
        None,
        _greenhouse,
    ),
    "lever": Source(
        S.LEVER_DOC,
        lambda d: d,
        ("id", "text", "hostedUrl"),
        None,
        _lever,
    ),
    "ashby": Source(
        S.ASHBY_DOC,
        lambda d: d["jobs"],
        ("id", "title", "jobUrl"),
        _listed,
        _ashby,
    ),
    "remotive": Source(
        S.REMOTIVE_DOC,
        lambda d: d["jobs"],
        ("id", "title", "url"),
        None,
        _remotive,
    ),
    "adzuna": Source(
        S.ADZUNA_DOC,
        lambda d: d["results"],
        ("id", "title", "redirect_url"),
        None,
        _adzuna,
    ),
    "usajobs": Source(
        S.USAJOBS_DOC,
        lambda d: d["SearchResult"]["SearchResultItems"],
        ("MatchedObjectDescriptor.PositionID", "MatchedObjectDescriptor.PositionTitle"),
        None,
        _usajobs,
    ),
}


def documents(payloads: DataFrame, source: str, *, body: bool = False) -> DataFrame:
    """Documents of one source with their items; a failed document has NULL items and a ``reject``."""
    kind = BOARD_SOURCES[source]
    of_source = payloads.where(F.col("source") == source)
    return with_items(of_source, kind.ddl, kind.items_of, kind.row_ok, kind.fault, body=body)


def reject_table(payloads: DataFrame, *, body: bool = False) -> DataFrame:
    """Every document that cannot be used: reason, position of the first bad row, and its missing field.

    Search documents and boards fail as a whole. An unreadable detail (it has a ``path``) costs its own
    posting, one without a title the whole fetch of its search. With ``body`` the document itself is in
    the table, to be kept and read again once the source is mended.
    """
    of = [rejects(documents(payloads, source, body=body)) for source in BOARD_SOURCES]
    of.append(rejects(stub_documents(payloads, body=body)))
    of.append(rejects(detail_documents(payloads, body=body)))
    return reduce(DataFrame.unionByName, of)


def company_enrich(rows: DataFrame, boards: DataFrame | None) -> DataFrame:
    """Add ``company``: the registered name of (source, slug), else the slug itself."""
    if boards is None:
        return rows.withColumn("company", F.col("slug"))
    names = boards.select(
        F.col("source").alias("b_source"), F.col("slug").alias("b_slug"), "company"
    )
    joined = rows.join(
        names, (F.col("source") == F.col("b_source")) & (F.col("slug") == F.col("b_slug")), "left"
    )
    return joined.drop("b_source", "b_slug").withColumn(
        "company", F.coalesce("company", "slug")
    )


def sequence_key(source: Column) -> Column:
    """Order of the combined feed: source, then document, then place within it."""
    order = F.array_position(F.lit(list(V.SOURCES)), source)
    return F.struct(
        order.alias("source_order"),
        F.col("payload_id").alias("payload_id"),
        F.col("pos").alias("pos"),
    )


def extract(
    payloads: DataFrame,
    source: str,
    boards: DataFrame | None = None,
    max_results: int | None = None,
) -> DataFrame:
    """Postings of one source with their text still in ``body_parts``.

    Also ``seq``, ``payload_id``, ``slug``, ``query`` and ``job_id``.
    """
    kind = BOARD_SOURCES[source]
    read = documents(payloads, source)
    if max_results is not None:
        page_size = V.ADZUNA_PAGE_SIZE if source == "adzuna" else None
        rows = cap_per_query(read, max_results, page_size)
    else:
        rows = item_rows(read)
    if kind.keep is not None:
        rows = rows.where(kind.keep(F.col("item")))
    if source in ("lever", "ashby"):
        rows = company_enrich(rows, boards)
    else:
        rows = rows.withColumn("company", F.lit(None).cast("string"))
    values = kind.project(F.col("item"), F.col("company"))
    return rows.select(
        sequence_key(F.col("source")).alias("seq"),
        "payload_id",
        "slug",
        "query",
        job_id(F.col("source"), values["source_id"]).alias("job_id"),
        "source",
        *[value.alias(name) for name, value in values.items()],
        "fetched_at",
    )


def described(extracted: DataFrame) -> DataFrame:
    """Replace ``body_parts`` by ``description``: the one step that may need Python."""
    text = parts_to_text(F.col("body_parts"))
    return extracted.withColumn("description", text).drop("body_parts")


def normalise(
    payloads: DataFrame,
    source: str,
    boards: DataFrame | None = None,
    max_results: int | None = None,
) -> DataFrame:
    """Postings of one source."""
    return described(extract(payloads, source, boards, max_results))


def normalise_greenhouse(payloads: DataFrame) -> DataFrame:
    return normalise(payloads, "greenhouse")


def normalise_lever(payloads: DataFrame, boards: DataFrame | None = None) -> DataFrame:
    return normalise(payloads, "lever", boards)


def normalise_ashby(payloads: DataFrame, boards: DataFrame | None = None) -> DataFrame:
    return normalise(payloads, "ashby", boards)


def normalise_remotive(payloads: DataFrame) -> DataFrame:
    return normalise(payloads, "remotive")


def normalise_adzuna(payloads: DataFrame, max_results: int | None = None) -> DataFrame:
    return normalise(payloads, "adzuna", max_results=max_results)


def normalise_usajobs(payloads: DataFrame, max_results: int | None = None) -> DataFrame:
    return normalise(payloads, "usajobs", max_results=max_results)


def payload_status(payloads: DataFrame, source: str) -> DataFrame:
    """'ok' or 'failed' for every document of one source."""
    if source == "workday":
        return with_status(stub_documents(payloads))
    return with_status(documents(payloads, source))


def payload_validate(payloads: DataFrame) -> DataFrame:
    """Status of every document of every source."""
    return reduce(
        DataFrame.unionByName, [payload_status(payloads, source) for source in V.SOURCES]
    )


def source_status(status: DataFrame) -> DataFrame:
    """Status per source (a board, or one search) of its latest fetch: one failed document fails it."""
    of = ["source", "slug", "query"]
    failed = F.count_if(F.col("status") == "failed")
    fetches = status.groupBy(*of, "fetch_id").agg(
        F.struct(
            F.max("fetched_at").alias("fetched_at"),
            F.col("fetch_id").alias("fetch_id"),
            failed.alias("failed_documents"),
        ).alias("fetch")
    )
    return (
        fetches.groupBy(*of)
        .agg(F.max("fetch").alias("fetch"))
        .select(*of, "fetch.fetch_id", "fetch.failed_documents")
        .withColumn("status", F.when(F.col("failed_documents") > 0, "failed").otherwise("ok"))
    )


def source_failures(status: DataFrame) -> DataFrame:
    """One row: sources that landed something, and how many of them failed."""
    return source_status(status).agg(
        F.count(F.lit(1)).alias("source_count"),
        F.count_if(F.col("status") == "failed").alias("source_failures"),
    )


def normalise_workday(
    payloads: DataFrame,
    boards: DataFrame,
    max_results: int | None = None,
    keep: Column | None = None,
) -> DataFrame:
    return described(extract_workday(payloads, boards, max_results, keep))


# Caps of the registered searches.
REGISTRY_CAPS = {
    "adzuna": V.ADZUNA_QUERY_MAX_RESULTS,
    "workday": V.WORKDAY_QUERY_MAX_RESULTS,
    "usajobs": V.USAJOBS_QUERY_MAX_RESULTS,
}


def combine_sources(
    payloads: DataFrame,
    boards: DataFrame | None = None,
    workday_boards: DataFrame | None = None,
    caps: Mapping[str, int] | None = None,
    *,
    raw: bool = False,
    sources: Collection[str] = V.SOURCES,
) -> DataFrame:
    """Bag union of all sources, each in its own order; nothing is deduplicated here.

    ``caps`` bounds the results per query of a source; `REGISTRY_CAPS` are the registry's own.
    With ``raw`` the text stays in ``body_parts``, for a caller that describes few of the rows.
    ``sources`` names those to be read; folders of others are not opened.
    """
    if not sources or not set(sources) <= set(V.SOURCES):
        raise ValueError(f"sources are some of {', '.join(V.SOURCES)}")
    if workday_boards is None and set(sources) == {"workday"}:
        raise ValueError("workday needs its boards")
    caps = caps or {}
    feeds = [
        extract(payloads, source, boards, caps.get(source))
        for source in BOARD_SOURCES
        if source in sources
    ]
    if "workday" in sources and workday_boards is not None:
        feeds.append(extract_workday(payloads, workday_boards, caps.get("workday")))
    postings = reduce(DataFrame.unionByName, feeds)
    return postings if raw else described(postings)
