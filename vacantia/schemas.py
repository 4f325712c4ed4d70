"""Declared schemas. Nothing in the package infers one."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _B, _I, _L, _TS = (
    T.StringType(),
    T.BooleanType(),
    T.IntegerType(),
    T.LongType(),
    T.TimestampType(),
)

# A landed document. `query` and `page` are set for searched sources, `path` for detail documents.
PAYLOAD = T.StructType(
    [
        T.StructField("payload_id", _S, False),
        T.StructField("source", _S, False),
        T.StructField("slug", _S),
        T.StructField("query", _S),
        T.StructField("page", _I),
        T.StructField("path", _S),
        T.StructField("body", _S),
        T.StructField("fetched_at", _TS),
    ]
)

FACTS = T.StructType(
    [
        T.StructField("score", _I),
        T.StructField("reason", _S),
        T.StructField("skip_flags", T.ArrayType(_S)),
        T.StructField("workplace", _S),
        T.StructField("office_days_per_month", T.DoubleType()),
        T.StructField("years_required", T.DoubleType()),
        T.StructField("work_authorization", _S),
    ]
)
FACT_COLUMNS = tuple(FACTS.fieldNames())

# Replies as an injected scorer returns them, one per posting.
REPLY = T.StructType([T.StructField("job_id", _S, False), T.StructField("reply", _S)])

STORE = T.StructType(
    [
        T.StructField("job_id", _S, False),
        T.StructField("source", _S),
        T.StructField("source_id", _S),
        T.StructField("company", _S),
        T.StructField("title", _S),
        T.StructField("url", _S),
        T.StructField("remote", _B),
        T.StructField("status", _S),
        T.StructField("fetched_at", _S),
        T.StructField("location", _S),
        T.StructField("salary", _S),
        T.StructField("salary_is_estimated", _B),
        T.StructField("posted_at", _S),
        T.StructField("fit_score", _I),
        T.StructField("fit_reason", _S),
        T.StructField("location_tier", _I),
        T.StructField("skip_flags", T.ArrayType(_S)),
        T.StructField("skip_reason", _S),
    ]
)

COUNT_COLUMNS = (
    "fetched",
    "eligible",
    "new",
    "scored",
    "skipped",
    "digest",
    "source_failures",
    "deferred",
)

HEARTBEAT = T.StructType([T.StructField("ts", _TS), T.StructField("message", _S)])

# --- document shapes, as read by from_json ----------------------------------------

GREENHOUSE_DOC = """struct<jobs:array<struct<
    id:string, title:string, company_name:string, absolute_url:string,
    location:struct<name:string>, first_published:string, content:string,
    metadata:array<struct<name:string, value:string>>>>>"""

LEVER_DOC = """array<struct<
    id:string, text:string, hostedUrl:string,
    categories:struct<location:string, allLocations:array<string>>,
    workplaceType:string, createdAt:bigint, descriptionPlain:string,
    lists:array<struct<text:string, content:string>>, additionalPlain:string>>"""

ASHBY_DOC = """struct<jobs:array<struct<
    id:string, title:string, jobUrl:string, location:string,
    secondaryLocations:array<struct<location:string>>, workplaceType:string,
    isListed:boolean, publishedAt:string, descriptionPlain:string,
    compensation:struct<scrapeableCompensationSalarySummary:string>>>>"""

ADZUNA_DOC = """struct<results:array<struct<
    id:string, title:string, company:struct<display_name:string>,
    location:struct<display_name:string>, description:string, redirect_url:string,
    created:string, salary_min:double, salary_max:double, salary_is_predicted:variant>>>"""

REMOTIVE_DOC = """struct<jobs:array<struct<
    id:string, title:string, url:string, company_name:string,
    candidate_required_location:string, salary:string, description:string,
    publication_date:string>>>"""

USAJOBS_DOC = """struct<SearchResult:struct<SearchResultItems:array<struct<
    MatchedObjectDescriptor:struct<
        PositionID:string, PositionTitle:string, OrganizationName:string, PositionURI:string,
        PositionLocationDisplay:string,
        PositionRemuneration:array<struct<
            MinimumRange:string, MaximumRange:string, RateIntervalCode:string>>,
        PublicationStartDate:string,
        UserArea:struct<Details:struct<JobSummary:string, RemoteIndicator:boolean>>>>>>>"""

WORKDAY_SEARCH_DOC = """struct<jobPostings:array<struct<
    title:string, externalPath:string, locationsText:string, bulletFields:array<string>>>>"""

WORKDAY_DETAIL_DOC = """struct<jobPostingInfo:struct<
    id:string, jobReqId:string, jobPostingId:string, title:string, jobDescription:string,
    location:string, startDate:string, externalUrl:string, externalPath:string>>"""

CHAT_REPLY_DOC = "struct<choices:array<struct<message:struct<content:string>>>, error:variant>"
MESSAGES_REPLY_DOC = "struct<content:array<struct<type:string, text:string>>>"
