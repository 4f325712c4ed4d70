"""Posting-shaped views over the given tables, so that every operator runs on whole tables.

Only integer arithmetic on the tables' keys is used, so a second engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.functions.identity import job_id
from vacantia.functions.text import html_escape
from vacantia.session import use_utc

NOW = "2001-08-02 00:00:00"
SEEN_BEFORE = "1996-02-01 00:00:00"
MARKER = "posting run"

# --- fixed values: places of the derived postings, by index -------------------------
PLACES = (
    "Portland, OR", "Leeds, UK", "Naperville, DuPage County", "Remote (US)", "Bradenton, FL",
    "Calgary, BC", "Lima in Peru", "Jerome, Will County", "CA-Quebec-Laval",
    "US-WA-Spokane", "Rome, GA", "Clearwater, FL", "Elgin, IL", "Zurich", "Anywhere", "EMEA",
    "Several Places", None, "", "Remote (Mexico)", "St Petersburg, FL", "Boise, ID",
    "Oslo or Madrid", "Reno, NV (HQ), Remote (US)",
)

ORDER_STEP = 7919  # spreads the documents over all orders
BLOCK_ROWS = 20  # rows of a landed document
ADZUNA_ROWS = 130  # rows of a query; pages of 50, 30 and 50, or of 50, 50 and 30
WORKDAY_PAGES = 2
ADZUNA_PAGES = 3

PROFILE = {
    "headline": "Data engineer",
    "years_engineering": 3,
    "skills": {"have": ["Python", "SQL"], "building": ["Spark"]},
    "strengths": [],
    "domains": {"core": ["payments"], "secondary": ["sports"]},
    "skip_flags": {"years_required_above": 8},
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple, index: Column) -> Column:
    """Element of a literal list by a 0-based index column."""
    literal = F.array(*[F.lit(v).cast("string") for v in values])
    return F.get(literal, index.cast("int"))


def _div(a: Column, n: int) -> Column:
    return F.floor(a / n).cast("bigint")


def postings(
    spark: SparkSession, sf_dir: str, documents: DataFrame | None = None
) -> DataFrame:
    """One posting per document; a tenth of them repeat an id of the same source.

    ``documents`` may be a stream of that table.
    """
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents") if documents is None else documents
    docs = docs.select("doc_id", "text")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    n_orders = orders.agg(F.count(F.lit(1))).scalar()
    companies = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    roles = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    n_companies, n_roles = (t.agg(F.count(F.lit(1))).scalar() for t in (companies, roles))
    # One company has a third of all postings, and the others share the rest.
    company = F.when(d % 3 == 1, 0).otherwise(d % n_companies)
    # The keys are columns before they are join keys: a broadcast of the documents would evaluate a key
    # with a subquery in it while the subquery still runs.
    docs = docs.withColumns(
        {
            "company_key": company,
            "role_key": _div(d, 7) % n_roles,
            "order_key": (d * ORDER_STEP) % n_orders,
        }
    )
    joined = (
        docs.join(companies, F.col("s_suppkey") == F.col("company_key"))
        .join(roles, F.col("p_partkey") == F.col("role_key"))
        .join(orders, F.col("o_orderkey") == F.col("order_key"))
    )
    source = pick(V.SOURCES, d % 7)
    source_id = F.when(d % 10 == 9, d - 7).otherwise(d).cast("string")
    return joined.select(
        d.alias("seq"),
        source.alias("source"),
        source_id.alias("source_id"),
        F.when(d % 13 == 0, "").otherwise(F.col("s_name")).alias("company"),
        F.when(d % 5 == 0, F.upper(F.concat(F.lit("  "), "p_name")))
        .otherwise(F.col("p_name"))
        .alias("title"),
        F.concat(F.lit("https://jobs.example/"), source, F.lit("/"), d.cast("string")).alias("url"),
        pick(PLACES, (d * 7 + 3) % 24).alias("location"),
        ((d - d % 24) % 72 == 0).alias("remote"),
        F.when(d % 4 == 0, F.concat(F.lit("$"), (d % 90 + 60).cast("string"), F.lit("k"))).alias(
            "salary"
        ),
        (d % 8 == 0).alias("salary_is_estimated"),
        F.col("text").alias("description"),
        F.when(d % 11 != 0, F.col("o_orderdate").cast("timestamp")).alias("posted_at"),
        F.lit(NOW).cast("timestamp").alias("fetched_at"),
        job_id(source, source_id).alias("job_id"),
    )


def earlier(base: DataFrame) -> DataFrame:
    """Postings that earlier runs stored."""
    return base.where(F.col("posted_at") < F.lit(SEEN_BEFORE).cast("timestamp"))


def seen(base: DataFrame) -> DataFrame:
    """The store before the run, as ids."""
    return earlier(base).select("job_id").distinct()


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model reply per posting, with every kind of defect; a repeated id has its reply twice."""
    doc = F.col("doc_id")
    base = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(doc % 10 == 9, doc - 7).otherwise(doc).alias("sid")
    )
    d = F.col("sid")

    def text(c: Column) -> Column:
        return c.cast("string")

    score = (d * 37) % 101
    score_text = (
        F.when(d % 19 == 0, F.lit("150"))
        .when(d % 10 == 1, F.concat(F.lit('"'), text(score), F.lit('"')))
        .when(d % 10 == 3, F.concat(text(score), F.lit(".7")))
        .otherwise(text(score))
    )
    reason = (
        F.when(d % 7 == 0, "")
        .when(d % 31 == 0, '"reason": null, ')
        .otherwise(F.concat(F.lit('"reason": "r'), text(d), F.lit(' & <ok>", ')))
    )
    flags = F.when(d % 23 == 0, '["other", "azure_mandatory"]').otherwise("[]")
    days = F.when(_div(d, 48) % 3 == 0, "null").otherwise(text(d % 5))
    auth = F.when(d % 29 == 0, "foreign_required").otherwise("us_ok")
    body = F.concat(
        F.lit('{"score": '), score_text, F.lit(", "), reason,
        F.lit('"skip_flags": '), flags,
        F.lit(', "workplace": "'),
        pick(("remote", "hybrid", "onsite", "odd"), _div(d, 24) % 4),
        F.lit('", "office_days_per_month": '), days,
        F.lit(', "years_required": '), text(d % 12),
        F.lit(', "work_authorization": "'), auth, F.lit('"}'),
    )
    reply = (
        F.when(d % 17 == 0, "No JSON here.")
        .when(d % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(d % 3 == 1, F.concat(F.lit("Here it is:\n"), body, F.lit("\nDone.")))
        .otherwise(body)
    )
    return base.select(
        doc.alias("seq"),
        job_id(pick(V.SOURCES, d % 7), d.cast("string")).alias("job_id"),
        reply.alias("reply"),
    )


def mixed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replies, and for every fifth posting an unusable one of an earlier try."""
    usual = replies(spark, sf_dir).select("job_id", "reply")
    tried = usual.where(F.crc32(F.col("job_id").cast("binary")) % 5 == 0)
    return usual.unionByName(tried.withColumn("reply", F.lit("A first try, cut off: {")))


# --- landed documents ---------------------------------------------------------------


def _blocks(base: DataFrame) -> DataFrame:
    """Place of each posting in its source's documents: blk and row_no."""
    idx = _div(F.col("seq"), 7)
    group, within = _div(idx, ADZUNA_ROWS), idx % ADZUNA_ROWS
    third = F.when(group % 2 == 0, 80).otherwise(100)
    page = F.when(within < 50, 0).when(within < third, 1).otherwise(2)
    start = F.when(page == 0, 0).when(page == 1, 50).otherwise(third)
    paged = F.col("source") == "adzuna"
    return base.withColumns(
        {
            "blk": F.when(paged, group * ADZUNA_PAGES + page)
            .otherwise(_div(idx, BLOCK_ROWS))
            .cast("bigint"),
            "row_no": F.when(paged, within - start).otherwise(idx % BLOCK_ROWS).cast("bigint"),
        }
    )


def _markup(text: Column) -> Column:
    return F.concat(F.lit("<div><p>"), html_escape(text), F.lit("</p></div>"))


def _items(d: Column) -> dict[str, Column]:
    """The JSON-to-be of one posting, per source. A broken row lacks its title."""
    c = F.col
    broken = (c("blk") % 7 == 3) & (c("row_no") == 5)
    title = F.when(~broken, c("title")).alias("title")
    sid = c("source_id")
    iso = F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss")
    place = F.coalesce("location", F.lit(""))

    def cases(index: Column, *values: Column | str | None) -> Column:
        out = F
        for n, v in enumerate(values):
            out = out.when(index == n, v if isinstance(v, Column) else F.lit(v))
        return out

    no_text = F.lit(None).cast("string")
    low = 50000 + (d * 37) % 1000 + F.lit(0.5)
    pay = lambda lo, hi, code: F.array(
        F.struct(
            lo.cast("string").alias("MinimumRange"),
            hi.cast("string").alias("MaximumRange"),
            F.lit(code).alias("RateIntervalCode"),
        )
    )
    return {
        "greenhouse": F.struct(
            sid.cast("bigint").alias("id"),
            title,
            c("company").alias("company_name"),
            c("url").alias("absolute_url"),
            F.struct(place.alias("name")).alias("location"),
            F.concat(iso, F.lit("-04:00")).alias("first_published"),
            F.lit("2002-01-01T00:00:00Z").alias("updated_at"),
            F.when(
                d % 3 != 0,
                F.array(
                    F.struct(
                        F.lit("Location Type").alias("name"),
                        F.when(d % 5 == 0, "Remote").otherwise("On-Site").alias("value"),
                    )
                ),
            ).alias("metadata"),
            html_escape(_markup(c("description"))).alias("content"),
        ),
        "lever": F.struct(
            sid.alias("id"),
            title.alias("text"),
            c("url").alias("hostedUrl"),
            F.struct(
                c("location").alias("location"),
                cases(
                    d % 4,
                    F.array(place, F.lit("Boise, ID")),
                    F.array().cast("array<string>"),
                ).alias("allLocations"),
            ).alias("categories"),
            cases(d % 4, "remote", "hybrid", "Remote", None).alias("workplaceType"),
            F.unix_millis("posted_at").alias("createdAt"),
            c("description").alias("descriptionPlain"),
            F.when(
                d % 3 != 0,
                F.array(
                    F.struct(
                        F.lit("About").alias("text"),
                        F.concat(F.lit("<li>"), html_escape(c("title")), F.lit("</li>")).alias(
                            "content"
                        ),
                    ),
                    F.struct(F.lit("").alias("text"), F.lit("<b>x</b>&nbsp;y").alias("content")),
                ),
            ).alias("lists"),
            F.when(d % 2 == 0, "Bye").alias("additionalPlain"),
        ),
        "ashby": F.struct(
            sid.alias("id"),
            title,
            c("url").alias("jobUrl"),
            c("location").alias("location"),
            F.when(
                d % 3 == 0,
                F.array(
                    F.struct(F.lit("Remote (US)").alias("location")),
                    F.struct(F.lit("").alias("location")),
                ),
            ).alias("secondaryLocations"),
            cases(d % 5, "Remote", "hybrid", "REMOTE", "OnSite", None).alias("workplaceType"),
            F.lit(True).alias("isRemote"),
            F.when(d % 11 == 5, False).when(d % 11 != 6, True).alias("isListed"),
            F.concat(iso, F.lit(".123+00:00")).alias("publishedAt"),
            html_escape(html_escape(c("description"))).alias("descriptionPlain"),
            F.when(
                d % 4 < 2,
                F.struct(
                    F.when(d % 4 == 0, F.concat(F.lit("$"), (d % 200).cast("string"), F.lit("K")))
                    .otherwise("")
                    .alias("scrapeableCompensationSalarySummary")
                ),
            ).alias("compensation"),
        ),
        "remotive": F.struct(
            sid.cast("bigint").alias("id"),
            title,
            c("url").alias("url"),
            F.when(c("company") != "", c("company")).alias("company_name"),
            c("location").alias("candidate_required_location"),
            cases(d % 4, "$80k - $100k", "").alias("salary"),
            _markup(html_escape(c("description"))).alias("description"),
            iso.alias("publication_date"),
        ),
        "adzuna": F.struct(
            sid.alias("id"),
            title,
            F.when(c("company") != "", F.struct(c("company").alias("display_name"))).alias(
                "company"
            ),
            F.struct(c("location").alias("display_name")).alias("location"),
            _markup(html_escape(c("description"))).alias("description"),
            cases(
                d % 3,
                F.concat(
                    F.lit("https://www.adzuna.example/land/ad/"), d.cast("string"),
                    F.lit("?se=tok&utm_medium=api&utm_source=a"), (d % 7).cast("string"),
                    F.lit("&v=9&utm_x="),
                ),
                F.concat(F.lit("https://www.adzuna.example/details/"), d.cast("string"),
                         F.lit("?utm_medium=api&se=1")),
                F.concat(F.lit("https://example.com/"), d.cast("string")),
            ).alias("redirect_url"),
            F.concat(iso, F.lit("Z")).alias("created"),
            F.when(d % 5 > 1, low).alias("salary_min"),
            F.when(d % 5 == 2, low).when(d % 5 > 0, low + 1000.25).alias("salary_max"),
            F.parse_json(cases(d % 4, '"1"', "1", '"1"', '"0"')).alias("salary_is_predicted"),
        ),
        "usajobs": F.struct(
            F.struct(
                sid.alias("PositionID"),
                title.alias("PositionTitle"),
                F.when(c("company") != "", c("company")).alias("OrganizationName"),
                F.when(d % 3 != 0, c("url")).alias("PositionURI"),
                c("location").alias("PositionLocationDisplay"),
                cases(
                    d % 6,
                    F.lit(None).cast("array<struct<MinimumRange:string,MaximumRange:string,RateIntervalCode:string>>"),
                    F.slice(pay(no_text, no_text, "PA"), 1, 0),
                    pay(F.lit("50"), F.lit("50"), "PH"),
                    pay(d + 1000, d * 2 + 1000, "XX"),
                    pay(F.lit("abc"), F.lit("1"), "PA"),
                    pay(no_text, d * 10, "PA"),
                ).alias("PositionRemuneration"),
                F.concat(iso, F.lit(".0000")).alias("PublicationStartDate"),
                F.when(
                    d % 5 != 4,
                    F.struct(
                        F.struct(
                            _markup(html_escape(c("description"))).alias("JobSummary"),
                            F.when(d % 3 < 2, d % 3 == 0).alias("RemoteIndicator"),
                        ).alias("Details")
                    ),
                ).alias("UserArea"),
            ).alias("MatchedObjectDescriptor")
        ),
        "workday": F.struct(
            F.when(d % 9 != 4, c("title")).alias("title"),
            F.concat(F.lit("/job/"), d.cast("string")).alias("externalPath"),
            c("location").alias("locationsText"),
            F.when(d % 4 != 0, F.array(F.concat(F.lit("RQ"), d.cast("string")))).alias(
                "bulletFields"
            ),
        ),
    }


# What surrounds the listed items in a document.
_WRAP = {
    "greenhouse": ('{"jobs":', "}"),
    "lever": ("", ""),
    "ashby": ('{"apiVersion":"1","jobs":', "}"),
    "remotive": ('{"0-legal-notice":"x","jobs":', "}"),
    "adzuna": ('{"count":9,"results":', "}"),
    "usajobs": ('{"SearchResult":{"SearchResultItems":', "}}"),
    "workday": ('{"total":644,"jobPostings":', "}"),
}

LEVER_SLUGS = tuple(b[1] for b in V.BOARDS if b[0] == "lever")
ASHBY_SLUGS = tuple(b[1] for b in V.BOARDS if b[0] == "ashby")
GREENHOUSE_SLUGS = tuple(b[1] for b in V.BOARDS if b[0] == "greenhouse")
WORKDAY_TENANTS = tuple(b[0] for b in V.WORKDAY_BOARDS)


def _by_source(values: dict[str, Column]) -> Column:
    out = F
    for source, value in values.items():
        out = out.when(F.col("source") == source, value)
    return out if isinstance(out, Column) else F.lit(None)


def slug_of(blk: Column) -> Column:
    """Board or scope of a document; one board in each round is not registered."""

    def board(slugs: tuple[str, ...]) -> Column:
        return pick((*slugs, "unlisted"), blk % (len(slugs) + 1))

    return _by_source(
        {
            "greenhouse": board(GREENHOUSE_SLUGS),
            "lever": board(LEVER_SLUGS),
            "ashby": board(ASHBY_SLUGS),
            "remotive": F.lit("all"),
            "adzuna": pick(("Sarasota", "Chicago"), _div(blk, ADZUNA_PAGES) % 2),
            "workday": pick(WORKDAY_TENANTS, _div(blk, WORKDAY_PAGES) % 3),
            "usajobs": pick(("Chicago, Illinois", "Tampa, Florida", "remote"), blk % 3),
        }
    )


def query_of(blk: Column) -> Column:
    def numbered(n: Column) -> Column:
        return F.concat(F.lit("q"), n.cast("string"))

    return _by_source(
        {
            "remotive": pick(V.REMOTIVE_SEARCHES, blk % 5),
            "adzuna": numbered(_div(blk, ADZUNA_PAGES)),
            "workday": numbered(_div(blk, WORKDAY_PAGES)),
            "usajobs": numbered(blk),
        }
    )


def page_of(blk: Column) -> Column:
    paged = {"workday": blk % WORKDAY_PAGES, "adzuna": blk % ADZUNA_PAGES}
    return (F.coalesce(_by_source(paged), blk) + 1).cast("int")


def payloads(base: DataFrame, *sources: str) -> DataFrame:
    """Landed documents: at most 50 postings each, some broken, some of another shape."""
    wanted = sources or V.SOURCES
    rows = _blocks(base.where(F.col("source").isin(*wanted)))
    items = {s: F.to_json(item) for s, item in _items(F.col("seq")).items() if s in wanted}
    docs = (
        rows.select("source", "blk", "seq", _by_source(items).alias("j"))
        .groupBy("source", "blk")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "j"))).alias("js"))
    )
    blk = F.col("blk")
    listed = F.concat(
        _by_source({s: F.lit(_WRAP[s][0] + "[") for s in wanted}),
        F.array_join(F.transform("js", lambda x: x["j"]), ","),
        _by_source({s: F.lit("]" + _WRAP[s][1]) for s in wanted}),
    )
    out = docs.select(
        F.concat("source", F.lit("-"), blk.cast("string")).alias("payload_id"),
        "source",
        slug_of(blk).alias("slug"),
        query_of(blk).alias("query"),
        page_of(blk).alias("page"),
        F.lit(None).cast("string").alias("path"),
        F.when(blk % 7 == 5, '{"error": "rate limited"}').otherwise(listed).alias("body"),
        F.lit(NOW).cast("timestamp").alias("fetched_at"),
    )
    return out.unionByName(_details(base)) if "workday" in wanted else out


def _details(base: DataFrame) -> DataFrame:
    """A detail document per search hit; some cannot be read, some lack the title."""
    rows = _blocks(base.where(F.col("source") == "workday"))
    d, blk = F.col("seq"), F.col("blk")
    path = F.concat(F.lit("/job/"), d.cast("string"))
    untitled = (blk % 7 == 3) & (F.col("row_no") == 5)
    info = F.struct(
        F.struct(
            F.concat(F.lit("id"), F.col("source_id")).alias("id"),
            F.when(d % 3 == 0, F.concat(F.lit("RQ"), F.col("source_id")))
            .when(d % 3 == 1, "")
            .alias("jobReqId"),
            F.when(d % 2 == 0, F.concat(F.lit("P"), F.col("source_id"))).alias("jobPostingId"),
            F.when(~untitled, F.col("title")).alias("title"),
            _markup(F.col("description")).alias("jobDescription"),
            F.col("location").alias("location"),
            F.date_format("posted_at", "yyyy-MM-dd").alias("startDate"),
            F.when(d % 4 == 0, F.col("url")).when(d % 4 == 1, "").alias("externalUrl"),
            path.alias("externalPath"),
        ).alias("jobPostingInfo")
    )
    return rows.select(
        F.concat(F.lit("workday-d"), d.cast("string")).alias("payload_id"),
        F.lit("workday").alias("source"),
        slug_of(blk).alias("slug"),
        F.lit(None).cast("string").alias("query"),
        F.lit(None).cast("int").alias("page"),
        path.alias("path"),
        F.when(d % 8 == 2, "Service unavailable").otherwise(F.to_json(info)).alias("body"),
        F.lit(NOW).cast("timestamp").alias("fetched_at"),
    )


# --- run logs -----------------------------------------------------------------------


def heartbeats_of(events: DataFrame) -> DataFrame:
    """A log line per event; clicks are other log lines. Batch or stream."""
    health = (
        F.when(F.col("event_type") == "error", "error")
        .when(F.col("event_type") == "signup", "warn")
        .otherwise("ok")
    )
    whole = F.floor("value").cast("bigint")
    line = F.concat(
        F.lit(MARKER + " health="), health, F.lit(" (x) | scored="), whole.cast("string"),
        F.when(F.col("event_id") % 9 == 0, "").otherwise(
            F.concat(F.lit(" emailed="), _div(whole, 10).cast("string"))
        ),
        F.lit(" msg=-"),
    )
    other = F.concat(F.lit("HTTP request health=error id="), F.col("event_id").cast("string"))
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "click", other).otherwise(line).alias("message"),
        "event_id",
        "event_type",
    )


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heartbeats_of(table(spark, sf_dir, "events"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run counts per event, with every health case among them."""
    e = F.col("event_id")
    scored = F.when(e % 5 == 0, 0).otherwise(e % 40).cast("bigint")
    new = F.when(e % 15 == 0, e % 3).otherwise(e % 40 + e % 3).cast("bigint")
    return table(spark, sf_dir, "events").select(
        e.alias("event_id"),
        F.when(e % 8 == 0, 0).otherwise(e % 100 + 60).cast("bigint").alias("fetched"),
        F.when(e % 8 == 0, 0).otherwise(e % 100 + 50).cast("bigint").alias("eligible"),
        new.alias("new"),
        scored.alias("scored"),
        F.least(scored, F.lit(3)).alias("skipped"),
        F.least(scored, F.lit(10)).alias("digest"),
        F.when(e % 6 == 0, e % 5).otherwise(0).cast("bigint").alias("source_failures"),
        (e % 3).alias("deferred"),
        (e % 4 + 1).alias("source_count"),
        F.least(scored, F.lit(10)).alias("emailed"),
        F.when(e % 2 == 0, F.concat(F.lit("m-"), e.cast("string"))).alias("message_id"),
        pick(("big/Haiku-4", "x/sonnet", "other"), e % 3).alias("model"),
    )
