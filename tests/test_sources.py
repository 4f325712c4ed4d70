import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from vacantia import fixed_values as V
from vacantia import schemas as S
from vacantia.checks import views as W
from vacantia.session import written
from vacantia.sources import fields, normalise, payloads, registry, workday

NOW = dt.datetime(2026, 7, 16, tzinfo=dt.UTC)


@pytest.fixture(scope="module")
def land(spark):
    def make(source, *bodies, **columns):
        rows = []
        for n, body in enumerate(bodies):
            body = body if isinstance(body, str) or body is None else json.dumps(body)
            row = {
                "payload_id": f"p{n}", "source": source, "slug": "acme", "query": None, "page": 1,
                "path": None, "body": body, "fetched_at": NOW,
            } | {k: v[n] for k, v in columns.items()}
            rows.append(tuple(row[c] for c in S.PAYLOAD.fieldNames()))
        return spark.createDataFrame(rows, S.PAYLOAD)

    return make


def rows(df):
    return [r.asDict() for r in df.orderBy("seq").collect()]


GREENHOUSE = {
    "id": 8101, "title": "Data Engineer", "company_name": "Acme",
    "absolute_url": "https://x/1", "location": {"name": "Perth"},
    "first_published": "2026-03-02T21:30:00-05:00", "updated_at": "2026-03-09T00:00:00Z",
    "content": "&lt;p&gt;Build&amp;nbsp;it&lt;/p&gt;",
    "metadata": [{"name": "Location Type", "value": "Remote"}, {"name": "Tags", "value": ["a", 1]}],
}
LEVER = {
    "id": "lev-1", "text": "DE", "hostedUrl": "https://x/2", "workplaceType": "hybrid",
    "categories": {"location": "Oslo", "allLocations": ["Oslo", "Vienna"]},
    "createdAt": 1772500000123, "descriptionPlain": "Intro.",
    "lists": [{"text": "You", "content": "<li>SQL &amp; more</li>"}, {"text": "", "content": ""}],
    "additionalPlain": "Bye. ",
}
ASHBY = {
    "id": "a1", "title": "DE", "jobUrl": "https://x/3", "location": "Reno, NV (HQ)",
    "secondaryLocations": [{"location": "Remote (US)"}, {"location": ""}], "isRemote": True,
    "workplaceType": "Hybrid", "isListed": True, "publishedAt": "2026-03-04T05:06:07.891+00:00",
    "descriptionPlain": "Text", "compensation": {"scrapeableCompensationSalarySummary": "$90K - $95K"},
}
ADZUNA = {
    "id": "9", "title": "DE (Remote)", "redirect_url": "https://www.adzuna.com/land/ad/9?se=Q&utm_medium=own&v=2",
    "location": {"display_name": "Naperville, DuPage County", "area": ["US"]}, "description": "d",
    "created": "2026-03-05T01:02:03Z", "salary_min": 70499.6, "salary_max": 70499.6,
    "salary_is_predicted": "1",
}
REMOTIVE = {
    "id": 7, "title": "DE", "url": "https://x/4", "company_name": "R", "salary": "",
    "candidate_required_location": "USA", "description": "<b>Hi</b>",
    "publication_date": "2026-03-06T07:08:09",
}
USAJOBS = {
    "MatchedObjectDescriptor": {
        "PositionID": "X-1", "PositionTitle": "IT", "PositionURI": "https://x/5",
        "OrganizationName": "Navy", "PositionLocationDisplay": "Largo, Florida",
        "PositionRemuneration": [
            {"MinimumRange": "51000", "MaximumRange": "62500.5", "RateIntervalCode": "PA"}
        ],
        "PublicationStartDate": "2026-02-03T00:00:00.0000",
        "UserArea": {"Details": {"JobSummary": "Serve", "RemoteIndicator": False}},
    }
}


def without(item, *names):
    return {k: v for k, v in item.items() if k not in names}


def test_greenhouse(land):
    bare = {**without(GREENHOUSE, "first_published", "content", "metadata"), "location": {"name": "NYC"}}
    got = rows(normalise.normalise_greenhouse(land("greenhouse", {"jobs": [GREENHOUSE, bare]})))
    assert got[0]["source_id"] == "8101"
    assert got[0]["remote"] and not got[1]["remote"]
    assert got[0]["description"] == "Build it" and got[1]["description"] == ""
    assert got[0]["posted_at"] == dt.datetime(2026, 3, 3, 2, 30) and got[1]["posted_at"] is None
    assert got[0]["salary"] is None and got[0]["company"] == "Acme"


def test_lever(land, spark):
    bare = without(LEVER, "categories", "lists", "createdAt", "workplaceType", "additionalPlain")
    docs = land("lever", [LEVER, {**bare, "workplaceType": "remote"}], slug=["finix"])
    got = rows(normalise.normalise_lever(docs, registry.boards(spark)))
    assert [r["company"] for r in got] == ["Finix", "Finix"]
    assert [r["location"] for r in got] == ["Oslo, Vienna", None]
    assert [r["remote"] for r in got] == [False, True]
    assert [r["description"] for r in got] == ["Intro. You SQL & more Bye.", "Intro."]
    assert got[1]["posted_at"] is None
    assert rows(normalise.normalise_lever(docs))[0]["company"] == "finix"


def test_ashby(land):
    unlisted = {"isListed": False}
    default = {**without(ASHBY, "isListed", "compensation", "location"), "workplaceType": "REMOTE"}
    got = rows(normalise.normalise_ashby(land("ashby", {"jobs": [ASHBY, unlisted, default]})))
    assert [r["location"] for r in got] == ["Reno, NV (HQ), Remote (US)", "Remote (US)"]
    assert [r["remote"] for r in got] == [False, True]
    assert [r["salary"] for r in got] == ["$90K - $95K", None]


def test_adzuna(land):
    other = {**ADZUNA, "id": "10", "title": "DE", "company": {"display_name": "C"}, "salary_max": 2e5}
    number = {**ADZUNA, "id": "11", "salary_is_predicted": 1, "salary_min": None}
    got = rows(normalise.normalise_adzuna(land("adzuna", {"count": 3, "results": [ADZUNA, other, number]})))
    assert got[0]["url"] == "https://www.adzuna.com/details/9?utm_medium=own"
    assert [r["company"] for r in got] == ["", "C", ""]
    assert [r["salary"] for r in got] == ["$70,500", "$70,500 - $200,000", "$70,500"]
    assert [r["salary_is_estimated"] for r in got] == [True, True, False]
    assert [r["remote"] for r in got] == [True, False, True]


def test_remotive_and_usajobs(land):
    got = rows(normalise.normalise_remotive(land("remotive", {"0-legal": "x", "jobs": [REMOTIVE]})))
    assert got[0]["remote"] and got[0]["salary"] is None and got[0]["description"] == "Hi"
    body = {"SearchResult": {"SearchResultItems": [USAJOBS]}}
    got = rows(normalise.normalise_usajobs(land("usajobs", body)))
    assert got[0]["salary"] == "$51,000 - $62,500/yr" and got[0]["company"] == "Navy"
    assert got[0]["posted_at"] == dt.datetime(2026, 2, 3)


GOOD = {
    "greenhouse": ({"jobs": [GREENHOUSE]}, ["id", "company_name", "title", "absolute_url", "location"]),
    "ashby": ({"jobs": [ASHBY]}, ["id", "title", "jobUrl"]),
    "adzuna": ({"results": [ADZUNA]}, ["id", "title", "redirect_url"]),
    "remotive": ({"jobs": [REMOTIVE]}, ["id", "title", "url"]),
}


@pytest.mark.parametrize("source", GOOD)
def test_bad_documents_fail_whole(land, source):
    good, required = GOOD[source]
    (key, [item]), *_ = good.items()
    text = json.dumps(good)
    bad = [{key: [item, without(item, name)]} for name in required]
    bad += ["Not Found", "", None, text + " tail", f"[{text}]", text + "," + text, text[:-9]]
    bad += [{"error": "x"}, {key: {"a": 1}}, {key: [None]}, {key: [1]}, "[]"]
    docs = land(source, good, {key: []}, *bad)
    status = {r["payload_id"]: r["status"] for r in normalise.payload_status(docs, source).collect()}
    assert [status[f"p{n}"] for n in range(len(bad) + 2)] == ["ok", "ok"] + ["failed"] * len(bad)
    assert {r["payload_id"] for r in rows(normalise.normalise(docs, source))} == {"p0"}


def test_lever_wants_a_list(land):
    docs = land("lever", [LEVER], {"ok": False}, LEVER, [LEVER, without(LEVER, "hostedUrl")], [])
    status = normalise.payload_status(docs, "lever").orderBy("payload_id")
    assert [r["status"] for r in status.collect()] == ["ok", "failed", "failed", "failed", "ok"]


def test_usajobs_shapes(land):
    item = USAJOBS["MatchedObjectDescriptor"]
    docs = land(
        "usajobs",
        {"SearchResult": {"SearchResultItems": []}},
        {"SearchResult": []},
        {"SearchResult": {}},
        {"SearchResult": {"SearchResultItems": [{"MatchedObjectDescriptor": without(item, "PositionID")}]}},
        {"SearchResult": {"SearchResultItems": [{}]}},
    )
    status = normalise.payload_status(docs, "usajobs").orderBy("payload_id")
    assert [r["status"] for r in status.collect()] == ["ok"] + ["failed"] * 4


def test_source_failures(land):
    # One board and two searches; a search with one bad page among good ones has failed.
    docs = land("lever", [LEVER], [LEVER]).unionByName(
        land("remotive", {"jobs": []}, {"jobs": []}, {"error": 1}, query=["a", "b", "b"])
    )
    row = normalise.source_failures(normalise.payload_validate(docs)).collect()[0]
    assert (row["source_count"], row["source_failures"]) == (3, 1)


def test_workday(land, spark):
    search = {
        "total": 31,
        "jobPostings": [
            {"title": "A", "externalPath": "/job/a", "locationsText": "Remote", "bulletFields": ["RQ1"]},
            {"bulletFields": ["R-77"]},
            {"title": "B", "externalPath": "/job/b"},
            {"title": "C", "externalPath": "/job/c", "locationsText": "Leeds, UK"},
        ],
    }
    info = {"id": "i", "title": "A", "location": "Remote, US", "startDate": "2026-03-07",
            "jobDescription": "<p>x</p>", "externalPath": "/job/a"}
    docs = land("workday", search, {"errorCode": 1}, slug=["gdit", "gdit"], query=["de", "ai"])
    stubs = workday.workday_stubs(docs).orderBy("pos").collect()
    assert [(s["title"], s["req_id"], s["location"]) for s in stubs] == [
        ("A", "RQ1", "Remote"), ("B", None, ""), ("C", None, "Leeds, UK"),
    ]
    status = normalise.payload_status(docs, "workday").orderBy("payload_id").collect()
    assert [s["status"] for s in status] == ["ok", "failed"]

    details = land(
        "workday", {"jobPostingInfo": {**info, "jobReqId": "RQ1"}}, "down", {"jobPostingInfo": {**info, "title": "C"}},
        slug=["gdit"] * 3, path=["/job/a", "/job/b", "/job/c"],
    )
    boards = registry.workday_boards(spark)
    got = rows(normalise.normalise_workday(docs.unionByName(details), boards))
    assert [r["source_id"] for r in got] == ["gdit:RQ1", "gdit:i"]
    assert got[0]["url"] == "https://gdit.wd5.myworkdayjobs.com/External_Career_Site/job/a"
    assert got[0]["company"] == "GDIT" and got[0]["remote"] and got[0]["description"] == "x"
    kept = normalise.normalise_workday(
        docs.unionByName(details), boards, keep=F.col("location") != "Leeds, UK"
    )
    assert [r["title"] for r in rows(kept)] == ["A"]
    # The same detail landed again completes its stub once.
    again = details.withColumn("payload_id", F.lit("again"))
    assert normalise.normalise_workday(docs.union(details).union(again), boards).count() == 2
    # A detail without a title fails the whole query.
    untitled = land("workday", {"jobPostingInfo": without(info, "title")}, slug=["gdit"], path=["/job/b"])
    all_docs = docs.unionByName(details.where("path <> '/job/b'")).unionByName(untitled)
    assert normalise.normalise_workday(all_docs, boards).count() == 0


def test_a_bad_page_behind_a_full_cap_is_not_reached(land):
    hits = [{"title": f"T{n}", "externalPath": f"/job/{n}"} for n in range(20)]
    for cap, left in ((10, 10), (20, 20), (21, 0)):
        docs = land("workday", {"jobPostings": hits}, "unreadable", slug=["s"] * 2, query=["q"] * 2, page=[1, 2])
        assert workday.workday_stubs(docs, max_results=cap).count() == left


def test_workday_site(column):
    robots = "User-agent: *\nsitemap: https://h.example/SITE/siteMap.xml\nSitemap: https://h/two/x\n"
    assert column(fields.workday_site, [robots, "Sitemap: none", ""]) == ["SITE", None, None]


def test_adzuna_url_reencodes(column):
    from urllib.parse import parse_qsl, urlencode

    query = "utm_a=x+y%20z&utm_b=%C3%A9*~&utm_c=&se=1&utm_d&utm_e=a=b"
    kept = urlencode([(k, v) for k, v in parse_qsl(query) if k.startswith("utm_")])
    urls = [
        f"HTTPS://www.Adzuna.com/land/ad/12/x?{query}#frag", "https://a/land/ad/7", "/land/ad/8?utm_q=1",
        "https://a/details/1?se=1", "https://a/x/land/ad/3",
    ]
    assert column(fields.adzuna_apply_url, urls) == [
        f"https://www.Adzuna.com/details/12?{kept}", "https://a/details/7", "/details/8?utm_q=1",
        urls[3], urls[4],
    ]


def test_usajobs_salary(column):
    pay = lambda lo, hi, code="PA": ([(lo, hi, code)],)
    got = column(
        fields.usajobs_salary,
        [
            pay("51000", "62500.5"), pay("50", "50", "PH"), pay(None, "10", "PD"), pay("9", ""),
            pay("", None), pay("abc", "1"), pay("1", "2", "ZZ"), ([],), (None,), pay("50d", "60"),
        ],
        "v array<struct<MinimumRange:string,MaximumRange:string,RateIntervalCode:string>>",
    )
    assert got == [
        "$51,000 - $62,500/yr", "$50/hr", "$10/day", "$9/yr", None, None, "$1 - $2", None, None, None,
    ]


def test_salary_rounds_half_to_even(column):
    amounts = [0.5, 1.5, 2.5, 70499.6, 1234567.5]
    assert column(fields.dollars, amounts, "v double") == [f"${a:,.0f}" for a in amounts]


def page(first, n):
    return {"results": [{**ADZUNA, "id": str(first + k)} for k in range(n)]}


@pytest.mark.parametrize(
    ("pages", "cap", "expected"),
    [
        ([page(0, 50), page(50, 50), page(100, 10)], 75, 75),
        ([page(0, 50), page(50, 10), page(100, 50)], 200, 60),
        ([page(0, 50), page(50, 50)], 25, 25),
        ([page(0, 50), {"error": 1}], 50, 50),  # the bad page is never asked for
        ([page(0, 50), {"error": 1}], 51, 0),
        ([page(0, 10), {"error": 1}], 200, 10),  # nor after a short page
        ([{"results": []}, page(0, 50)], 200, 0),
    ],
)
def test_cap_per_query(land, pages, cap, expected):
    docs = land("adzuna", *pages, page=list(range(1, len(pages) + 1)), query=["q"] * len(pages))
    got = rows(normalise.normalise_adzuna(docs, max_results=cap))
    assert [int(r["source_id"]) for r in got] == list(range(expected))


def test_capped_documents_are_parsed_once(land):
    """What is left to run reads the written sizes and items; no document is parsed for it."""
    docs = land("adzuna", page(0, 50), page(50, 10), page=[1, 2], query=["q"] * 2)
    capped = normalise.extract(docs, "adzuna", max_results=55)
    left = capped._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in left and "FileScan parquet" in left
    assert capped.count() == 55


@pytest.mark.parametrize("packed", [False, True])
def test_each_fetch_has_its_own_cap_status_and_time(land, spark, tmp_path, packed):
    later = NOW + dt.timedelta(days=1)
    asked = {"query": ["q"], "page": [1]}
    for n, (name, when) in enumerate([("01", NOW), ("1", later)]):
        docs = land("adzuna", page(25 * n, 25), payload_id=[name], fetched_at=[when], **asked)
        stubs = [{"title": "T", "externalPath": f"/{n}-{k}"} for k in range(3)]
        docs = docs.unionByName(
            land("workday", {"jobPostings": stubs}, payload_id=[f"w{n}"], fetched_at=[when], **asked)
        )
        search = {"SearchResult": {"SearchResultItems": [USAJOBS]}} if n else {"error": 1}
        docs = docs.unionByName(
            land("usajobs", search, payload_id=[f"u{n}"], fetched_at=[when], **asked)
        )
        payloads.land_payloads(
            docs.withColumn("fetch_id", F.lit(name)), str(tmp_path), packed=packed
        )
    scan = payloads.payload_scan(spark, str(tmp_path), None, packed=packed, fetches=not packed)
    got = normalise.normalise_adzuna(scan, max_results=25).collect()
    assert sorted(int(r["source_id"]) for r in got) == list(range(50))
    naive = [when.replace(tzinfo=None) for when in (NOW, later)]
    assert {(int(r["source_id"]) // 25, r["fetched_at"]) for r in got} == set(enumerate(naive))
    stubs = workday.workday_stubs(scan, 2).collect()
    assert sorted(r["external_path"] for r in stubs) == ["/0-0", "/0-1", "/1-0", "/1-1"]
    status = normalise.source_status(normalise.payload_validate(scan)).where("source = 'usajobs'")
    assert [(r["fetch_id"], r["status"]) for r in status.collect()] == [("1", "ok")]


def test_landed_files_round_trip(land, spark, tmp_path):
    docs = land("lever", [LEVER], slug=["fin/ix a"]).unionByName(
        land("workday", {"jobPostingInfo": {}}, path=["/job/a?x=1"])
    )
    payloads.land_payloads(docs, str(tmp_path))
    got = payloads.payload_scan(spark, str(tmp_path), NOW).orderBy("source").collect()
    assert [(r["source"], r["slug"], r["query"], r["page"], r["path"]) for r in got] == [
        ("lever", "fin/ix a", None, 1, None), ("workday", "acme", None, None, "/job/a?x=1"),
    ]
    assert json.loads(got[0]["body"]) == [LEVER]
    scan = payloads.payload_scan(spark, str(tmp_path), NOW)
    assert normalise.normalise_lever(scan).count() == 1


def test_packed_documents_round_trip(land, spark, tmp_path):
    docs = land("lever", [LEVER], "not json\n", slug=["a", "b"]).unionByName(
        land("workday", {"jobPostingInfo": {}}, path=["/job/a?x=1"])
    )
    payloads.land_payloads(docs, str(tmp_path), packed=True)
    scan = payloads.payload_scan(spark, str(tmp_path), NOW, packed=True)
    key = ["payload_id", "source", "slug", "query", "page", "path", "body", "fetched_at"]
    assert sorted(map(str, scan.select(key).collect())) == sorted(map(str, docs.select(key).collect()))


def test_registry(spark):
    by_source = {r["source"]: r["count"] for r in registry.all_sources(spark).groupBy("source").count().collect()}
    assert by_source == {
        "greenhouse": 42, "ashby": 53, "lever": 8, "remotive": 5, "adzuna": 8, "workday": 6, "usajobs": 6,
    }
    assert registry.registry_checks(registry.boards(spark)).isEmpty()
    broken = [("ashby", "a", "A"), ("ashby", "a", "B"), ("other", "b", "B"), ("lever", "c", " "), ("lever", "d", None)]
    assert registry.registry_checks(registry.boards(spark, broken)).count() == 4
    assert V.BOARDS[0] == ("ashby", "modelyst", "Modelyst")


@pytest.mark.parametrize(
    ("source", "body", "expected"),
    [
        ("adzuna", {"results": []}, None),
        ("adzuna", {"results": [{"id": "1", "title": "t", "redirect_url": "u"}]}, None),
        ("adzuna", {"error": 1}, ("items", None, None)),
        ("adzuna", "<html>", ("document", None, None)),
        ("adzuna", None, ("document", None, None)),
        ("adzuna", {"results": [{"id": "1", "title": "t", "redirect_url": "u"}, {"id": "2", "title": "t"}]},
         ("field", 1, "redirect_url")),
        ("adzuna", {"results": [None, {"id": "2"}]}, ("field", 0, "item")),
        ("lever", {"ok": False}, ("document", None, None)),
        ("lever", [{"id": "1", "hostedUrl": "u"}], ("field", 0, "text")),
        ("ashby", {"jobs": [{"isListed": False}, {"id": "1", "jobUrl": "u"}]}, ("field", 1, "title")),
        ("ashby", {"jobs": [{"isListed": False}]}, None),
        ("greenhouse", {"jobs": [{"id": 1, "company_name": "c", "title": "t", "absolute_url": "u"}]},
         ("field", 0, "location.name")),
        ("usajobs", {"SearchResult": {"SearchResultItems": [{"MatchedObjectDescriptor": {"PositionID": "1"}}]}},
         ("field", 0, "MatchedObjectDescriptor.PositionTitle")),
        ("workday", {"jobPostings": [None]}, ("field", 0, "item")),
        ("workday", {"total": 1}, ("items", None, None)),
    ],
)
def test_reject_reasons(spark, source, body, expected):
    text = body if body is None or isinstance(body, str) else json.dumps(body)
    row = ("p", source, "s", "q", 1, None, text, NOW, None)
    schema = (
        "payload_id string, source string, slug string, query string, page int, path string, "
        "body string, fetched_at timestamp, fetch_id string"
    )
    docs = spark.createDataFrame([row], schema)
    got = [(r.reason, r.position, r.field) for r in normalise.reject_table(docs).collect()]
    assert got == ([expected] if expected else [])
    # What is rejected is what has no rows and counts as failed.
    status = normalise.payload_validate(docs).first().status
    assert (status == "failed") == bool(expected)


def test_a_run_over_some_sources_opens_no_other_folder(spark, tmp_path):
    docs = written(W.payloads(W.postings(spark, SMALL)), str(tmp_path), partition_by="source")
    boards, sites = registry.boards(spark), registry.workday_boards(spark)
    some = normalise.combine_sources(docs, boards, sites, raw=True, sources=["lever", "workday"])
    every = normalise.combine_sources(docs, boards, sites, raw=True)
    keys = ("source", "job_id")
    wanted = every.where("source in ('lever', 'workday')").select(*keys).collect()
    assert sorted(some.select(*keys).collect()) == sorted(wanted) and wanted
    plan = some._jdf.queryExecution().executedPlan().toString()
    opened = re.findall(r"PartitionFilters: \[isnotnull\(source#\d+\), \(source#\d+ = (\w+)\)\]", plan)
    assert set(opened) == {"lever", "workday"} and len(opened) == plan.count("FileScan")
    for bad in ([], ["other"]):
        with pytest.raises(ValueError, match="some of"):
            normalise.combine_sources(docs, boards, sites, sources=bad)
    with pytest.raises(ValueError, match="its boards"):
        normalise.combine_sources(docs, boards, sources=["workday"])


def test_a_rejected_document_is_parsed_once(spark):
    schema = (
        "payload_id string, source string, slug string, query string, page int, path string, "
        "fetched_at timestamp, body string"
    )
    # A kind per source, and the details of the two-stage one.
    kinds = len(normalise.BOARD_SOURCES) + 2
    docs = spark.createDataFrame([("a", "lever", "s", None, 1, None, None, "[{}]")], schema)
    rejected = normalise.reject_table(docs.repartition(2))
    plan = rejected._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == kinds
    assert [(r.payload_id, r.reason, r.position) for r in rejected.collect()] == [("a", "field", 0)]
