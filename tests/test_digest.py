import pytest
from pyspark.sql import functions as F

from vacantia.functions import rendering
from vacantia.operators import digest_mail

SCHEMA = (
    "seq long, job_id string, score int, title string, company string, url string, reason string, "
    "salary string, salary_is_estimated boolean, location string, location_tier int, status string, "
    "posted_at timestamp"
)


def row(seq, **over):
    base = {
        "job_id": f"j{seq}", "score": 92 - seq, "title": "Data Engineer", "company": "Acme",
        "url": "https://jobs.example.com/1", "reason": "Knows Spark.", "salary": None,
        "salary_is_estimated": False, "location": "Remote (US)", "location_tier": 1,
        "status": "ranked", "posted_at": None,
    } | over
    return (seq, *base.values())


@pytest.fixture(scope="module")
def mail(spark):
    def run(*rows, **knobs):
        return digest_mail.rendered(spark.createDataFrame(rows, SCHEMA), **knobs).collect()[0]

    return run


def test_html(mail):
    got = mail(
        row(1, title="<script>x</script>", company="<b>Acme</b>", reason="a & b <img>"),
        row(0, title="First", salary="$119,026", salary_is_estimated=True),
        row(2, title="Steal", url="javascript:alert(1)"),
        note="cost < $1",
        app="app",
    )
    html = got["html"]
    assert html.index("First") < html.index("&lt;script&gt;") < html.index("Steal")
    assert "<script>" not in html and "<b>Acme" not in html and "<img>" not in html
    assert 'href="https://jobs.example.com/1"' in html and "javascript:" not in html
    assert "$119,026 (estimated, not employer-stated)" in html and html.count("Salary") == 1
    assert "cost &lt; $1" in html and "#1a7f37" in html
    assert got["subject"] == "3 new job matches — app" and got["job_ids"] == ["j0", "j1", "j2"]


def test_text(mail):
    got = mail(row(0, salary="$1"), note="note", app="app")
    assert got["text"] == (
        "1 new job matches — ranked best-fit first.\n\n1. [92] Data Engineer — Acme\n   Remote (US)\n"
        "   Knows Spark.\n   Salary: Salary: $1\n   https://jobs.example.com/1\n\n"
        "You review and decide — app never applies for you.\n\nnote"
    )
    assert got["subject"] == "1 new job match — app"
    assert mail(row(0))["text"].endswith("never applies for you.")


def test_location_line(column):
    got = column(
        rendering.location_line,
        [
            ("Remote only (hires in FL); company in Tampa", 1), ("Tampa, FL", 3), ("Tampa, FL", 2),
            ("Austin, TX (HQ); visa", 6), ("(not stated)", 6), (None, 6), ("Chicago", 5),
            ("Tampa or Denver", 6), (None, 4),
        ],
        "l string, t int",
    )
    flag = " · Tampa/Sarasota area"
    assert got == [
        "Remote (US)" + flag, "Sarasota / Tampa · on-site", "Tampa Bay · hybrid", "Austin, TX", "US",
        "US", "Chicago", "Tampa or Denver" + flag, "Hybrid · rare travel",
    ]


def test_score_band(column):
    got = column(rendering.score_band, [100, 85, 84, 70, 69, 50, 49, 0], "s int")
    assert got == ["#1a7f37"] * 2 + ["#0b57d0"] * 2 + ["#b26a00"] * 2 + ["#6b6b6b"] * 2


def test_outbox_marks_only_what_was_delivered(spark):
    digest = spark.createDataFrame([row(0), row(1)], SCHEMA)
    outbox = digest_mail.digest_outbox(digest, "r1")
    assert digest_mail.digest_outbox(digest.where("false"), "r2").isEmpty()
    none = spark.createDataFrame([], "run_id string, message_id string")
    assert digest_mail.delivered_ids(outbox, none).isEmpty()
    sent = none.union(spark.createDataFrame([("r1", "m")], none.schema))
    assert {r["job_id"] for r in digest_mail.delivered_ids(outbox, sent).collect()} == {"j0", "j1"}
    assert outbox.select(F.col("n")).collect()[0]["n"] == 2
