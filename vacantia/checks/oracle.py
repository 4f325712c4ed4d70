"""The same results in ANSI SQL for a second engine, derived from the tables and not from Spark."""

from __future__ import annotations

from vacantia import fixed_values as V
from vacantia.checks import queries as Q
from vacantia.checks import views as W
from vacantia.operators.scoring import prompt_parts

# --- literals -----------------------------------------------------------------------


def _s(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, int | float):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_s(v) for v in values) + "]"


def _words(patterns) -> str:
    return r"\b(?:" + "|".join(patterns) + r")\b"


def _at(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S.%f')"


_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
_US = _s("(?i)" + "|".join([_words(V.US_STATE_CODES), *V.US_SCOPE_PATTERNS]))
_FOREIGN = _s("(?i)" + "|".join([_words(V.FOREIGN_REGIONS), *V.FOREIGN_CITY_PATTERNS]))
_METRO = _s("(?i)" + _words(V.TARGET_METRO_PATTERNS))
_BASE = _s("(?i)" + _words(V.CURRENT_BASE_PATTERNS))
_CANADA = _s("(?i)" + V.CANADA_PREFIX_PATTERN)


def _found(column: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({column}, {pattern}), false)"


def _collapse(column: str) -> str:
    return f"trim(regexp_replace({column}, '{_WS}', ' ', 'g'))"


def _strip(column: str) -> str:
    return f"regexp_replace({column}, '^{_WS}|{_WS}$', '', 'g')"


def _escape(column: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        column = f"replace({column}, {_s(char)}, {_s(entity)})"
    return column


# --- common views -------------------------------------------------------------------

_ELIGIBLE = f"""CASE WHEN location IS NULL OR location = '' THEN true
    WHEN {_found('location', _CANADA)} THEN false
    WHEN {_found('location', _US)} THEN true
    ELSE NOT {_found('location', _FOREIGN)} END"""

_HINT = f"(remote OR {_found('location', _s('(?i)' + V.REMOTE_WORD_PATTERN))})"

_TIER = f"""CASE WHEN {_HINT} THEN 1 WHEN {_found('location', _METRO)} THEN 3
    WHEN {_found('location', _BASE)} THEN 5 ELSE 6 END"""

_IS_REMOTE = f"""CASE WHEN workplace = 'remote' THEN true
    WHEN workplace IN ('hybrid', 'onsite') THEN false ELSE {_HINT} END"""

_FACT_TIER = f"""CASE WHEN {_IS_REMOTE} THEN 1
    WHEN {_found('location', _METRO)} THEN CASE WHEN workplace = 'hybrid' THEN 2 ELSE 3 END
    WHEN workplace = 'hybrid' AND office_days <= 2 THEN 4
    WHEN {_found('location', _BASE)} THEN 5 ELSE 6 END"""

_WALL = W.PROFILE["skip_flags"]["years_required_above"]
_SKIP = f"""CASE WHEN years >= {_WALL}
        THEN 'requires ' || years || '+ years (his wall is {_WALL})'
    WHEN authorization_need = 'foreign_required' THEN {_s(V.SKIP_AUTHORIZATION_TEXT)}
    WHEN azure THEN {_s(V.SKIP_FLAG_TEXTS['azure_mandatory'])} END"""

_POSTINGS = f"""postings AS (
  SELECT d.doc_id AS seq, {_list(V.SOURCES)}[d.doc_id % 7 + 1] AS source,
    CAST(CASE WHEN d.doc_id % 10 = 9 THEN d.doc_id - 7 ELSE d.doc_id END AS VARCHAR) AS source_id,
    CASE WHEN d.doc_id % 13 = 0 THEN '' ELSE s.s_name END AS company,
    CASE WHEN d.doc_id % 5 = 0 THEN upper('  ' || p.p_name) ELSE p.p_name END AS title,
    'https://jobs.example/' || {_list(V.SOURCES)}[d.doc_id % 7 + 1] || '/' || d.doc_id AS url,
    {_list(W.PLACES)}[(d.doc_id * 7 + 3) % 24 + 1] AS location,
    (d.doc_id - d.doc_id % 24) % 72 = 0 AS remote,
    CASE WHEN d.doc_id % 4 = 0 THEN '$' || (d.doc_id % 90 + 60) || 'k' END AS salary,
    d.doc_id % 8 = 0 AS salary_is_estimated,
    d.text AS description,
    CASE WHEN d.doc_id % 11 <> 0 THEN o.o_orderdate END AS posted_at
  FROM documents d
  JOIN supplier s ON s.s_suppkey = CASE WHEN d.doc_id % 3 = 1 THEN 0
    ELSE d.doc_id % (SELECT count(*) FROM supplier) END
  JOIN part p ON p.p_partkey = (d.doc_id // 7) % (SELECT count(*) FROM part)
  JOIN orders o ON o.o_orderkey = (d.doc_id * {W.ORDER_STEP}) % (SELECT count(*) FROM orders)),
 base AS (SELECT *, sha256(source || chr(0) || source_id) AS job_id, {_ELIGIBLE} AS eligible,
    {_TIER} AS tier0 FROM postings)"""

# Store of earlier runs, and the first row of each id among the eligible ones.
_GATE = f"""{_POSTINGS},
 seen AS (SELECT DISTINCT job_id FROM base WHERE posted_at < TIMESTAMP {_s(W.SEEN_BEFORE)}),
 uniq AS (SELECT * FROM base WHERE eligible
    QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq) = 1),
 fresh AS (SELECT * FROM uniq WHERE job_id NOT IN (SELECT job_id FROM seen)),
 chosen AS (SELECT * FROM fresh WHERE tier0 <> 6
    AND (posted_at IS NULL OR posted_at >= TIMESTAMP {_s(W.NOW)} - INTERVAL {Q.MAX_AGE_DAYS} DAY)
    ORDER BY coalesce(posted_at, TIMESTAMP '1970-01-01') DESC, seq LIMIT {Q.MAX_SCORE})"""

_FACTS = """facts AS (
  SELECT doc_id AS seq, sid, (sid * 37) % 101 AS score, sid % 17 <> 0 AND sid % 19 <> 0 AS parsed,
    CASE WHEN sid % 7 = 0 THEN '' WHEN sid % 31 = 0 THEN 'None'
      ELSE 'r' || sid || ' & <ok>' END AS reason,
    sid % 23 = 0 AS azure, ['remote', 'hybrid', 'onsite', 'odd'][(sid // 24) % 4 + 1] AS workplace,
    CASE WHEN (sid // 48) % 3 <> 0 THEN sid % 5 END AS office_days, sid % 12 AS years,
    CASE WHEN sid % 29 = 0 THEN 'foreign_required' ELSE 'us_ok' END AS authorization_need
  FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN doc_id - 7 ELSE doc_id END AS sid
        FROM documents))"""


def _ranked(source: str, name: str = "ranked") -> str:
    """Scored and ranked rows of one of the gate's views."""
    return f"""{name}_0 AS (SELECT b.*, f.score, f.reason, f.azure, f.workplace, f.office_days,
      f.years, f.authorization_need
    FROM {source} b JOIN facts f ON f.seq = b.seq AND f.parsed),
  {name} AS (SELECT *, {_FACT_TIER} AS tier, {_SKIP} AS skip_reason,
      CASE WHEN {_SKIP} IS NULL THEN 'ranked' ELSE 'skipped' END AS status FROM {name}_0)"""


_ORDER = """(status <> 'ranked'), (tier = 6), score DESC, tier,
    coalesce(posted_at, TIMESTAMP '1970-01-01') DESC, seq"""
_COMPANY = "lower(trim(company))"
_TITLE = f"lower({_collapse('title')})"


def _digest(ranked: str, prefix: str = "") -> str:
    """The digest of a ranked view, as view `<prefix>digest` with its rank."""
    return f"""{prefix}strong AS (SELECT * FROM {ranked}
      WHERE status = 'ranked' AND score >= {V.MIN_SCORE} AND tier <> 6),
  {prefix}roles AS (SELECT * FROM {prefix}strong WHERE {_COMPANY} = '' UNION ALL
    SELECT * FROM (SELECT * FROM {prefix}strong WHERE {_COMPANY} <> ''
      QUALIFY row_number() OVER (PARTITION BY {_COMPANY}, {_TITLE} ORDER BY {_ORDER}) = 1)),
  {prefix}capped AS (SELECT * FROM {prefix}roles WHERE {_COMPANY} = '' UNION ALL
    SELECT * FROM (SELECT * FROM {prefix}roles WHERE {_COMPANY} <> ''
      QUALIFY row_number() OVER (PARTITION BY {_COMPANY} ORDER BY {_ORDER}) <= {V.PER_COMPANY})),
  {prefix}digest AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM {prefix}capped
    QUALIFY rank <= {V.DIGEST_LIMIT})"""


_ALL_RANKED = f"WITH {_GATE}, {_FACTS}, {_ranked('uniq')}"
_SENT = (
    f"WITH {_GATE}, workable AS (SELECT * FROM fresh WHERE tier0 <> 6), {_FACTS}, "
    f"{_ranked('workable')}, {_digest('ranked')}"
)

# --- landed documents ---------------------------------------------------------------

_WIN = "(seq // 7) % 130"
_GRP = "((seq // 7) // 130)"
_THIRD = f"CASE WHEN {_GRP} % 2 = 0 THEN 80 ELSE 100 END"
_PAGE = f"CASE WHEN {_WIN} < 50 THEN 0 WHEN {_WIN} < {_THIRD} THEN 1 ELSE 2 END"
_START = f"CASE WHEN {_WIN} < 50 THEN 0 WHEN {_WIN} < {_THIRD} THEN 50 ELSE {_THIRD} END"


def _slug(source: str) -> str:
    slugs = [b[1] for b in V.BOARDS if b[0] == source]
    return f"{_list([*slugs, 'unlisted'])}[blk % {len(slugs) + 1} + 1]"


def _board(source: str) -> str:
    names = [b[2] for b in V.BOARDS if b[0] == source]
    return f"{_list([*names, 'unlisted'])}[blk % {len(names) + 1} + 1]"


_SLUG = f"""CASE source WHEN 'greenhouse' THEN {_slug('greenhouse')}
    WHEN 'lever' THEN {_slug('lever')} WHEN 'ashby' THEN {_slug('ashby')}
    WHEN 'workday' THEN {_list(W.WORKDAY_TENANTS)}[(blk // 2) % 3 + 1]
    WHEN 'remotive' THEN 'all'
    WHEN 'adzuna' THEN ['Sarasota', 'Chicago'][(blk // 3) % 2 + 1]
    ELSE ['Chicago, Illinois', 'Tampa, Florida', 'remote'][blk % 3 + 1] END"""
_QUERY = f"""CASE source WHEN 'workday' THEN 'q' || (blk // 2)
    WHEN 'remotive' THEN {_list(V.REMOTIVE_SEARCHES)}[blk % 5 + 1]
    WHEN 'adzuna' THEN 'q' || (blk // 3) WHEN 'usajobs' THEN 'q' || blk END"""
_PAGE_NO = """CASE source WHEN 'workday' THEN blk % 2 + 1 WHEN 'adzuna' THEN blk % 3 + 1
    ELSE blk + 1 END"""

# A document fails when it is an error object, or when a row that is read lacks its title.
_LANDED = f"""{_POSTINGS},
 placed AS (SELECT *,
    CASE WHEN source = 'adzuna' THEN {_GRP} * 3 + {_PAGE} ELSE (seq // 7) // 20 END AS blk,
    CASE WHEN source = 'adzuna' THEN {_WIN} - {_START} ELSE (seq // 7) % 20 END AS row_no
  FROM base),
 landed AS (SELECT *, source || '-' || blk AS payload_id, {_SLUG} AS slug, {_QUERY} AS query,
    {_PAGE_NO} AS page,
    row_number() OVER (PARTITION BY source, blk ORDER BY seq) - 1 AS pos,
    blk % 7 <> 5 AND NOT (source <> 'workday' AND blk % 7 = 3 AND
      bool_or(row_no = 5 AND NOT (source = 'ashby' AND seq % 11 = 5))
        OVER (PARTITION BY source, blk)) AS ok
  FROM placed)"""

_PLAIN = _collapse("description")
_NO = "CAST(NULL AS VARCHAR)"
_SALARY_LOW = "CASE WHEN seq % 5 > 1 THEN 50000.5 + (seq * 37) % 1000 END"
_SALARY_HIGH = (
    "CASE WHEN seq % 5 = 2 THEN 50000.5 + (seq * 37) % 1000 "
    "WHEN seq % 5 > 0 THEN 51000.75 + (seq * 37) % 1000 END"
)


def _usd(value: str) -> str:
    return f"'$' || format('{{:,.0f}}', ({value})::DOUBLE)"


def _usd_range(low: str, high: str, unit: str = "''") -> str:
    return (
        f"CASE WHEN {low} = {high} THEN {_usd(low)} || {unit} "
        f"ELSE {_usd(low)} || ' - ' || {_usd(high)} || {unit} END"
    )


_LOW2, _HIGH2 = f"coalesce({_SALARY_LOW}, {_SALARY_HIGH})", f"coalesce({_SALARY_HIGH}, {_SALARY_LOW})"

# Expected fields per source, from the postings themselves.
_EXPECT = {
    "greenhouse": {
        "company": "company",
        "location": "coalesce(location, '')",
        "remote": "(seq % 3 <> 0 AND seq % 5 = 0) OR contains(lower(coalesce(location, '')), 'remote')",
        "salary": _NO,
        "estimated": "false",
        "description": _PLAIN,
        "posted": "posted_at + INTERVAL 4 HOUR",
        "where": "true",
    },
    "lever": {
        "company": _board("lever"),
        "location": "CASE WHEN seq % 4 = 0 THEN coalesce(location, '') || ', Boise, ID' ELSE location END",
        "remote": "seq % 4 = 0",
        "salary": _NO,
        "estimated": "false",
        "description": _strip(
            "array_to_string(list_filter([description, "
            "CASE WHEN seq % 3 <> 0 THEN 'About' ELSE '' END, "
            f"CASE WHEN seq % 3 <> 0 THEN {_collapse('title')} ELSE '' END, "
            "CASE WHEN seq % 3 <> 0 THEN 'x y' ELSE '' END, "
            "CASE WHEN seq % 2 = 0 THEN 'Bye' ELSE '' END], lambda x: x <> ''), ' ')"
        ),
        "posted": "posted_at",
        "where": "true",
    },
    "ashby": {
        "company": _board("ashby"),
        "location": "nullif(array_to_string(list_filter([location, CASE WHEN seq % 3 = 0 "
        "THEN 'Remote (US)' END], lambda x: x IS NOT NULL AND x <> ''), ', '), '')",
        "remote": "seq % 5 IN (0, 2)",
        "salary": "CASE WHEN seq % 4 = 0 THEN '$' || (seq % 200) || 'K' END",
        "estimated": "false",
        "description": _PLAIN,
        "posted": "posted_at + INTERVAL 123 MILLISECOND",
        "where": "seq % 11 <> 5",
    },
    "remotive": {
        "company": "company",
        "location": "nullif(location, '')",
        "remote": "true",
        "salary": "CASE WHEN seq % 4 = 0 THEN '$80k - $100k' END",
        "estimated": "false",
        "description": _PLAIN,
        "posted": "posted_at",
        "where": "true",
    },
    "adzuna": {
        "company": "company",
        "location": "location",
        "remote": "contains(lower(concat_ws(' ', title, location, description)), 'remote')",
        "salary": _usd_range(_LOW2, _HIGH2),
        "estimated": "seq % 5 <> 0 AND seq % 4 IN (0, 2)",
        "description": _PLAIN,
        "posted": "posted_at",
        "where": "true",
        "url": "CASE seq % 3 WHEN 0 THEN 'https://www.adzuna.example/details/' || seq || "
        "'?utm_medium=api&utm_source=a' || (seq % 7) "
        "WHEN 1 THEN 'https://www.adzuna.example/details/' || seq || '?utm_medium=api&se=1' "
        "ELSE 'https://example.com/' || seq END",
    },
    "usajobs": {
        "company": "company",
        "location": "nullif(location, '')",
        "remote": "seq % 5 <> 4 AND seq % 3 = 0",
        "salary": "CASE seq % 6 WHEN 2 THEN '$50/hr' "
        f"WHEN 3 THEN {_usd_range('(seq + 1000)', '(seq * 2 + 1000)')} "
        f"WHEN 5 THEN {_usd('seq * 10')} || '/yr' END",
        "estimated": "false",
        "description": f"CASE WHEN seq % 5 <> 4 THEN {_PLAIN} ELSE '' END",
        "posted": "posted_at",
        "where": "true",
        "url": "CASE WHEN seq % 3 <> 0 THEN url ELSE '' END",
    },
}


def _rows(source: str) -> str:
    return f"FROM landed WHERE source = '{source}' AND ok AND {_EXPECT[source]['where']}"


def _normalised(source: str) -> str:
    e = _EXPECT[source]
    return f"""WITH {_LANDED}
SELECT payload_id, pos, job_id, source_id, {e['company']} AS company, title,
  {e.get('url', 'url')} AS url, {e['location']} AS location, {e['remote']} AS remote,
  {e['salary']} AS salary, {e['estimated']} AS salary_is_estimated,
  sha256({e['description']}) AS description_sha, length({e['description']}) AS description_chars,
  {_at(e['posted'])} AS posted_at, {_at(f"TIMESTAMP '{W.NOW}'")} AS fetched_at
{_rows(source)}"""


def _field(source: str, **columns: str) -> str:
    e = _EXPECT[source]
    out = ", ".join(f"{e.get(expr, expr)} AS {name}" for name, expr in columns.items())
    return f"WITH {_LANDED} SELECT payload_id, pos, {out} {_rows(source)}"


_STUBS = f"""{_LANDED},
 stubs AS (SELECT *, row_number() OVER (PARTITION BY blk ORDER BY seq) - 1 AS stub_pos
   FROM landed WHERE source = 'workday' AND ok AND seq % 9 <> 4)"""

_REQ = """CASE WHEN seq % 3 = 0 THEN 'RQ' || source_id WHEN seq % 2 = 0 THEN 'P' || source_id
    ELSE 'id' || source_id END"""
_WORKDAY_ID = f"slug || ':' || {_REQ}"
_SITE = {b[0]: f"https://{b[2]}/{b[1]}" for b in V.WORKDAY_BOARDS}
_WORKDAY_URL = f"""CASE WHEN seq % 4 = 0 THEN url ELSE
    {_list(_SITE.values())}[(blk // 2) % 3 + 1] || '/job/' || seq END"""
_DETAIL = "seq % 8 <> 2"
_WORKDAY_NAME = f"{_list([b[3] for b in V.WORKDAY_BOARDS])}[(blk // 2) % 3 + 1]"


def _workday_rows(keep: str) -> str:
    return f"""{_STUBS},
 wanted AS (SELECT * FROM stubs WHERE {keep}),
 bad AS (SELECT DISTINCT query FROM wanted WHERE {_DETAIL} AND blk % 7 = 3 AND row_no = 5),
 hydrated AS (SELECT *, {_WORKDAY_ID} AS wd_id FROM wanted
   WHERE {_DETAIL} AND query NOT IN (SELECT query FROM bad))"""


_KEEP_STUB = _ELIGIBLE
_ITEMS = """CASE WHEN NOT ok THEN 0 WHEN source = 'workday'
    THEN count(*) FILTER (WHERE seq % 9 <> 4) ELSE count(*) END"""
_STATUS = f"""docs AS (SELECT payload_id, source, slug, query, page, blk,
    CASE WHEN ok THEN 'ok' ELSE 'failed' END AS status, {_ITEMS} AS n_items
  FROM landed GROUP BY payload_id, source, slug, query, page, blk, ok)"""


def _values(rows, names: str) -> str:
    body = ", ".join("(" + ", ".join(_s(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS t({names})"


def _registry_rows() -> list[tuple]:
    from vacantia.sources.registry import _queries

    return [(*b[:2], None) for b in V.BOARDS] + [q[:3] for q in _queries()]


# --- store --------------------------------------------------------------------------


def _iso(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S') || '+00:00'"


def _item(**over: str) -> str:
    columns = {
        "job_id": "job_id", "source": "source", "source_id": "source_id", "company": "company",
        "title": "title", "url": "url", "remote": "remote", "status": "'new'",
        "fetched_at": _iso(f"TIMESTAMP '{W.NOW}'"), "location": "nullif(location, '')",
        "salary": "salary",
        "salary_is_estimated": "CASE WHEN salary IS NOT NULL THEN salary_is_estimated END",
        "posted_at": _iso("posted_at"), "fit_score": "CAST(NULL AS BIGINT)", "fit_reason": _NO,
        "location_tier": "CAST(NULL AS BIGINT)", "skip_flags": _NO, "skip_reason": _NO,
    } | over
    return ", ".join(f"{expr} AS {name}" for name, expr in columns.items())


_SCORED_ITEM = _item(
    status="CASE status WHEN 'ranked' THEN 'new' ELSE 'skipped' END",
    fit_score="score",
    fit_reason="reason",
    location_tier="tier",
    skip_flags="CASE WHEN azure THEN 'other|azure_mandatory' END",
    skip_reason="skip_reason",
)


def _last(where: str) -> str:
    return f"""SELECT * FROM base WHERE {where}
      QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) = 1"""


_EARLIER = f"posted_at < TIMESTAMP {_s(W.SEEN_BEFORE)}"

# --- logs ---------------------------------------------------------------------------

_LINES = f"""lines AS (SELECT event_id, ts, event_type,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'ok' END AS health,
    CAST(floor(value) AS BIGINT) AS scored,
    CASE WHEN event_id % 9 = 0 THEN 0 ELSE CAST(floor(value) AS BIGINT) // 10 END AS emailed,
    event_type <> 'click' AS heartbeat FROM events)"""

_LAST_DAY = f"""{_LINES},
 recent AS (SELECT *, CASE WHEN event_type = 'click' THEN '' ELSE '{W.MARKER} health=' || health
      || ' (x) | scored=' || scored || CASE WHEN event_id % 9 = 0 THEN '' ELSE ' emailed='
      || (scored // 10) END || ' msg=-' END AS message
   FROM lines WHERE heartbeat AND ts >= (SELECT max(ts) FROM lines) - INTERVAL 86400 SECOND)"""

_SUMS = f"""count(*) AS runs, CAST(coalesce(sum(scored), 0) AS BIGINT) AS scored,
  CAST(coalesce(sum(emailed), 0) AS BIGINT) AS emailed,
  count(*) FILTER (WHERE health = 'error') AS errors,
  count(*) FILTER (WHERE health = 'warn') AS warns,
  CAST(coalesce(sum(scored), 0) AS DOUBLE) * {Q.RATE}::DOUBLE AS cost,
  count(*) FILTER (WHERE health = 'error') = 0 AS healthy"""


def _bucket(seconds: int, column: str = "ts") -> str:
    return f"time_bucket(INTERVAL {seconds} SECOND, {column}, TIMESTAMP '1970-01-01')"


def _periods(seconds: int, source: str, name: str, value: str) -> str:
    return f"""SELECT {_at('p')} AS period_start, {_at(f'p + INTERVAL {seconds} SECOND')} AS period_end,
  n AS {name}, n >= 1 AS alarm
FROM (SELECT {_bucket(seconds)} AS p, {value} AS n FROM {source} GROUP BY 1)"""


_RUNS = """runs AS (SELECT event_id,
    CASE WHEN event_id % 8 = 0 THEN 0 ELSE event_id % 100 + 60 END AS fetched,
    CASE WHEN event_id % 8 = 0 THEN 0 ELSE event_id % 100 + 50 END AS eligible,
    CASE WHEN event_id % 15 = 0 THEN event_id % 3 ELSE event_id % 40 + event_id % 3 END AS new,
    CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 40 END AS scored,
    CASE WHEN event_id % 6 = 0 THEN event_id % 5 ELSE 0 END AS source_failures,
    event_id % 3 AS deferred, event_id % 4 + 1 AS source_count,
    CASE WHEN event_id % 2 = 0 THEN 'm-' || event_id END AS message_id,
    ['big/Haiku-4', 'x/sonnet', 'other'][event_id % 3 + 1] AS model
  FROM events),
 judged AS (SELECT *, new - deferred AS attempted, least(scored, 3) AS skipped,
    least(scored, 10) AS digest, least(scored, 10) AS emailed,
    CASE WHEN source_count > 0 AND source_failures >= source_count THEN 1
      WHEN new - deferred > 0 AND scored = 0 THEN 2 WHEN source_failures > 0 THEN 3
      WHEN fetched = 0 THEN 4 ELSE 5 END AS verdict FROM runs),
 assessed AS (SELECT *, ['error', 'error', 'warn', 'warn', 'ok'][verdict] AS health,
    CASE verdict WHEN 1 THEN 'all sources failed — fetched nothing'
      WHEN 2 THEN 'scored 0 of ' || attempted || ' — scorer down (API/credit?)'
      WHEN 3 THEN source_failures || '/' || source_count || ' sources failed'
      WHEN 4 THEN '0 jobs fetched with no failures — boards empty/changed?'
      ELSE 'healthy' END AS headline FROM judged)"""

# --- rendering ----------------------------------------------------------------------

_APP = "vacantia"


def _cleaned(column: str) -> str:
    no_parens = f"regexp_replace({column}, '\\([^)]*\\)', '', 'g')"
    head = f"split_part(split_part({no_parens}, ';', 1), ' — ', 1)"
    return f"trim(trim(trim({head}), ','))"


_LABEL = f"{_list(V.TIER_LABELS.values())}[tier]"
_LINE = f"""(CASE WHEN tier = 6 THEN coalesce(nullif({_cleaned("coalesce(location, '')")}, ''), {_LABEL})
    ELSE {_LABEL} END || CASE WHEN tier NOT IN (2, 3) AND {_found('location', _METRO)}
    THEN '{V.METRO_FLAG}' ELSE '' END)"""
_COLOUR = """CASE WHEN score >= 85 THEN '#1a7f37' WHEN score >= 70 THEN '#0b57d0'
    WHEN score >= 50 THEN '#b26a00' WHEN score >= 0 THEN '#6b6b6b' END"""
_SALARY_TEXT = """('Salary: ' || salary || CASE WHEN salary_is_estimated
    THEN ' (estimated, not employer-stated)' ELSE '' END)"""

_DIGEST_TEXT = f"""WITH_SENT SELECT count(*) || ' new job matches — ranked best-fit first.' || chr(10) || chr(10)
  || string_agg(rank || '. [' || score || '] ' || title || ' — ' || company || chr(10)
    || '   ' || {_LINE} || chr(10) || '   ' || reason || chr(10)
    || CASE WHEN salary IS NULL THEN '' ELSE '   Salary: ' || {_SALARY_TEXT} || chr(10) END
    || '   ' || url || chr(10) || chr(10), '' ORDER BY rank)
  || 'You review and decide — {_APP} never applies for you.' || chr(10) || chr(10) || 'a < b' AS text
FROM digest""".replace("WITH_SENT", _SENT)

_DIGEST_HTML = f"""{_SENT} SELECT '<div><h2>' || count(*) || ' new job matches</h2><p>Ranked best-fit first</p>'
  || chr(10) || '<table>' || chr(10)
  || string_agg('<tr><td><div><b style="background:' || {_COLOUR} || '">' || score || '</b>&nbsp;'
    || '<a class="title" href="' || {_escape('url')} || '">' || {_escape('title')} || '</a>'
    || '</div><div class="where">' || {_escape('company')} || ' · ' || {_escape(_LINE)}
    || '</div><div class="why">' || {_escape('reason')} || '</div>'
    || CASE WHEN salary IS NULL THEN '' ELSE '<div class="salary">' || {_escape(_SALARY_TEXT)}
       || '</div>' END || '</td></tr>' || chr(10), '' ORDER BY rank)
  || '</table>' || chr(10) || '<p>You review and decide — {_APP} never applies for you.</p>'
  || '<p class="note">a &lt; b</p></div>' AS html
FROM digest"""

_DAYS = f"""{_LINES},
 days AS (SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS day, {_SUMS}
   FROM lines WHERE heartbeat GROUP BY 1)"""
_MONEY = "printf('%.2f', cost)"
_DAILY_BODY = f"""('In the last 24 hours it ran ' || runs || ' time(s), scored ' || scored
    || ' new job(s) in a location you can take, and emailed you ' || emailed
    || ' match(es). Estimated spend ~$' || {_MONEY} || '.')"""
_VERDICT = """(CASE WHEN errors = 0 THEN 'Everything healthy.' ELSE '⚠️ ' || errors
    || ' run(s) reported an ERROR today — worth a look.' END
    || CASE WHEN warns > 0 AND errors = 0 THEN ' (' || warns || ' run(s) had a minor warning.)'
    ELSE '' END)"""

_FENCE = r"(?i)</[\s\x0b\x1c-\x1f\x{85}\p{Z}]*job_description[\s\x0b\x1c-\x1f\x{85}\p{Z}]*>"


def _neutral(column: str) -> str:
    return f"regexp_replace({column}, '{_FENCE}', '[/job_description]', 'g')"


def _run_counts(failures: bool) -> str:
    extra = "0 AS source_failures, " if failures else ""
    return f"""WITH {_GATE}, {_FACTS}, {_ranked('chosen')}, {_digest('ranked')}
SELECT (SELECT count(*) FROM base) AS fetched,
  (SELECT count(*) FROM base WHERE eligible) AS eligible,
  (SELECT count(*) FROM fresh) AS new,
  (SELECT count(*) FROM ranked) AS scored,
  (SELECT count(*) FROM ranked WHERE status = 'skipped') AS skipped,
  (SELECT count(*) FROM digest) AS digest, {extra}
  (SELECT count(*) FROM fresh) - (SELECT count(*) FROM chosen) AS deferred"""


_HEAD, _TAIL = prompt_parts(W.PROFILE)
_SEEDED = f"seeded AS ({_last(_EARLIER)})"


def oracle_sql() -> dict[str, str]:
    base = f"WITH {_POSTINGS}"
    gate = f"WITH {_GATE}"
    replies = f"WITH {_FACTS}"
    out: dict[str, str] = {
        f"normalise_{s}": _normalised(s) for s in ("greenhouse", "lever", "ashby", "remotive", "adzuna", "usajobs")
    }
    out |= {
        # sources
        "payload_scan": f"""WITH {_LANDED}
SELECT source, slug, query, page, {_NO} AS path, true AS is_object,
  {_at(f"TIMESTAMP '{W.NOW}'")} AS fetched_at
FROM (SELECT DISTINCT source, slug, query, page, blk FROM landed WHERE source <> 'lever' OR blk % 7 = 5)
UNION ALL SELECT source, slug, query, page, {_NO}, false, {_at(f"TIMESTAMP '{W.NOW}'")}
FROM (SELECT DISTINCT source, slug, query, page, blk FROM landed WHERE source = 'lever' AND blk % 7 <> 5)
UNION ALL SELECT source, slug, NULL, NULL, '/job/' || seq, {_DETAIL}, {_at(f"TIMESTAMP '{W.NOW}'")}
FROM landed WHERE source = 'workday'""",
        "job_id": f"{base} SELECT seq, source, source_id, job_id FROM base",
        "greenhouse_remote": _field("greenhouse", location="location", remote="remote"),
        "lever_locations": _field("lever", location="location"),
        "lever_description": _field("lever", description="description"),
        "ashby_remote": _field("ashby", remote="remote"),
        "ashby_locations": _field("ashby", location="location"),
        "ashby_salary": _field("ashby", salary="salary"),
        "workday_stubs": f"""WITH {_STUBS}
SELECT payload_id, query, stub_pos AS pos, title, '/job/' || seq AS external_path,
  coalesce(location, '') AS location, CASE WHEN seq % 4 <> 0 THEN 'RQ' || seq END AS req_id
FROM stubs""",
        "workday_hydrate": f"""WITH {_workday_rows(_KEEP_STUB)}
SELECT payload_id, stub_pos AS pos, sha256('workday' || chr(0) || wd_id) AS job_id, wd_id AS source_id,
  {_WORKDAY_NAME} AS company, title, {_WORKDAY_URL} AS url, nullif(location, '') AS location,
  contains(lower(coalesce(location, '')), 'remote') AS remote, {_NO} AS salary,
  false AS salary_is_estimated, sha256({_PLAIN}) AS description_sha,
  length({_PLAIN}) AS description_chars, {_at("date_trunc('day', posted_at)")} AS posted_at,
  {_at(f"TIMESTAMP '{W.NOW}'")} AS fetched_at
FROM hydrated""",
        "workday_source_id": f"""WITH {_LANDED} SELECT '/job/' || seq AS d_path, {_WORKDAY_ID} AS source_id
FROM landed WHERE source = 'workday' AND {_DETAIL}""",
        "workday_url": f"""WITH {_LANDED} SELECT '/job/' || seq AS d_path, {_WORKDAY_URL} AS url
FROM landed WHERE source = 'workday' AND {_DETAIL}""",
        "workday_site": """SELECT page_id, CASE WHEN page_id % 3 <> 0 AND
    regexp_matches(url, '^https?://[^/]+/[^/]+/') THEN regexp_extract(url, '^https?://[^/]+/([^/]+)/', 1)
  ELSE 'second' END AS site FROM pages""",
        "adzuna_apply_url": _field("adzuna", url="url"),
        "adzuna_salary": _field("adzuna", salary="salary", salary_is_estimated="estimated"),
        "adzuna_remote": f"""{base} SELECT seq,
  contains(lower(concat_ws(' ', title, location, description)), 'remote') AS remote FROM base""",
        "usajobs_salary": _field("usajobs", salary="salary"),
        "parse_posted_at": f"""{base} SELECT seq, {_at('''CASE seq % 6
    WHEN 0 THEN posted_at + INTERVAL 4 HOUR WHEN 3 THEN date_trunc('day', posted_at)
    WHEN 4 THEN NULL WHEN 5 THEN posted_at + INTERVAL 12500 MICROSECOND ELSE posted_at END''')} AS posted_at,
  {_at('posted_at + to_milliseconds(seq)')} AS from_millis FROM base""",
        "payload_validate": f"WITH {_LANDED}, {_STATUS} SELECT payload_id, source, status, n_items FROM docs",
        "reject_reasons": f"""WITH {_LANDED}, faulty AS (SELECT payload_id, source, blk,
    min(pos) FILTER (WHERE row_no = 5 AND NOT (source = 'ashby' AND seq % 11 = 5)) AS first_bad
  FROM landed WHERE NOT ok GROUP BY ALL)
SELECT payload_id, source, CASE WHEN blk % 7 <> 5 THEN 'field' WHEN source = 'lever' THEN 'document'
    ELSE 'items' END AS reason, CASE WHEN blk % 7 <> 5 THEN first_bad END AS position,
  CASE WHEN blk % 7 = 5 THEN NULL WHEN source = 'lever' THEN 'text'
    WHEN source = 'usajobs' THEN 'MatchedObjectDescriptor.PositionTitle' ELSE 'title' END AS field, true AS kept
FROM faulty
UNION ALL SELECT 'workday-d' || seq, source, CASE WHEN {_DETAIL} THEN 'field' ELSE 'document' END,
  CASE WHEN {_DETAIL} THEN 0 END, CASE WHEN {_DETAIL} THEN 'jobPostingInfo.title' END, true
FROM landed WHERE source = 'workday' AND (NOT {_DETAIL} OR blk % 7 = 3 AND row_no = 5)""",
        "source_failures": f"""WITH {_LANDED}, {_STATUS} SELECT count(*) AS source_count,
  count(*) FILTER (WHERE bad) AS source_failures
FROM (SELECT bool_or(status = 'failed') AS bad FROM docs GROUP BY source, slug, query)""",
        "combine_sources": f"""WITH {_workday_rows('true')}
SELECT payload_id, pos, source, job_id, title FROM landed
WHERE source <> 'workday' AND ok AND (source <> 'ashby' OR seq % 11 <> 5)
UNION ALL SELECT payload_id, stub_pos, source, sha256('workday' || chr(0) || wd_id), title FROM hydrated""",
        "cap_per_query": f"""WITH {_LANDED},
 sized AS (SELECT query, page, count(*) AS n, bool_and(ok) AS fine FROM landed
   WHERE source = 'adzuna' GROUP BY 1, 2),
 scans AS (SELECT query, min(page) FILTER (WHERE fine AND n < {V.ADZUNA_PAGE_SIZE}) AS short_page,
   min(page) FILTER (WHERE NOT fine) AS bad_page FROM sized GROUP BY 1)
SELECT query, page, pos, source_id FROM landed JOIN scans USING (query)
WHERE source = 'adzuna' AND (short_page IS NULL OR page <= short_page)
  AND NOT coalesce((short_page IS NULL OR bad_page <= short_page)
    AND (bad_page - 1) * {V.ADZUNA_PAGE_SIZE} < {Q.ADZUNA_CAP}, false) AND ok
QUALIFY row_number() OVER (PARTITION BY query ORDER BY page, pos) <= {Q.ADZUNA_CAP}""",
        # registry
        "boards": f"""WITH {_LANDED}, {_STATUS}
SELECT t.source, t.slug, t.company, count(d.payload_id) AS documents,
  count(*) FILTER (WHERE d.status = 'failed') AS failed
FROM {_values(V.BOARDS, 'source, slug, company')} LEFT JOIN docs d ON d.source = t.source AND d.slug = t.slug
GROUP BY 1, 2, 3""",
        "company_enrich": f"""WITH {_LANDED}, {_STATUS} SELECT payload_id, source, slug,
  CASE source WHEN 'lever' THEN {_board('lever')} ELSE {_board('ashby')} END AS company
FROM docs WHERE source IN ('lever', 'ashby')""",
        "query_grid": _query_grid(),
        "all_sources": f"""WITH {_LANDED}, {_STATUS},
 per AS (SELECT t.source, t.slug, t.query, count(d.payload_id) AS documents,
    count(*) FILTER (WHERE d.status = 'failed') AS failed
  FROM {_values(_registry_rows(), 'source, slug, query')} LEFT JOIN docs d ON d.source = t.source
    AND d.slug = t.slug AND d.query IS NOT DISTINCT FROM t.query GROUP BY 1, 2, 3)
SELECT source, count(*) AS registered, count(*) FILTER (WHERE documents > 0) AS landed,
  CAST(sum(documents) AS BIGINT) AS documents, CAST(sum(failed) AS BIGINT) AS failed
FROM per GROUP BY 1""",
        "registry_checks": """WITH e AS (SELECT ['greenhouse', 'lever', 'ashby', 'other'][s_suppkey % 4 + 1] AS source,
    's' || (s_suppkey % 60) AS slug, s_suppkey % 17 = 0 AS blank FROM supplier),
 g AS (SELECT source, slug, count(*) AS entries,
    count(*) FILTER (WHERE source = 'other') AS unknown_source,
    count(*) FILTER (WHERE blank) AS blank_company FROM e GROUP BY 1, 2)
SELECT * FROM g WHERE entries > 1 OR unknown_source > 0 OR blank_company > 0""",
        # text
        "html_to_text": _html_to_text(),
        "neutralise_fence": f"""{base} SELECT seq, sha256({_neutral("description || ' '")}
  || '[/job_description]< / x>[/job_description] ' || title) AS text_sha FROM base""",
        "clean_location": f"""{base} SELECT seq, {_cleaned('''(' ,' || location || CASE seq % 3
    WHEN 0 THEN ' (office, NOT remote)' WHEN 1 THEN '; visa — no' ELSE ' — x;y, ' END)''')} AS location
FROM base""",
        "html_escape": f"SELECT page_id, sha256({_escape('html')}) AS html_sha FROM pages",
        "safe_url": """SELECT page_id, page_id % 5 IN (1, 2, 4) AND regexp_matches(url, '^(?i)https?:') AS safe
FROM pages""",
        # filters
        "is_us_eligible": f"{base} SELECT seq, eligible FROM base",
        "keep_worth_scoring": f"{base} SELECT seq, location FROM base WHERE eligible",
        "workable_gate": f"{base} SELECT seq, location, remote FROM base WHERE tier0 <> 6",
        "freshness_cut": f"""{base} SELECT seq, {_at('posted_at')} AS posted_at FROM base
WHERE posted_at IS NULL OR posted_at >= TIMESTAMP {_s(W.NOW)} - INTERVAL {Q.MAX_AGE_DAYS} DAY""",
        "mentions_target_metro": f"{base} SELECT seq, {_found('location', _METRO)} AS mentions FROM base",
        # dedup and store
        "dedup_in_batch": f"""{base} SELECT seq, job_id, title FROM base
QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq) = 1""",
        "new_jobs_only": f"{gate} SELECT seq, job_id FROM fresh",
        "seen_lookup": f"""{gate} SELECT DISTINCT job_id FROM base
WHERE eligible AND job_id IN (SELECT job_id FROM seen)""",
        "store_item": f"""{base} SELECT {_item()} FROM
  (SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq) = 1)""",
        "store_scored_item": f"{_ALL_RANKED} SELECT {_SCORED_ITEM} FROM ranked",
        "mark_seen": f"""{base}, later AS ({_last('eligible')}), first AS ({_last('tier0 <> 6')})
SELECT {_item(title='lower(title)')} FROM later
UNION ALL SELECT {_item()} FROM first WHERE job_id NOT IN (SELECT job_id FROM later)""",
        "save_new": f"""{_ALL_RANKED}, {_SEEDED}
SELECT {_SCORED_ITEM} FROM ranked
UNION ALL SELECT {_item()} FROM seeded WHERE job_id NOT IN (SELECT job_id FROM ranked)""",
        "mark_emailed": _mark_emailed(),
        "store_get": f"""{base} SELECT {_item()} FROM
  (SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq) = 1)
WHERE job_id = (SELECT job_id FROM base ORDER BY posted_at DESC NULLS LAST, seq DESC LIMIT 1)""",
        # tiers and ranking
        "is_remote": f"""{_ALL_RANKED} SELECT seq, {_IS_REMOTE} AS is_remote, {_HINT} AS hinted_remote
FROM ranked""",
        "rare_travel_hybrid": f"""{_ALL_RANKED} SELECT seq,
  coalesce(workplace = 'hybrid' AND office_days <= 2, false) AS rare FROM ranked""",
        "location_tier": f"{base} SELECT seq, tier0 AS tier FROM base",
        "rank_by_location": f"""{base} SELECT seq, tier0 AS tier,
  row_number() OVER (ORDER BY tier0, seq) AS rank FROM base""",
        "to_workplace": f"""{_ALL_RANKED} SELECT seq,
  CASE WHEN workplace = 'odd' THEN 'unknown' ELSE workplace END AS workplace FROM ranked""",
        "scored_tier": f"{_ALL_RANKED} SELECT seq, tier FROM ranked",
        "skip_reason": f"{_ALL_RANKED} SELECT seq, skip_reason FROM ranked",
        "rank_one": f"{_ALL_RANKED} SELECT seq, tier, status, skip_reason FROM ranked",
        "rank": f"""{_ALL_RANKED} SELECT seq, score, tier, status,
  row_number() OVER (ORDER BY {_ORDER}) AS rank FROM ranked""",
        # digest and budget
        "digest_filter": f"""{_ALL_RANKED}, {_digest('ranked')}
SELECT seq, company, title, score FROM strong""",
        "collapse_roles": f"""{_ALL_RANKED} SELECT seq, company, title, score FROM ranked
WHERE {_COMPANY} = '' UNION ALL SELECT seq, company, title, score FROM
  (SELECT * FROM ranked WHERE {_COMPANY} <> ''
   QUALIFY row_number() OVER (PARTITION BY {_COMPANY}, {_TITLE} ORDER BY {_ORDER}) = 1)""",
        "cap_per_company": f"""{_ALL_RANKED} SELECT seq, company, title, score FROM ranked
WHERE {_COMPANY} = '' UNION ALL SELECT seq, company, title, score FROM
  (SELECT * FROM ranked WHERE {_COMPANY} <> ''
   QUALIFY row_number() OVER (PARTITION BY {_COMPANY} ORDER BY {_ORDER}) <= {V.PER_COMPANY})""",
        "digest_top_n": f"""{_ALL_RANKED} SELECT seq, company, title, score FROM ranked
ORDER BY {_ORDER} LIMIT 25""",
        "for_digest": f"""{_SENT} SELECT rank, seq, job_id, company, title, url, location, tier, score,
  reason, {_at('posted_at')} AS posted_at FROM digest""",
        "select_within_budget": f"{gate} SELECT seq, {_at('posted_at')} AS posted_at FROM chosen",
        "deferred": f"{gate} SELECT seq FROM fresh WHERE seq NOT IN (SELECT seq FROM chosen)",
        # scoring boundary
        "build_prompt": f"""{base} SELECT seq, sha256({_s(_HEAD)} || {_neutral('title')} || chr(10) || chr(10)
  || {_neutral('description')} || {_s(_TAIL)}) AS prompt_sha FROM base""",
        "reply_openrouter": _reply("seq % 5 = 1 OR seq % 11 = 0 OR seq % 13 = 0"),
        "reply_bedrock": _reply("seq % 5 = 1 OR seq % 13 = 0"),
        "parse_response": f"""{replies} SELECT seq, parsed,
  CASE WHEN parsed THEN score END AS score FROM facts""",
        "to_scored": f"""{replies} SELECT seq, score, reason,
  CASE WHEN azure THEN 'other|azure_mandatory' ELSE '' END AS skip_flags, workplace,
  CAST(office_days AS DOUBLE) AS office_days_per_month, CAST(years AS DOUBLE) AS years_required,
  authorization_need AS work_authorization FROM facts WHERE parsed""",
        "score_many": f"{_ALL_RANKED} SELECT seq, job_id, score FROM ranked",
        "unscored": f"""{base}, {_FACTS}
SELECT base.seq, base.job_id FROM base JOIN facts ON facts.seq = base.seq
WHERE eligible AND NOT parsed QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY base.seq) = 1""",
        "scorer_replies": f"""{gate}, asked AS (SELECT seq, sha256({_s(_HEAD)} || {_neutral('title')} || chr(10)
    || chr(10) || {_neutral('description')} || {_s(_TAIL)}) AS sha FROM uniq),
 drawn AS (SELECT seq, CAST('0x' || substr(sha, 1, 6) AS BIGINT) AS n FROM asked)
SELECT seq, CASE WHEN n % 7 <> 0 THEN n % 101 END AS score,
  CASE WHEN n % 7 = 0 AND seq % 3 = 0 THEN 2 ELSE 1 END AS paid FROM drawn""",
        # run metrics
        "run_counts": _run_counts(False),
        "assess_run": f"WITH {_RUNS} SELECT event_id, attempted, health, headline FROM assessed",
        "heartbeat_line": f"""WITH {_RUNS} SELECT event_id, '{W.MARKER} health=' || health || ' (' || headline
  || ') | fetched=' || fetched || ' eligible=' || eligible || ' new=' || new || ' scored=' || scored
  || ' skipped=' || skipped || ' digest=' || digest || ' deferred=' || deferred
  || ' sources_failed=' || source_failures || '/' || source_count || ' emailed=' || emailed
  || ' msg=' || coalesce(message_id, '-') AS message FROM assessed""",
        "spend_estimate": f"""WITH {_RUNS}, priced AS (SELECT *, scored * CASE WHEN model ILIKE '%haiku%' THEN 0.004::DOUBLE
    WHEN model ILIKE '%sonnet%' THEN 0.012::DOUBLE ELSE 0.008::DOUBLE END AS cost FROM judged)
SELECT event_id, cost, 'This run scored ' || scored || ' new job' || CASE WHEN scored = 1 THEN '' ELSE 's' END
  || ' in a location you can take and emailed the ' || digest || ' that fit. Est. cost ~$' || {_MONEY}
  || ' (dedup means each job is paid for once, ever).' AS note FROM priced""",
        "parse_heartbeat": f"WITH {_LINES} SELECT event_id, health, scored, emailed FROM lines WHERE heartbeat",
        "daily_window": f"WITH {_LAST_DAY} SELECT event_id, {_at('ts')} AS ts FROM recent",
        "summarize": f"""WITH {_LAST_DAY}
SELECT {_NO} AS day, {_SUMS} FROM recent
UNION ALL SELECT {_at("time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01')")} AS day, {_SUMS}
FROM lines WHERE heartbeat GROUP BY 1""",
        "daily_text": f"""WITH {_DAYS}, quiet AS (SELECT * REPLACE (CASE WHEN day(day) % 3 = 0 THEN 0 ELSE errors END AS errors)
   FROM days)
SELECT {_at('day')} AS day,
  '{_APP} daily check — ' || emailed || ' matches, ' || runs || ' runs' AS subject,
  '{_APP} daily check.' || chr(10) || chr(10) || {_DAILY_BODY} || chr(10) || chr(10) || {_VERDICT}
    || chr(10) AS text,
  '<div><h2>{_APP} — daily check</h2><p>' || {_DAILY_BODY} || '</p><p style="color:'
    || CASE WHEN errors = 0 THEN '#1a7f37' ELSE '#b42318' END || '">' || {_VERDICT} || '</p></div>' AS html
FROM quiet""",
        "alarm_unhealthy": f"""WITH {_LINES} {_periods(300, 'lines', 'unhealthy',
            "count(*) FILTER (WHERE NOT heartbeat OR health = 'error')")}""",
        "alarm_errors": _periods(
            300, "events", "errors", "count(*) FILTER (WHERE event_type = 'error')"
        ),
        "alarm_no_runs": f"""WITH {_LINES},
 busy AS (SELECT {_bucket(28800)} AS p FROM lines WHERE heartbeat AND scored > 150),
 ends AS (SELECT min(ts) AS a, max(ts) + INTERVAL 3 DAY AS b FROM lines),
 span AS (SELECT p FROM (SELECT unnest(generate_series({_bucket(28800, 'a')}, b,
   INTERVAL 28800 SECOND)) AS p, a, b FROM ends) WHERE p >= a AND p < b)
SELECT {_at('span.p')} AS period_start, {_at('span.p + INTERVAL 28800 SECOND')} AS period_end,
  count(busy.p) AS runs, count(busy.p) < 1 AS alarm
FROM span LEFT JOIN busy ON busy.p = span.p GROUP BY span.p""",
        # rendering
        "digest_subject": f"""{_SENT} SELECT count(*) AS n, count(*) || ' new job '
  || CASE WHEN count(*) = 1 THEN 'match' ELSE 'matches' END || ' — {_APP}' AS subject FROM digest""",
        "salary_text": f"{base} SELECT seq, {_SALARY_TEXT} AS salary FROM base WHERE salary IS NOT NULL",
        "location_line": f"{_ALL_RANKED} SELECT seq, {_LINE} AS line FROM ranked",
        "score_band": f"{_ALL_RANKED} SELECT seq, {_COLOUR} AS colour FROM ranked",
        "linked_title": f"""{base} SELECT seq, CASE WHEN seq % 4 = 0 THEN '<span class="title">' ||
    {_escape("'<b>' || title || '</b>'")} || '</span>'
  ELSE '<a class="title" href="' || {_escape("url || '?a=\"1\"&b'")} || '">' ||
    {_escape("'<b>' || title || '</b>'")} || '</a>' END AS title FROM base""",
        "digest_html": _DIGEST_HTML,
        "digest_text": _DIGEST_TEXT,
        "digest_outbox": f"{_SENT} SELECT job_id FROM digest",
        # runs and streams
        "full_run": _run_counts(True),
        "full_run_store": f"""WITH {_GATE}, {_FACTS}, {_ranked('chosen')}, {_SEEDED}
SELECT job_id, CASE status WHEN 'ranked' THEN 'new' ELSE 'skipped' END AS status,
  score AS fit_score, tier AS location_tier, skip_reason FROM ranked
UNION ALL SELECT job_id, 'new', NULL, NULL, NULL FROM seeded""",
        "stream_backlog": f"""WITH {_GATE}, {_FACTS}, fit AS (SELECT * FROM fresh WHERE tier0 <> 6
    AND (posted_at IS NULL OR posted_at >= TIMESTAMP {_s(W.NOW)} - INTERVAL {Q.MAX_AGE_DAYS} DAY)),
 {_ranked('fit')}, {_SEEDED}
SELECT job_id, CASE status WHEN 'ranked' THEN 'new' ELSE 'skipped' END AS status,
  score AS fit_score, tier AS location_tier, skip_reason FROM ranked
UNION ALL SELECT job_id, 'new', NULL, NULL, NULL FROM seeded""",
        "stream_ingest": f"""WITH {_workday_rows('true')}, rows_ AS ({_ingested()})
SELECT source, job_id, title, location, {_at('posted')} AS posted_at FROM rows_
UNION ALL SELECT source, sha256('workday' || chr(0) || wd_id), title, nullif(location, ''),
  {_at("date_trunc('day', posted_at)")} FROM hydrated""",
        "stream_dedup": f"""WITH {_GATE} SELECT seq, job_id FROM
  (SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq) = 1)
WHERE job_id NOT IN (SELECT job_id FROM seen)""",
        "stream_run": _run_counts(True),
        "stream_daily_summary": f"""WITH {_DAYS} SELECT {_at('day')} AS day, runs, scored, emailed, errors, warns,
  cost, healthy FROM days
WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
        "stream_no_runs": f"""WITH {_LINES},
 busy AS (SELECT {_bucket(28800)} AS p FROM lines WHERE heartbeat AND scored > 150),
 ends AS (SELECT min(ts) AS a, max(ts) + INTERVAL 3 DAY AS b FROM lines),
 span AS (SELECT p FROM (SELECT unnest(generate_series({_bucket(28800, 'a')}, b,
   INTERVAL 28800 SECOND)) AS p, a, b FROM ends)
   WHERE p >= a AND p + INTERVAL 28800 SECOND <= b - INTERVAL 10 MINUTE)
SELECT {_at('span.p')} AS period_start, {_at('span.p + INTERVAL 28800 SECOND')} AS period_end,
  count(busy.p) AS runs, count(busy.p) < 1 AS alarm
FROM span LEFT JOIN busy ON busy.p = span.p GROUP BY span.p""",
        "stream_receipts": f"""{base} SELECT seq, job_id, seq % 3 = 0 AS delivered,
  bool_or(seq % 3 = 0) OVER (PARTITION BY job_id) AS emailed
FROM base WHERE posted_at IS NOT NULL""",
        "stream_alarms": f"""WITH {_LINES} {_periods(300, 'lines', 'unhealthy',
            "count(*) FILTER (WHERE NOT heartbeat OR health = 'error')")}""",
    }
    return out


def _ingested() -> str:
    return " UNION ALL ".join(
        f"SELECT source, job_id, title, {e['location']} AS location, {e['posted']} AS posted {_rows(s)}"
        for s, e in _EXPECT.items()
    )


def _query_grid() -> str:
    from vacantia.sources.registry import _queries

    rows = [(q[0], q[1], q[2], q[4], q[5], q[6]) for q in _queries()]
    return f"""WITH {_LANDED}, {_STATUS},
 grid AS (SELECT source, slug, query, CAST(radius AS BIGINT) AS radius,
    CASE WHEN remote_only = 'True' THEN true WHEN remote_only = 'False' THEN false END AS remote_only,
    CAST(max_results AS BIGINT) AS max_results
  FROM {_values([(a, b, c, d, None if e is None else str(e), f) for a, b, c, d, e, f in rows],
                'source, slug, query, radius, remote_only, max_results')})
SELECT g.*, count(d.payload_id) AS documents, count(*) FILTER (WHERE d.status = 'failed') AS failed
FROM grid g LEFT JOIN docs d ON d.source = 'remotive' AND g.source = 'remotive' AND d.query = g.query
GROUP BY ALL"""


def _html_to_text() -> str:
    def unescape(column: str) -> str:
        # The entities of the table; a cut-off one needs no semicolon.
        for entity, char in (
            ("quot", '"'), ("copy", "©"), ("middot", "·"), ("nbsp", " "), ("lt", "<"), ("gt", ">"),
            ("#x27", "'"), ("amp", "&"),
        ):
            column = f"regexp_replace({column}, '&{entity};?', {_s(char)}, 'g')"
        return column

    tags = f"regexp_replace({unescape('html')}, '<[^>]+>', ' ', 'g')"
    return f"SELECT page_id, {_collapse(unescape(tags))} AS text FROM pages"


def _reply(failed: str) -> str:
    """The reply text itself, rebuilt from its parts."""
    body = """'{"score": ' || CASE WHEN sid % 19 = 0 THEN '150' WHEN sid % 10 = 1 THEN '"' || score || '"'
      WHEN sid % 10 = 3 THEN score || '.7' ELSE '' || score END || ', '
    || CASE WHEN sid % 7 = 0 THEN '' WHEN sid % 31 = 0 THEN '"reason": null, '
      ELSE '"reason": "r' || sid || ' & <ok>", ' END
    || '"skip_flags": ' || CASE WHEN azure THEN '["other", "azure_mandatory"]' ELSE '[]' END
    || ', "workplace": "' || workplace || '", "office_days_per_month": '
    || coalesce('' || office_days, 'null') || ', "years_required": ' || years
    || ', "work_authorization": "' || authorization_need || '"}'"""
    return f"""WITH {_FACTS}, texts AS (SELECT *, {body} AS body FROM facts)
SELECT seq, CASE WHEN {failed} THEN NULL WHEN sid % 17 = 0 THEN 'No JSON here.'
  WHEN sid % 3 = 0 THEN '```json' || chr(10) || body || chr(10) || '```'
  WHEN sid % 3 = 1 THEN 'Here it is:' || chr(10) || body || chr(10) || 'Done.'
  ELSE body END AS reply FROM texts"""


def _mark_emailed() -> str:
    bare = ", ".join(
        f"{'job_id' if n == 'job_id' else _s('emailed') if n == 'status' else 'NULL'} AS {n}"
        for n in (
            "job_id", "source", "source_id", "company", "title", "url", "remote", "status",
            "fetched_at", "location", "salary", "salary_is_estimated", "posted_at", "fit_score",
            "fit_reason", "location_tier", "skip_flags", "skip_reason",
        )
    )
    status = "CASE WHEN job_id IN (SELECT job_id FROM sent) THEN 'emailed' ELSE 'new' END"
    return f"""WITH {_POSTINGS}, stored AS ({_last('tier0 <> 6')}),
 sent AS (SELECT DISTINCT job_id FROM base WHERE {_EARLIER})
SELECT {_item(status=status)} FROM stored
UNION ALL SELECT {bare} FROM sent WHERE job_id NOT IN (SELECT job_id FROM stored)"""
