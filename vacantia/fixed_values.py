"""Fixed values.

Everything in this module is a value the results depend on: word lists, lookup
tables, patterns, constants and text formats. Change one and the output of an
operator changes. No logic lives here.
"""

from __future__ import annotations

# --- fixed values: posting sources, in the order that breaks ties -----------------
SOURCES = ("greenhouse", "lever", "ashby", "remotive", "adzuna", "workday", "usajobs")

# --- fixed values: eligibility word lists -----------------------------------------
US_STATE_CODES = (
    "AL AK AZ AR CA CO CT DC DE FL GA HI IA ID IL IN KS KY LA MA MD ME MI MN MO MS MT "
    "NC ND NE NH NJ NM NV NY OH OK OR PA RI SC SD TN TX UT VA VT WA WI WV WY"
).split()

US_SCOPE_PATTERNS = (
    r"\bUSA?\b",
    r"\bU\.S\.A?\.?",
    r"United States",
    r"\bD\.C\.",
    r"Worldwide",
    r"\bAnywhere\b",
    r"North(?:ern)? America",
    r"\bAmericas\b",
)

CANADA_PREFIX_PATTERN = r"^\s*CA-"

# Matched as whole words.
FOREIGN_REGIONS = (
    "UK", "United Kingdom", "England", "Scotland", "Ireland", "IE", "Australia", "Japan",
    "India", "Germany", "DEU", "France", "Spain", "Italy", "Netherlands", "Belgium", "Sweden",
    "SE", "Norway", "Denmark", "Finland", "Poland", "Switzerland", "CH", "Austria", "Portugal",
    "Greece", "Turkey", "Israel", "UAE", "Kenya", "Nigeria", "Egypt", "Singapore", "Taiwan",
    "China", "Hong Kong", "South Korea", "Korea", "Indonesia", "Malaysia", "Thailand", "Vietnam",
    "Philippines", "Brazil", "Argentina", "Chile", "Colombia", "Mexico", "Canada", "CAN", "ON",
    "BC", "QC", "Uruguay", "Peru", "Ecuador", "Venezuela", "Bolivia", "Paraguay", "Europe",
    "EMEA", "APAC", "LATAM", "EU",
)

# Matched anywhere, also inside a longer word.
FOREIGN_CITY_PATTERNS = (
    "London", "Berlin", "Paris", "Milan", "Rome", "Munich", "Frankfurt", "Hamburg", "Dublin",
    "Amsterdam", "Brussels", "Stockholm", "Gothenburg", "Copenhagen", "Oslo", "Helsinki",
    "Warsaw", "Prague", "Vienna", "Lisbon", "Madrid", "Barcelona", "Z[uü]rich", "Geneva",
    "Istanbul", "Tel Aviv", "Dubai", "Abu Dhabi", "Nairobi", "Lagos", "Cairo", "Mumbai",
    "Bengaluru", "Bangalore", "Hyderabad", "Delhi", "Chennai", "Pune", "Jakarta", "Manila",
    "Bangkok", "Singapore", "Seoul", "Tokyo", "Osaka", "Shanghai", "Beijing", "Shenzhen",
    "Sydney", "Melbourne", "Brisbane", "Perth", "Auckland", "Toronto", "Vancouver", "Montreal",
    "Ottawa", "Calgary", "S[aã]o Paulo", "Rio de Janeiro", "Buenos Aires", "Bogot[aá]",
    "Santiago", "Lima", "Mexico City", "Guadalajara",
)

# --- fixed values: metro gazetteer and tiers --------------------------------------
TARGET_METRO_PATTERNS = (
    "Venice", "Sarasota", "North Port", "Osprey", "Nokomis", "Laurel", "Englewood",
    "Siesta Key", "Tampa", r"St\.? ?Petersburg", "Saint Petersburg", "Clearwater", "Bradenton",
    "Palmetto", "Brandon", "Riverview", "Largo", "Lakeland",
)

CURRENT_BASE_PATTERNS = (
    "Chicago", "Chicagoland", "Evanston", "Oak Park", "Naperville", "Schaumburg", "Lemont",
    "Joliet", "Elgin", "Cicero", "Skokie", "Arlington Heights", "Des Plaines", "Orland Park",
    "Tinley Park", "Bolingbrook", "Downers Grove", "Elmhurst", "Lombard", "Wheaton",
    "Oak Brook", "Hinsdale", "Palatine", "Buffalo Grove", "Cook County", "DuPage County",
    "Will County", "McHenry County",
)

REMOTE_WORD_PATTERN = r"\bremote\b"

REMOTE_US = 1
TARGET_METRO_HYBRID = 2
TARGET_METRO_ONSITE = 3
HYBRID_RARE_TRAVEL = 4
CURRENT_BASE = 5
OTHER_US = 6

TIER_LABELS = {
    REMOTE_US: "Remote (US)",
    TARGET_METRO_HYBRID: "Tampa Bay · hybrid",
    TARGET_METRO_ONSITE: "Sarasota / Tampa · on-site",
    HYBRID_RARE_TRAVEL: "Hybrid · rare travel",
    CURRENT_BASE: "Chicago",
    OTHER_US: "US",
}
METRO_FLAG = " · Tampa/Sarasota area"

WORKPLACES = ("remote", "hybrid", "onsite", "unknown")
RARE_TRAVEL_DAYS = 2

# --- fixed values: skip rules and digest knobs ------------------------------------
YEARS_WALL = 8
SKIP_YEARS_FORMAT = "requires {years}+ years (his wall is {wall})"
SKIP_AUTHORIZATION = "foreign_required"
SKIP_AUTHORIZATION_TEXT = "requires work authorization he does not have (non-US citizenship/visa)"
SKIP_FLAG_TEXTS = {"azure_mandatory": "Azure is a mandatory requirement"}

DIGEST_LIMIT = 10
MIN_SCORE = 65
PER_COMPANY = 2
MAX_AGE_DAYS = 14
SCORE_RANGE = (0, 100)

# --- fixed values: digest and report formats --------------------------------------
SCORE_COLOURS = ((85, "#1a7f37"), (70, "#0b57d0"), (50, "#b26a00"), (0, "#6b6b6b"))
SALARY_FORMAT = "Salary: {salary}"
SALARY_ESTIMATED_SUFFIX = " (estimated, not employer-stated)"
SAFE_URL_SCHEMES = ("http", "https")

COST_PER_SCORE = {"haiku": 0.004, "sonnet": 0.012}
COST_PER_SCORE_OTHER = 0.008
DAILY_COST_PER_SCORE = {"haiku": 0.004}
DAILY_COST_PER_SCORE_OTHER = 0.012

HEALTH_PATTERN = r"health=(\w+)"
SCORED_PATTERN = r"scored=(\d+)"
EMAILED_PATTERN = r"emailed=(\d+)"

DAILY_WINDOW_SECONDS = 86400
ALARM_PERIOD_SECONDS = 300
NO_RUN_WINDOW_SECONDS = 28800

# --- fixed values: per-source constants -------------------------------------------
ADZUNA_PAGE_SIZE = 50
ADZUNA_PREDICTED = "1"
USAJOBS_PAY_INTERVALS = {"PA": "/yr", "PH": "/hr", "PD": "/day"}
GREENHOUSE_REMOTE_METADATA = ("Location Type", "Remote")
WORKDAY_SITEMAP_PATTERN = r"^Sitemap:\s*https?://[^/]+/([^/]+)/"

# --- fixed values: model reply patterns -------------------------------------------
CODE_FENCE_PATTERN = r"^\s*```(?:json)?\s*|\s*```\s*$"
JSON_OBJECT_PATTERN = r"\{.*\}"
CLOSING_FENCE_PATTERN = r"</\s*job_description\s*>"
NEUTRAL_FENCE = "[/job_description]"
TAG_PATTERN = r"<[^>]+>"

# --- fixed values: source registry ------------------------------------------------
# (source, slug, company)
BOARDS = (
    ("ashby", "modelyst", "Modelyst"),
    ("lever", "foodsmart", "Foodsmart"),
    ("greenhouse", "nex", "Nex"),
    ("ashby", "ramp", "Ramp"),
    ("greenhouse", "brex", "Brex"),
    ("greenhouse", "mercury", "Mercury"),
    ("greenhouse", "marqeta", "Marqeta"),
    ("ashby", "moderntreasury", "Modern Treasury"),
    ("ashby", "plaid", "Plaid"),
    ("greenhouse", "checkr", "Checkr"),
    ("lever", "finix", "Finix"),
    ("greenhouse", "highnote", "Highnote"),
    ("ashby", "unit", "Unit"),
    ("greenhouse", "lithic", "Lithic"),
    ("greenhouse", "gusto", "Gusto"),
    ("greenhouse", "melio", "Melio"),
    ("greenhouse", "mesh", "Mesh Payments"),
    ("ashby", "column", "Column"),
    ("greenhouse", "found", "Found"),
    ("greenhouse", "tabapay", "TabaPay"),
    ("ashby", "astra", "Astra"),
    ("greenhouse", "databricks", "Databricks"),
    ("ashby", "snowflake", "Snowflake"),
    ("greenhouse", "fivetran", "Fivetran"),
    ("ashby", "airbyte", "Airbyte"),
    ("ashby", "astronomer", "Astronomer"),
    ("ashby", "confluent", "Confluent"),
    ("greenhouse", "cribl", "Cribl"),
    ("greenhouse", "hightouch", "Hightouch"),
    ("greenhouse", "sigmacomputing", "Sigma Computing"),
    ("greenhouse", "starburst", "Starburst"),
    ("ashby", "montecarlodata", "Monte Carlo"),
    ("ashby", "prefect", "Prefect"),
    ("greenhouse", "datadog", "Datadog"),
    ("greenhouse", "stripe", "Stripe"),
    ("greenhouse", "anthropic", "Anthropic"),
    ("ashby", "cohere", "Cohere"),
    ("ashby", "langchain", "LangChain"),
    ("ashby", "baseten", "Baseten"),
    ("ashby", "modal", "Modal"),
    ("ashby", "pinecone", "Pinecone"),
    ("ashby", "weaviate", "Weaviate"),
    ("greenhouse", "scaleai", "Scale AI"),
    ("greenhouse", "adyen", "Adyen"),
    ("greenhouse", "affirm", "Affirm"),
    ("greenhouse", "alloy", "Alloy"),
    ("lever", "anchorage", "Anchorage Digital"),
    ("greenhouse", "billcom", "Bill.com"),
    ("greenhouse", "chime", "Chime"),
    ("ashby", "circle", "Circle"),
    ("lever", "dwolla", "Dwolla"),
    ("greenhouse", "fireblocks", "Fireblocks"),
    ("greenhouse", "galileo", "Galileo"),
    ("greenhouse", "gemini", "Gemini"),
    ("greenhouse", "justworks", "Justworks"),
    ("ashby", "middesk", "Middesk"),
    ("lever", "nium", "Nium"),
    ("ashby", "novo", "Novo"),
    ("ashby", "paxos", "Paxos"),
    ("greenhouse", "payoneer", "Payoneer"),
    ("ashby", "persona", "Persona"),
    ("ashby", "sardine", "Sardine"),
    ("ashby", "synctera", "Synctera"),
    ("lever", "truv", "Truv"),
    ("ashby", "anomalo", "Anomalo"),
    ("ashby", "atlan", "Atlan"),
    ("greenhouse", "clickhouse", "ClickHouse"),
    ("ashby", "datafold", "Datafold"),
    ("ashby", "deepnote", "Deepnote"),
    ("greenhouse", "dremio", "Dremio"),
    ("greenhouse", "imply", "Imply"),
    ("ashby", "lightdash", "Lightdash"),
    ("ashby", "materialize", "Materialize"),
    ("ashby", "motherduck", "MotherDuck"),
    ("ashby", "sifflet", "Sifflet"),
    ("greenhouse", "singlestore", "SingleStore"),
    ("lever", "tinybird", "Tinybird"),
    ("greenhouse", "amplitude", "Amplitude"),
    ("ashby", "anyscale", "Anyscale"),
    ("ashby", "cerebras", "Cerebras"),
    ("ashby", "chalk", "Chalk"),
    ("ashby", "cognition", "Cognition"),
    ("greenhouse", "cresta", "Cresta"),
    ("ashby", "decagon", "Decagon"),
    ("ashby", "dust", "Dust"),
    ("greenhouse", "fireworksai", "Fireworks AI"),
    ("ashby", "harvey", "Harvey"),
    ("ashby", "inngest", "Inngest"),
    ("ashby", "lancedb", "LanceDB"),
    ("greenhouse", "launchdarkly", "LaunchDarkly"),
    ("ashby", "llamaindex", "LlamaIndex"),
    ("greenhouse", "mixpanel", "Mixpanel"),
    ("ashby", "nomic", "Nomic"),
    ("ashby", "openai", "OpenAI"),
    ("ashby", "perplexity", "Perplexity"),
    ("ashby", "poolside", "Poolside"),
    ("ashby", "posthog", "PostHog"),
    ("ashby", "sierra", "Sierra"),
    ("ashby", "temporal", "Temporal"),
    ("ashby", "unstructured", "Unstructured"),
    ("greenhouse", "vectara", "Vectara"),
    ("ashby", "writer", "Writer"),
    ("lever", "zilliz", "Zilliz"),
)

REMOTIVE_SEARCHES = (
    "data engineer", "AI engineer", "machine learning engineer", "data platform",
    "backend engineer",
)

# (place, radius in miles)
ADZUNA_PLACES = (("Sarasota", 60), ("Chicago", 40))
ADZUNA_PHRASES = ("data engineer", "AI engineer", "machine learning engineer", "data platform")
ADZUNA_QUERY_MAX_RESULTS = 25

# (tenant, site, host, company)
WORKDAY_BOARDS = (
    ("gdit", "External_Career_Site", "gdit.wd5.myworkdayjobs.com", "GDIT"),
    ("leidos", "External", "leidos.wd5.myworkdayjobs.com", "Leidos"),
    ("parsons", "Search", "parsons.wd5.myworkdayjobs.com", "Parsons"),
)
WORKDAY_SEARCHES = ("data engineer", "AI engineer")
WORKDAY_QUERY_MAX_RESULTS = 10

USAJOBS_KEYWORDS = ("data engineer", "artificial intelligence")
# (place, radius in miles, remote only)
USAJOBS_SCOPES = (
    ("Chicago, Illinois", 40, False),
    ("Tampa, Florida", 60, False),
    (None, None, True),
)
USAJOBS_QUERY_MAX_RESULTS = 25

# --- fixed values: texts of digests, heartbeats and daily reports ------------------
# {app} and {marker} are the caller's own names.
DIGEST_SUBJECT_FORMAT = "{n} new job {noun} — {app}"
DIGEST_NOUNS = ("match", "matches")
DIGEST_HEADER_FORMAT = "{n} new job matches"
DIGEST_ORDER_TEXT = "ranked best-fit first"
DIGEST_FOOTER_FORMAT = "You review and decide — {app} never applies for you."

SPEND_NOTE_FORMAT = (
    "This run scored {scored} new job{plural} in a location you can take and emailed the "
    "{digest} that fit. Est. cost ~${cost} (dedup means each job is paid for once, ever)."
)

HEADLINE_ALL_FAILED = "all sources failed — fetched nothing"
HEADLINE_SCORER_DOWN = "scored 0 of {attempted} — scorer down (API/credit?)"
HEADLINE_SOME_FAILED = "{failed}/{sources} sources failed"
HEADLINE_NOTHING_FETCHED = "0 jobs fetched with no failures — boards empty/changed?"
HEADLINE_HEALTHY = "healthy"

HEARTBEAT_FORMAT = (
    "{marker} health={health} ({headline}) | fetched={fetched} eligible={eligible} new={new} "
    "scored={scored} skipped={skipped} digest={digest} deferred={deferred} "
    "sources_failed={source_failures}/{source_count} emailed={emailed} msg={message_id}"
)

DAILY_SUBJECT_FORMAT = "{app} daily check — {emailed} matches, {runs} runs"
DAILY_HEALTHY_TEXT = "Everything healthy."
DAILY_ERROR_FORMAT = "⚠️ {errors} run(s) reported an ERROR today — worth a look."
DAILY_WARN_FORMAT = " ({warns} run(s) had a minor warning.)"
DAILY_BODY_FORMAT = (
    "In the last 24 hours it ran {runs} time(s), scored {scored} new job(s) in a location you "
    "can take, and emailed you {emailed} match(es). Estimated spend ~${cost}."
)
