import pytest
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.functions import location as L

# One example per rule; the lists themselves are gone through below.
KEPT = [
    "Portland, OR", "Spokane WA", "boise, id", "U.S. only", "U.S.A", "USA", "US", "united states",
    "Somewhere near D.C.", "worldwide", "ANYWHERE", "northern america", "The Americas", None, "",
    # Unknown places stay: only a foreign name drops a posting.
    "Lincoln County", "Atlantis",
    # A foreign name beside a US one stays.
    "Oslo, Norway; Reno, NV", "Rome, GA", "Lima, OH", "Perth and Anywhere",
    # A state's code in front is no Canadian one.
    "US-WA-Spokane",
    # Codes match words of other languages, whatever their case.
    "Oslo or Vienna", "Valle de la Luna, Chile",
]
DROPPED = [
    "Leeds, UK", "Perth", "osaka", "Kerala, India", "Zurich", "zürich", "Sao Paulo", "são paulo", "Bogota",
    "Remote (Mexico)", "Remote, Kenya", "Oslo, Vienna", "EMEA", "APAC and LATAM", "Calgary, BC",
    # A Canadian code in front decides, whatever follows.
    "CA-Quebec-Laval", "  ca-Alberta-Banff, US",
    # City names match inside longer words, regions as whole words only.
    "Limassol", "Perthshire",
]


def test_every_listed_place(column):
    states = [f"Place, {code}" for code in V.US_STATE_CODES]
    assert column(L.is_us_eligible, states) == [True] * len(states)
    regions = [f"[{name}]" for name in V.FOREIGN_REGIONS]
    assert column(L.is_us_eligible, regions) == [False] * len(regions)
    inside = [f"{name}x" for name in V.FOREIGN_REGIONS if len(name) == 2]
    assert column(L.is_us_eligible, inside) == [True] * len(inside)
    cities = [f"x{name}x" for name in V.FOREIGN_CITY_PATTERNS if "[" not in name and " de " not in name]
    assert column(L.is_us_eligible, cities) == [False] * len(cities)


def test_eligibility(column):
    assert column(L.is_us_eligible, KEPT) == [True] * len(KEPT)
    assert column(L.is_us_eligible, DROPPED) == [False] * len(DROPPED)


@pytest.mark.parametrize(
    ("place", "remote", "workplace", "days", "tier"),
    [
        ("Remote (US)", False, None, None, 1),
        ("Reno, NV", True, None, None, 1),
        ("Reno, NV", True, "hybrid", None, 6),
        ("Reno, NV", False, "remote", None, 1),
        ("Bradenton, FL", False, None, None, 3),
        ("Bradenton, FL", False, "hybrid", 9.0, 2),
        ("Saint Petersburg, FL", False, "onsite", None, 3),
        ("St.Petersburg", False, "unknown", None, 3),
        ("Boise, ID", False, "hybrid", 2.0, 4),
        ("Boise, ID", False, "hybrid", 2.5, 6),
        ("Boise, ID", False, "hybrid", None, 6),
        ("Boise, ID", False, "onsite", 0.0, 6),
        ("Wheaton, DuPage County", False, None, None, 5),
        ("Elgin, IL", False, "hybrid", 1.0, 4),
        ("Elgin, IL", False, "hybrid", 8.0, 5),
        ("Jerome, will county", False, None, None, 5),
        ("Remotely, NV", False, None, None, 6),
        (None, False, None, None, 6),
        ("Bradenton, FL", False, "Hybrid", None, 3),
    ],
)
def test_tier(column, place, remote, workplace, days, tier):
    got = column(
        L.location_tier,
        [(place, remote, workplace, days)],
        "p string, r boolean, w string, d double",
    )
    assert got == [tier]


def test_other_gazetteer(column):
    alps = L.Gazetteer(target_metro=("Zermatt",), current_base=("Bern",))
    tier = lambda p: L.location_tier(p, F.lit(False), gazetteer=alps)
    assert column(tier, ["Zermatt", "Bern", "Bradenton, FL"]) == [3, 5, 6]


def test_workplace_words(column):
    assert column(L.to_workplace, ["remote", "hybrid", "onsite", "Remote", "odd", None]) == [
        "remote", "hybrid", "onsite", "unknown", "unknown", "unknown",
    ]


def test_metro_mention(column):
    texts = ["From home, with a desk in Lakeland", "Elgin, IL", None, ""]
    assert column(L.mentions_target_metro, texts) == [True, False, False, False]
