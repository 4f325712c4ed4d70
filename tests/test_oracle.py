"""Every query against its SQL in a second engine, on whole tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from vacantia.checks import oracle, queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

QUERIES = queries.queries()
ORACLE = oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda n: columns[n])

    def text(v):
        if v is None or (isinstance(v, float) and pd.isna(v)):
            return "NULL"
        return repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(text(row[n]) for n in order) for row in rows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, duck):
    df = QUERIES[name](spark, SMALL)
    cursor = duck.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert comparable(df.collect(), df.columns) == comparable(cursor.fetchall(), names)


def test_entry_gives_a_digest(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 10
    assert sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1))
