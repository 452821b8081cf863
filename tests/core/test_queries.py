"""Every query with SQL agrees with it, on the smallest data."""

import os
from collections import Counter

import pytest

import __spark_entry__
from quillon.plans.registry import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = Counter(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    if name in ORACLE_SQL:
        res = duck.execute(ORACLE_SQL[name])
        at = [x[0] for x in res.description]
        assert sorted(at) == cols
        assert got == Counter(repr(tuple(plain(r[at.index(c)]) for c in cols)) for r in res.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 6
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_activities_of_all_leads_are_listed(spark):
    rows = [tuple(r) for r in QUERIES["activities_list"](spark, DIR).select("lead_id", "created_at", "id").collect()]
    assert rows == sorted(sorted(rows, key=lambda r: r[2]), key=lambda r: (r[0], -r[1].timestamp())) and len({r[0] for r in rows}) > 1
    counts = Counter(r[0] for r in rows)
    for lead in list(counts)[:2]:
        assert QUERIES["activities_list"](spark, DIR, lead_id=lead).count() == counts[lead]
