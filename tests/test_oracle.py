"""Every query with SQL gives the same rows as DuckDB; the others run."""

import datetime
import math
import os

import duckdb
import pytest

from foliomill.plans.registry import ORACLE_SQL, QUERIES
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, name, run, sql, sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = run(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want = rows([c[0] for c in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b][:2]
    assert len(got[1]) == len(want[1]) and not bad, (len(got[1]), len(want[1]), bad)
    return len(got[1])


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    compare(spark, name, QUERIES[name], ORACLE_SQL[name], os.environ.get("ORACLE_SF", SF))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
