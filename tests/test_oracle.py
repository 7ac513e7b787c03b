"""Every query with a SQL twin gives the same rows as DuckDB on the same tables."""

import decimal
import math

import pytest

import __spark_entry__ as entry
from granary.plans import coverage, registry  # noqa: F401

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query(spark, db, sf, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(str(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    cur = db.execute(registry.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(str(tuple(norm(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
    assert got == want


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and all(r.score is not None for r in rows)


def test_registries_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
