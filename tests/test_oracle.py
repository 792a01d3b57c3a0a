"""Every registered query against its DuckDB oracle at sf0.001 (the driver's check, locally)."""

import datetime
import decimal
import math

import duckdb
import pytest

from verdigris.plans import registry

from conftest import SF0001

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]
ORACLES = registry.oracle_sql()
QUERIES = registry.queries()


def norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (2, str(v))
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        return (1, "nan" if math.isnan(f) else repr(f))
    if isinstance(v, datetime.datetime):
        return (5, v.replace(tzinfo=None).isoformat())
    if isinstance(v, (list, tuple)):
        return (3, tuple(norm(x) for x in v))
    return (6, str(v))


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF0001)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLES[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert canon(df.columns, rows) == canon(ocols, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_oracle(spark, name):
    df = QUERIES[name](spark, SF0001)
    df.collect()
    assert len(df.columns) > 0


def test_entry(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
