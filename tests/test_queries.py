"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{tiny}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if v is None or v != v:
            return "~"
        if isinstance(v, bool):
            return str(int(v))
        if isinstance(v, float):
            return f"{v:.6g}"
        if hasattr(v, "isoformat"):
            return v.isoformat()[:19].replace("T00:00:00", "")
        if isinstance(v, list):
            return str([one(x) for x in v])
        return str(v)

    return [columns[i] for i in order], sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, tiny, name):
    df = QUERIES[name](spark, tiny)
    cur = duck.execute(SQL[name])
    want = canon([c[0] for c in cur.description], cur.fetchall())
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, tiny, name):
    rows = QUERIES[name](spark, tiny).collect()
    assert all(len(r) == len(rows[0]) for r in rows)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[0] == "entity_id"
