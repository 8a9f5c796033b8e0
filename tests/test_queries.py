"""Every registered query against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from siftspark import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "asDict") or isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(v) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, duck, sf_dir):
    df = catalog.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in catalog.SQL:
        assert df.columns
        return
    r = duck.execute(catalog.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    want = [tuple(plain(x[i]) for i in at) for x in r.fetchall()]
    assert sorted(map(repr, (tuple(plain(v) for v in x) for x in rows))) == sorted(map(repr, want))


def test_entry_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["query", "chunk", "score", "rank"]


def test_nothing_else_imports_the_optional_part():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "siftspark")):
        if os.sep + "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    assert "llm" not in open(os.path.join(folder, f), encoding="utf-8").read()
