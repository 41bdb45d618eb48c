"""Every registered query against its DuckDB oracle on the smallest tables,
and the driver entry points."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_mod
from rolevec.catalog import QUERIES, oracle_sql

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return repr(v)


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_mod.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    rel = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _canon(df.columns, rows) == _canon(rel.columns, rel.fetchall())


def test_entry(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["role", "level", "slot", "motion", "value"]
    assert df.count() > 0
