"""Registered queries with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from rolevec.llm.oracle import ORACLE
from rolevec.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    key = lambda r: tuple(map(repr, r))
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == sorted(want.fetchall(), key=key)
