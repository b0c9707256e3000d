"""Every query with SQL, against DuckDB over the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def canon(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    got = QUERIES[name](spark, sf_dir)
    want = con.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = lambda table: sorted((tuple(canon(r[c]) for c in order) for r in table), key=str)
    theirs = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    mine = rows([r.asDict() for r in got.collect()])
    assert mine == rows(theirs) and mine


def test_entry(spark):
    assert entry.entry(spark).count() == 8
