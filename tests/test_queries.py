"""Every registered query of the engine against its own DuckDB statement, on whole small tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from tidemark import queries as q


def rows(df):
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple("null" if not isinstance(x, (list, tuple)) and pd.isna(x) else f"{x:.5f}" if isinstance(x, float) else str(x) for x in r))
    return sorted(out)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return c


def close(a, b):
    if a == b:
        return True
    try:
        return math.isclose(float(a), float(b), rel_tol=1e-6, abs_tol=2e-5)
    except ValueError:
        return False


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_against_sql(name, spark, sf, duck):
    got, want = q.QUERIES[name](spark, sf).toPandas(), duck.sql(q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert all(close(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True)), [(r, s) for r, s in zip(a, b, strict=True) if r != s][:3]


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_runs(name, spark, sf):
    """Each of these is held against a plain version in test_engine; here its rows come out whole."""
    large = name in ("rule_induction", "rule_paths")  # too few failures for a rule in the smallest tables
    df = q.QUERIES[name](spark, sf.replace("sf0.001", "sf0.01") if large else sf)
    got = df.collect()
    assert got and all(len(r) == len(df.columns) for r in got)


def test_fact_table_is_one_narrow_scan(spark, sf):
    from tidemark.sources.tables import observations

    plan = observations(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1
