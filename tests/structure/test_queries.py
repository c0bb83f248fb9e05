"""Every registered structure query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from strandex.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def rows(pdf, columns):
    text = lambda v: None if pd.isna(v) else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    return sorted((tuple(map(text, r)) for r in pdf[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, tables, name):
    want = tables.sql(ORACLES[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    assert set(got.columns) == set(want.columns)
    assert rows(got, list(want.columns)) == rows(want, list(want.columns))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["radius_pairs", "sel_within", "disulfide"])
def test_no_nested_loops(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
