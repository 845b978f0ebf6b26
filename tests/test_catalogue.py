"""Every catalogue query against its SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from corpusloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return tuple(map(plain, v))
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 8) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else v


def rows(df, columns):
    return sorted((tuple(map(plain, r)) for r in df[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, sf, con, name):
    got, want = catalogue.QUERIES[name](spark, sf).toPandas(), con.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_hybrid_search_embeds_documents_once(spark, sf):
    """Filters on a vector that a function makes call the function again; the vectors are a table."""
    dense, _ = catalogue._two_legs(spark, sf)
    assert "ArrowEvalPython" not in dense._jdf.queryExecution().executedPlan().toString()
    assert dense.count() > 0
