"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import numpy as np
import pytest

from tarnfold.plans import queries as core
from tarnfold.plans import indexes, rules, streams, traces  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return [str(x) for x in v]
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if v is None or str(v) in ("NaT", "<NA>", "nan"):
        return None
    return float(v) if isinstance(v, (int, float, np.integer, np.floating)) else v


def rows(df):
    return sorted(str(tuple(plain(v) for v in r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_same_as_sql(spark, db, name):
    got, want = core.QUERIES[name](spark, SF).toPandas(), db.sql(core.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_gives_rows(spark, name):
    assert core.QUERIES[name](spark, SF).count() > 0
