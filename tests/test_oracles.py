"""Every query against its SQL form; those without one run on the smallest tables and have their twins."""

import math
import os

import duckdb
import numpy as np
import pytest

from cuespark import queries  # noqa: F401  fills the registry
from cuespark.registry import ORACLES, QUERIES

SMALLEST, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"  # the latter has cases that the smallest lacks


def norm(v):
    if v is None or isinstance(v, float | np.floating) and math.isnan(v):
        return "null"
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    if isinstance(v, float | np.floating):
        return repr(round(float(v), 9) + 0.0)
    return str(int(v)) if isinstance(v, int | np.integer) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF if name in ORACLES else SMALLEST).toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    want = con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda f: sorted(tuple(norm(v) for v in r) for r in f[sorted(f.columns)].astype(object).itertuples(index=False, name=None))
    assert rows(got) == rows(want)
