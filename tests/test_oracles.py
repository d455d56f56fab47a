"""Every registered query of the domain against its DuckDB SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from skyloom import frame_queries, scalar_queries, stream_queries, table_queries, target_queries  # noqa: F401
from skyloom.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def text(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return "null"
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    a, b = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    order = sorted(a.columns)
    rows = lambda d: sorted(tuple(map(text, r)) for r in d[order].astype(object).values.tolist())
    assert len(a) and rows(a) == rows(b)
