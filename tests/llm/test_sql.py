"""The registered queries that SQL can express, against it, over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from helixtally.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df, rel = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM rel").fetchall()
    key = lambda r: tuple("" if v is None else f"{v:.6f}" if isinstance(v, float) and math.isfinite(v) else str(v) for v in r)
    assert sorted(map(key, df.select(*cols).collect())) == sorted(map(key, want))
