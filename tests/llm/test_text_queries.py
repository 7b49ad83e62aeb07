"""Text queries against their SQL, over whole tables."""

import glob
import os

import duckdb
import pytest

from tidemark.llm.queries import ORACLES, QUERIES
from tools.check import canonical

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert {d[0]: str(d[1]) for d in cur.description} == {c: TYPES[t] for c, t in df.dtypes}
    assert canonical(df.columns, got) == canonical(cols, cur.fetchall())


def test_operators_are_registered():
    assert {int(n.split("_")[0][2:]) for n in QUERIES} == set(range(1, 14))
