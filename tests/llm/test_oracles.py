"""Queries of the corpus operators against their SQL."""

import glob
import math
import os

import duckdb
import pytest

from kinelake.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    a = sorted((tuple(r[c] for c in sorted(columns)) for r in got.collect()), key=str)
    b = sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in want.fetchall()), key=str)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(u == v or isinstance(u, float) and math.isclose(u, v, abs_tol=2e-6) for u, v in zip(x, y)), (x, y)
