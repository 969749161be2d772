"""Every registered query of the engine's own operators against its SQL, on the smallest tables."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

from millrace.plans import queries

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(columns, values):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{float(v):.7g}" if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else str(v).removesuffix("+00:00")

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(cell(r[i]) for i in order) for r in values])


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, D)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in queries.SQL:
        r = con.sql(queries.SQL[name])
        want = rows(r.columns, r.fetchall())
        assert got[0] == want[0]
        assert len(got[1]) == len(want[1])
        different = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
        assert not different, different[:3]
    else:
        assert got[1]
