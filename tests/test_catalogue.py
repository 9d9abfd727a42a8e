"""Every query of the catalogue against its SQL twin in DuckDB."""

import math
import os

import duckdb
import pytest

from strandloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "customer part supplier orders lineitem events nation".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(frame):
    def cell(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, float):
            return str(int(v)) if v == math.floor(v) else f"{v:.9g}"
        return str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(cell, r)) for r in frame.where(frame.notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, duck, name):
    found = catalogue.queries()[name](spark, DATA).toPandas()
    sql = catalogue.oracle_sql().get(name)
    assert len(found)
    if sql:
        want = duck.sql(sql).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert rows(found) == rows(want)
