"""Every query against its SQL, on whole tables at the smallest scale."""

import datetime as dt
import glob
import math
import os

import duckdb
import pytest

from gridwright.plans import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    got = ordered(tuple(cell(r[c]) for c in names) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    cur = duck.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    want = ordered(tuple(cell(r[i]) for i in at) for r in cur.fetchall())
    assert got == want


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
