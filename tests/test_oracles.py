"""Every feed query with an oracle equals it, row for row, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from feedloom.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(rows):
    show = lambda v: str(v)[:10] if hasattr(v, "isoformat") and not hasattr(v, "hour") else str(v)
    return sorted(tuple(map(show, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.sql(ORACLES[name])
    assert sorted(found.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert plain(map(tuple, df.select(*columns).collect())) == plain(duck.sql(f"select {quoted} from ({ORACLES[name]})").fetchall())


def test_every_query_has_an_oracle():
    assert sorted(QUERIES) == sorted(ORACLES)
