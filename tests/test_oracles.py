"""Every query with an oracle against DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from surfaceloom.oracles import oracles
from surfaceloom.queries import queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no test tables here")
ORACLES, QUERIES = oracles(), queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("pages", "events", "documents"):
        con.sql(f"create view {name} as select * from '{DIR}/{name}.parquet'")
    return con


def rows(df):
    return sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def test_every_query_has_an_oracle_but_the_capped_merge():
    assert set(QUERIES) - set(ORACLES) == {"j5_capped_merge"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got, expected = QUERIES[name](spark, DIR).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
