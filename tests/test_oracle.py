"""Every registered query against its DuckDB oracle on the smallest scale."""

import os

import duckdb
import pytest

from conftest import SF_SMALL
from oracle_check import TABLES, frame_hash

import __spark_entry__ as E

NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert frame_hash(got) == frame_hash(want)


def test_every_query_has_a_callable(spark):
    qs = E.queries()
    assert set(E.oracle_sql()) <= set(qs)
    assert E.entry(spark).count() >= 0
