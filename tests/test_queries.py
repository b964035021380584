"""Registered queries against their SQL twins on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from burstline.plans.oracle import ORACLE
from burstline.plans.queries import QUERIES

TABLES = "documents pages benchmark events".split()
# the others share these steps; every query is compared at a larger scale by the driver
CHECKED = ["token_bag", "raw_ingest", "raw_rejects", "anchored_windows", "top_terms", "profile_distance", "topics"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    want = duck.sql(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    rows = [f[cols].astype(str).sort_values(cols).values.tolist() for f in (got, want)]
    assert rows[0] == rows[1]
