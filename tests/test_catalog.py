"""Every named query against its SQL on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parents[1] / "tools"))

import compare  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from taskloom.plans.catalog import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
WITHOUT_SQL: set[str] = set()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in compare.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_sql_for_all_but_the_listed():
    assert set(QUERIES) - set(entry.oracle_sql()) == WITHOUT_SQL
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    ours = compare.rows_of(df.columns, df.collect())
    if name in WITHOUT_SQL:
        assert ours
        return
    answer = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    assert sorted(columns) == sorted(df.columns)
    assert ours == compare.rows_of(columns, answer.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
