"""Every registered query on the smallest data set, next to its SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.plans import customer_segments
from millrace.plans.surrogates import Source, retail
from tools.check_oracles import multiset

FOLDER = entry.SMOKE_DIR
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in sorted(Path(FOLDER).glob("*.parquet")):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def physical_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    plan = physical_plan(df)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    rel = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert multiset(df.columns, rows) == multiset(list(rel.columns), rel.fetchall())


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["customerid", "returnratio", "frequency"]


def test_scan_reads_only_needed_columns(spark):
    plan = QUERIES["uc08_features"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "l_extendedprice" not in plan.split("== Physical Plan ==")[1]


def test_filters_reach_the_scan(spark):
    plan = physical_plan(customer_segments.features(retail(Source(spark, FOLDER))))
    assert "EqualTo(l_returnflag,R)" in plan and "IsNotNull(o_custkey)" in plan


def test_reviews_are_prepared_once_for_fit_and_prediction(spark, monkeypatch):
    from millrace.plans import spam_reviews

    made, plain = [], spam_reviews.preprocess
    monkeypatch.setattr(spam_reviews, "preprocess", lambda *a, **k: made.append(1) or plain(*a, **k))
    assert QUERIES["uc04_score"](spark, FOLDER).count() == 1
    assert len(made) == 1
