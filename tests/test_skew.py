"""A third of all rows on one key, no broadcast, and skew splitting forced: same answers."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracles import multiset

# table -> columns that take one value on every third row
HOT = {
    "lineitem": {"l_orderkey": "7", "l_partkey": "11"},
    "orders": {"o_custkey": "5"},
    "events": {"user_id": "3", "event_type": "'error'"},
    "documents": {"text": "'spam spam ham zebra eggs'"},
}
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4096",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16384",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}
QUERIES = [
    "uc01_features", "uc03_weekly", "uc04_predict", "uc06_features", "uc06_balanced", "uc07_dot", "uc08_features",
    "uc10_features", "stratified_sample", "balance_sample", "median_by_group", "run_stats", "dedup_keep_first",
    "row_ids", "geo_pair_distance", "dq_foreign_key",
]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for path in sorted(Path(entry.SMOKE_DIR).glob("*.parquet")):
        changed = ", ".join(f"CASE WHEN rn % 3 = 0 THEN {v} ELSE {c} END AS {c}" for c, v in HOT.get(path.stem, {}).items())
        columns = f"* EXCLUDE (rn) REPLACE ({changed})" if changed else "* EXCLUDE (rn)"
        out = folder / path.name
        con.sql(f"COPY (SELECT {columns} FROM (SELECT *, row_number() OVER () rn FROM '{path}')) TO '{out}' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{out}'")
    return str(folder), con


@pytest.fixture
def no_broadcast(spark):
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows_under_skew(spark, skewed, no_broadcast, name):
    folder, con = skewed
    df = entry.queries()[name](spark, folder)
    rel = con.sql(entry.oracle_sql()[name])
    assert multiset(df.columns, [tuple(r) for r in df.collect()]) == multiset(list(rel.columns), rel.fetchall())
