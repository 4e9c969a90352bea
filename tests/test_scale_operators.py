"""Operators that split hot groups must still give the plain answer."""

from __future__ import annotations

import hashlib
import math
import statistics
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import neighbours, quantiles, sampling, scaling
from millrace.session import materialise, owned_intermediates
from millrace.sources import numbering
from millrace.streaming import buckets


def md5(i, seed=42):
    return hashlib.md5(f"{i}-{seed}".encode()).hexdigest()


def classes(spark):
    """One class holds most rows, one a single row, one is NULL."""
    rows = [(i, "hot") for i in range(900)] + [(1000 + i, "warm") for i in range(97)] + [(2000, "one"), (3000, None), (3001, None)]
    return rows, spark.createDataFrame(rows, "id long, c string").repartition(5)


@pytest.mark.parametrize("p", [0.001, 0.1, 0.5, 1.0])
@pytest.mark.parametrize("prefix", [1, 4])
def test_stratified_sample_is_exact(spark, monkeypatch, p, prefix):
    monkeypatch.setattr(sampling, "_PREFIX", prefix)
    rows, df = classes(spark)
    got = sorted(r.id for r in sampling.stratified_sample(df, p, "id", "c").collect())
    want = []
    for c in {c for _, c in rows}:
        ids = sorted((i for i, x in rows if x == c), key=lambda i: (md5(i), i))
        want += ids[: math.ceil(p * len(ids))]
    assert got == sorted(want)
    assert sampling.stratified_sample(df, p, "id").count() == math.ceil(p * len(rows))


def test_balance_sample_counts_and_copies(spark):
    _, df = classes(spark)
    got = sampling.balance_sample(df, "id", "c")
    per_class = {r.c: (r.n, r.ids) for r in got.groupBy("c").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids")).collect()}
    assert per_class == {"hot": (250, 250), "warm": (250, 97), "one": (250, 1), None: (250, 2)}
    assert got.groupBy("id", "copy_no").count().filter("count > 1").isEmpty()
    spread = got.filter("c = 'warm'").groupBy("id").count().agg(F.min("count"), F.max("count")).first()
    assert spread[:] == (2, 3)


def test_balance_sample_when_sizes_divide_evenly(spark):
    df = spark.createDataFrame([(i, int(i < 10)) for i in range(50)], "id long, c int")
    counts = {r.c: r["count"] for r in sampling.balance_sample(df, "id", "c").groupBy("c").count().collect()}
    assert counts == {0: 25, 1: 25}


def test_many_classes_need_no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        test_balance_sample_counts_and_copies(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_repeated_rows_beyond_one_chunk(spark):
    df = spark.createDataFrame([("a", 5000), ("b", 0), ("c", 1)], "k string, copies int")
    got = sampling.repeat_rows(df, "copies", "no", ["k"])
    found = {r.k: (r.n, r.lo, r.hi) for r in got.groupBy("k").agg(F.count("*").alias("n"), F.min("no").alias("lo"), F.max("no").alias("hi")).collect()}
    assert found == {"a": (5000, 1, 5000), "c": (1, 1, 1)}


@pytest.mark.parametrize("accuracy", [50, 20_000])
def test_quantiles_match_numpy(spark, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "_ACCURACY", accuracy)
    rng = np.random.default_rng(6)
    groups = {
        "hot": rng.normal(size=3000), "ties": rng.integers(0, 3, 1001).astype(float), "pair": np.array([1.0, 4.0]),
        "one": np.array([5.0]), "same": np.full(777, 2.5),
    }
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    wanted = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q100": 1.0}
    for r in quantiles.grouped_quantiles(df, ["k"], "v", wanted).collect():
        assert [r[n] for n in wanted] == pytest.approx([np.quantile(groups[r.k], q) for q in wanted.values()])
    for r in quantiles.median_by_user_aggregate(df, ["k"], "v").collect():
        assert r.median == pytest.approx(statistics.median(groups[r.k]))


def test_wide_brackets_are_narrowed(spark):
    rng = np.random.default_rng(6)
    groups = {"many": rng.normal(size=9000), "ties": np.repeat([1.0, 2.0, 7.0], [2000, 3000, 1500]), "skewed": np.exp(rng.normal(size=4000) * 9), "few": np.array([3.0, 1.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double").repartition(5)
    wanted = {"q1": 0.01, "q25": 0.25, "q50": 0.5, "q99": 0.99}
    for r in quantiles.grouped_quantiles(df, ["k"], "v", wanted, most=60, accuracy=100).collect():
        assert [r[n] for n in wanted] == pytest.approx([np.quantile(groups[r.k], q) for q in wanted.values()])
    left = quantiles._bracketed_counts(df, ["k"], "v", [0.5], most=60, accuracy=100).groupBy("k").count().collect()
    assert max(r["count"] for r in left) <= 60 + 8
    wide = quantiles._bracketed_counts(df, ["k"], "v", [0.5], most=1 << 20, accuracy=100).groupBy("k").count().collect()
    assert max(r["count"] for r in wide) > 300


def test_row_ids_follow_the_order(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, i) for i in range(1000)], "k int, v int").repartition(7)
    got = numbering.row_ids(df, ["k"]).collect()
    assert sorted((r.row_id, r.k) for r in got) == [(i + 1, i) for i in range(1000)]


@pytest.mark.parametrize("rows", [17, 1000])
def test_knn_equals_brute_force(spark, rows):
    rng = np.random.default_rng(2)
    points = np.vstack([rng.normal(size=(120, 3)), np.zeros((30, 3))])  # with many equal points
    items = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vec array<double>").repartition(5)
    queries = items.filter("id < 20 OR id > 140")
    got = neighbours.knn(items, queries, 4, block_rows=rows).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append(r.item_id)
    for q, hits in found.items():
        d = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
        assert hits == sorted(range(150), key=lambda i: (d[i], i))[:4]
    assert len(found) == queries.count()


@pytest.mark.parametrize("part_rows", [7, 40, 1000])
def test_knn_in_parts_is_exact_and_looks_at_few(spark, part_rows):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 4)) * 20
    points = np.vstack([c + rng.normal(size=(60, 4)) for c in centres] + [np.tile(centres[0], (25, 1))])
    items = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vec array<double>").repartition(4)
    queries = spark.createDataFrame([(10_000 + i, (p + 0.01).tolist()) for i, p in enumerate(points[::9])], "id long, vec array<double>")
    found = {}
    for r in sorted(neighbours.knn(items, queries, 6, block_rows=30, part_rows=part_rows).collect(), key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.item_id, r.distance))
    for i, p in enumerate(points[::9] + 0.01):
        d = np.sqrt(((points - p) ** 2).sum(axis=1))
        want = sorted(range(len(points)), key=lambda j: (d[j], j))[:6]
        assert [j for j, _ in found[10_000 + i]] == want and [x for _, x in found[10_000 + i]] == pytest.approx(d[want])
    if part_rows < 1000:
        share = neighbours.compared(items, queries, 6, block_rows=30, part_rows=part_rows).first()
        assert share.all_pairs == len(found) * len(points) and share.pairs < 0.2 * share.all_pairs
    few = items.filter("id < 3")
    assert neighbours.knn(few, queries, 6, part_rows=1).count() == 3 * len(found)
    assert neighbours.knn(items.limit(0), queries, 6).count() == neighbours.knn(items, queries.limit(0), 6).count() == 0


def test_adasyn_fills_the_minority(spark):
    rng = np.random.default_rng(5)
    majority, minority = rng.uniform(-1, 1, (200, 2)), rng.uniform(-0.5, 0.5, (20, 2))
    rows = [(i, *map(float, p), 0) for i, p in enumerate(majority)] + [(500 + i, *map(float, p), 1) for i, p in enumerate(minority)]
    df = spark.createDataFrame(rows, "id long, x double, y double, label int")
    got = neighbours.adasyn(df, "id", ["x", "y"], "label")
    kept = got.groupBy("label", "synthetic").count().collect()
    counts = {(r.label, r.synthetic): r["count"] for r in kept}
    assert counts[0, False] == 200 and counts[1, False] == 20
    assert abs(counts[1, True] - 180) <= 20  # rounding per row
    box = got.filter("synthetic").agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0]
    assert box <= 0.5  # between minority rows
    again = neighbours.adasyn(df.repartition(3), "id", ["x", "y"], "label")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


def test_scaling_of_constant_and_unseen_values(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    params = scaling.minmax_fit(train, ["a", "b"])
    new = spark.createDataFrame([(5.0, 6.0)], "a double, b double")
    assert scaling.minmax_apply(new, params, ["a", "b"]).first()[:] == (2.0, 0.0)
    params = scaling.standard_fit(train, ["a", "b"])
    assert scaling.standard_apply(new, params, ["a", "b"]).first()[:] == pytest.approx((3 / math.sqrt(2), 0.0))


def test_intermediates_of_a_block_are_removed(spark):
    with owned_intermediates(spark) as folder:
        assert materialise(spark.range(5)).count() == 5
        assert list(Path(folder).iterdir())
    assert not Path(folder).exists()
    assert materialise(spark.range(3)).count() == 3  # outside a block they stay


def test_days_of_equal_times_and_negative_ties(spark):
    rows = [("2024-05-01 10:00:00", -3, 1.0), ("2024-05-01 10:00:00", 2, 4.0), ("2024-05-01 10:00:00", None, 0.5), ("2024-05-01 09:00:00", 9, 0.25)]
    df = spark.createDataFrame(rows, "ts string, tie long, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    made = buckets.daily_change(df, [], "ts", "v", "tie")
    assert made.first().value == 3.75
    assert "SortAggregate" not in made._jdf.queryExecution().executedPlan().toString()
