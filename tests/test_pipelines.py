"""Use cases on small tables with the declared schemas, and the end-to-end runner."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.plans import customer_segments, payment_fraud, product_ratings, runs, store_forecast, trip_types
from millrace.plans.runner import STAGES, USE_CASES, Run, run_all
from millrace.sources.schemas import TABLES
from millrace.sources.tables import size_text


def table(spark, name, split, rows):
    schema = TABLES[name].schema(split)
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def orders(spark, rows, split="score"):
    return table(spark, "order", split, rows)


def test_returns_fan_out_over_duplicate_pairs(spark):
    d = dt.date(2024, 1, 1)
    t = {
        "lineitem": spark.createDataFrame([(1, 7, 2, 10.0), (1, 7, 1, 20.0), (1, 8, 1, 5.0), (2, 7, 1, 4.0), (3, 7, 1, 9.0)],
                                          "li_order_id int, li_product_id int, quantity int, price double"),
        "order_returns": spark.createDataFrame([(1, 7, 1), (1, 7, None)], "or_order_id int, or_product_id int, or_return_quantity int"),
        "order": orders(spark, [(1, 100, None, d, 1), (2, 100, None, dt.date(2023, 5, 5), 1), (3, None, None, d, 1)]),
    }
    got = customer_segments.features(t).collect()
    # both lines of (1, 7) meet both returns: bought 2 * (20 + 20) + 5, returned 1 * (10 + 20)
    assert [r.customerid for r in got] == [100]
    assert got[0].returnratio == pytest.approx((30 / 85 + 0) / 2)
    assert got[0].frequency == 1.0


def test_worthless_orders_fail_or_are_skipped(spark):
    t = {
        "lineitem": spark.createDataFrame([(1, 7, 0, 10.0)], "li_order_id int, li_product_id int, quantity int, price double"),
        "order_returns": spark.createDataFrame([], "or_order_id int, or_product_id int, or_return_quantity int"),
        "order": orders(spark, [(1, 100, None, dt.date(2024, 1, 1), 1)]),
    }
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        customer_segments.features(t).collect()
    assert customer_segments.features(t, zero_price="null").first().returnratio is None


def test_weeks_around_new_year(spark):
    days = [dt.date(2020, 12, 31), dt.date(2021, 1, 1), dt.date(2021, 1, 4), dt.date(2024, 12, 31), dt.date(2024, 1, 2)]
    t = {
        "order": orders(spark, [(i, 1, None, d, 5) for i, d in enumerate(days)]),
        "lineitem": spark.createDataFrame([(i, 1, 1, 10.0 ** i) for i in range(5)],
                                          "li_order_id int, li_product_id int, quantity int, price double"),
        "product": spark.createDataFrame([(1, "n", "Home & Garden")], "p_product_id int, name string, department string"),
    }
    got = {r.week_index: r.total_sales for r in store_forecast.weekly_sales(t).collect()}
    # week 53 of 2020 holds 1 January 2021; 31 December 2024 is week 1 and joins January 2024
    assert got == {1: 11.0, 2: 100.0, 3: 11000.0}
    assert {r.department_id for r in store_forecast.weekly_sales(t).collect()} == {"home_garden"}
    apart = {r.week_index: r.total_sales for r in store_forecast.weekly_sales(t, iso_year=True).collect()}
    assert apart == {1: 11.0, 2: 100.0, 3: 10000.0, 4: 1000.0}


def test_optional_labels(spark):
    rated = spark.createDataFrame([(1, 2, 3)], "userid int, productid int, rating int")
    assert product_ratings.preprocess(rated).columns == ["userid", "productid", "rating"]
    assert product_ratings.preprocess(rated.drop("rating"), shift=1).first()[:] == (2, 2)
    ts = dt.datetime(2024, 1, 1, 23)
    for split, row in (("train", (1, 5.0, "x", 9, "r", ts, True)), ("serve", (1, 5.0, "x", 9, "r", ts))):
        t = {
            "financial_transactions": table(spark, "financial_transactions", split, [row, (2, *row[1:3], 10, *row[4:])]),
            "financial_account": spark.createDataFrame([(9, 10.0)], "fa_customer_sk long, transaction_limit double"),
        }
        got = payment_fraud.preprocess(t).collect()
        assert [r[:3] for r in got] == [(1, 1.0, 0.5)]
        assert ("isfraud" in got[0]) == (split == "train")


def test_baskets_keep_and_drop_the_right_orders(spark):
    t = {
        "order": orders(spark, [(1, 1, None, dt.date(2024, 6, 2), 1), (2, 1, None, dt.date(2024, 6, 3), 1), (3, 1, None, dt.date(2024, 6, 3), 1)]),
        "product": spark.createDataFrame([(1, "n", "a"), (2, "n", "b"), (3, "n", "zz"), (4, "n", None)],
                                         "p_product_id int, name string, department string"),
        "lineitem": spark.createDataFrame([(1, 1, 2, 1.0), (1, 1, -1, 1.0), (1, 4, 5, 1.0), (2, 2, 3, 1.0), (3, 3, 1, 1.0), (9, 1, 1, 1.0)],
                                          "li_order_id int, li_product_id int, quantity int, price double"),
    }
    store_dept = spark.createDataFrame([(1, "b"), (2, "a"), (2, "b")], "store int, department string")
    index = trip_types.department_index(store_dept)
    assert sorted(tuple(r) for r in index.collect()) == [("a", 1), ("b", 2)]
    got = {r.o_order_id: r for r in trip_types.preprocess(t, index, store_dept).collect()}
    assert set(got) == {1, 2}  # order 3 buys in no listed department
    assert (got[1].scan_count_abs_sum, got[1].dept_1, got[1].dept_2, got[1].sunday) == (8, 1, 0, 1)
    assert (got[2].dept_1, got[2].dept_2, got[2].monday) == (0, 3, 1)
    only_a = index.where("dept_id = 1")  # fitted on a split that had no "b"
    assert [r.department for r in trip_types.unseen_departments(store_dept, only_a).collect()] == ["b"]
    assert set(r.o_order_id for r in trip_types.preprocess(t, only_a).collect()) == {1}


def test_every_department_gets_a_column(spark):
    names = [f"d{k:03d}" for k in range(80)]
    index = trip_types.department_index(spark.createDataFrame([(1, n) for n in names] + [(2, None)], "store int, department string"))
    t = {
        "order": orders(spark, [(k, 1, None, dt.date(2024, 6, 2), 1) for k in range(80)]),
        "product": spark.createDataFrame([(k, "n", n) for k, n in enumerate(names)], "p_product_id int, name string, department string"),
        "lineitem": spark.createDataFrame([(k, k, k + 1, 1.0) for k in range(80)], "li_order_id int, li_product_id int, quantity int, price double"),
    }
    got = {r.o_order_id: r for r in trip_types.preprocess(t, index).collect()}
    assert all(got[k][f"dept_{k + 1}"] == k + 1 for k in range(80))


def shop(spark, seed):
    """All tables of one split, small but complete."""
    rng = np.random.default_rng(seed)
    n, day0 = 160, dt.date(2022, 1, 3)
    order_days = [day0 + dt.timedelta(days=int(x)) for x in rng.integers(0, 300, n)]
    departments = ["Toys", "Home & Garden", "Food"]
    lines = [(o, int(p), int(q), 1.0 + int(p)) for o in range(n) for p, q in zip(rng.integers(0, 9, 3), rng.integers(1, 5, 3))]
    trip = [1 + sum(q for oo, p, q, _ in lines if oo == o and p % 3 == 0) // 3 for o in range(n)]
    smart = lambda bad: [float(x) for x in rng.normal(3.0 * bad, 1, 7)]
    days = [(i, day0 + dt.timedelta(days=i % 10), f"s{i // 10}", "m", int(i % 10 == 9)) for i in range(200)]
    reviews = [(i, i % 2, ("win cash prize " if i % 2 else "meeting at noon ") + f"note{i % 5}") for i in range(60)]
    payments = [(i, float(a), "x", i % 20, "r", dt.datetime(2024, 1, 1, int(h))) for i, (a, h) in enumerate(zip(rng.uniform(0, 10, 150), rng.integers(0, 24, 150)))]
    fraud = [(i, bool(a + rng.normal(0, 2) > 7)) for i, a, *_ in payments]
    u, v = rng.uniform(0.5, 1.5, (20, 2)), rng.uniform(0.5, 1.5, (15, 2))
    rating = [(i, j, int(np.clip(np.rint(u[i] @ v[j]), 1, 5))) for i in range(20) for j in range(15)]
    weeks = [(s, d, day0 + dt.timedelta(days=7 * w), 100.0 + w) for s in (1, 2) for d in departments for w in range(4)]
    raw = {
        "order": ([(o, o % 12, None, order_days[o], 1 + o % 2) for o in range(n)], trip),
        "lineitem": (lines, None),
        "order_returns": ([(o, p, 1) for o, p, _, _ in lines[::7]], None),
        "product": ([(p, f"p{p}", departments[p % 3]) for p in range(9)], None),
        "failures": ([(*row, *smart(row[4])) for row in days], None),
        "review": ([(i, t) for i, _, t in reviews], [s for _, s, _ in reviews]),
        "financial_account": ([(i, 10.0) for i in range(20)], None),
        "financial_transactions": (payments, [f for _, f in fraud]),
        "productrating": ([(a, b) for a, b, _ in rating], [c for *_, c in rating]),
    }
    labels = {
        "order_labels": [(o, trip[o]) for o in range(n)], "review_labels": [(i, s) for i, s, _ in reviews],
        "failures_labels": days, "financial_transactions_labels": fraud, "productrating_labels": rating,
        "store_dept_labels": weeks,
    }

    def split(name):
        made = {}
        for t, (rows, label) in raw.items():
            schema = TABLES[t].schema(name)
            if name == "train" and label is not None:
                rows = [(*r, x) for r, x in zip(rows, label)]
            made[t] = conform(spark, rows, schema)
        stores = [(s, d) for s in (1, 2) for d in departments]
        if name != "train":
            stores = [(*r, 2) for r in stores] + [(9, "Nowhere", 2)]
        made["store_dept"] = conform(spark, stores, TABLES["store_dept"].schema(name))
        if name == "score":
            made.update({t: conform(spark, rows, TABLES[t].schema(name)) for t, rows in labels.items()})
        return made

    return split


def conform(spark, rows, schema):
    loose = ", ".join(f"{f.name} {'double' if 'decimal' in f.dataType.simpleString() else f.dataType.simpleString()}" for f in schema)
    df = spark.createDataFrame([tuple(r) for r in rows], loose)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


@pytest.fixture(scope="module")
def full_run(spark, tmp_path_factory):
    settings = {"uc06": {"max_iter": 20}, "uc07": {"rank": 3, "iterations": 5}, "uc08": {"rounds": 1, "max_depth": 3}}
    run = Run(spark, shop(spark, 1), str(tmp_path_factory.mktemp("run")), settings=settings)
    return run_all(run)


def test_run_scores_every_use_case(full_run):
    scores = {r.usecase: r.evaluation_score for r in full_run.log.read("score_results").collect()}
    assert set(scores) == {1, 3, 4, 6, 7, 8, 10}
    assert scores[1] > 0 and scores[4] == 1.0 and scores[6] > 0.5 and scores[7] < 1 and scores[8] > 0.4 and scores[10] > 0.6


def test_run_serves_every_use_case(full_run):
    counts = {r.item_name: r.n_rows for r in full_run.log.artefacts(like="%\\_serve\\_results").collect()}
    assert counts == {"uc01_serve_results": 12, "uc03_serve_results": 12, "uc04_serve_results": 60, "uc06_serve_results": 200,
                      "uc07_serve_results": 300, "uc08_serve_results": 160, "uc10_serve_results": 150}
    assert full_run.load("uc03_serve_unmatched").collect()[0][:] == ("9", "nowhere")
    assert full_run.log.artefacts(like="uc03%", not_like="%\\_results").filter("item_name = 'uc03_model'").first().n_rows == 6


def test_run_is_timed_and_snapshot(spark, full_run, tmp_path):
    timings = full_run.log.read("timeit")
    assert {r.use_case for r in timings.collect()} == set(USE_CASES)
    total = full_run.log.snapshot("sf1", str(tmp_path)).first()
    assert total.seconds > 0 and len(total.total) == len("00:00:00.000000")
    assert [r.id for r in spark.read.parquet(str(tmp_path / "sf1_score_results")).orderBy("date_time").collect()] == list(range(1, 8))


def test_training_only_and_isolated_outputs(spark, full_run, tmp_path):
    run = run_all(Run(spark, shop(spark, 2), str(tmp_path), stages=("preprocess", "train"), suffix=""), ["uc10"])
    assert {r.item_name for r in run.log.artefacts().collect()} == {"uc10_train_preprocessed", "uc10_model"}
    with pytest.raises(ValueError, match="deploy"):
        Run(spark, shop(spark, 2), str(tmp_path), stages=(*STAGES, "deploy"))


def test_serving_alone_from_stored_models(spark, full_run):
    again = Run(spark, shop(spark, 1), full_run.folder, stages=("serve",), suffix="_2", settings=full_run.settings)
    run_all(again, ["uc06", "uc08", "uc10"])
    for name in ("uc06_serve_results", "uc08_serve_results", "uc10_serve_results"):
        first, second = full_run.load(name), full_run.load(f"{name}_2")
        assert first.exceptAll(second).isEmpty() and first.count() == second.count()


def test_comparisons_between_runs(spark):
    def timed(seconds):
        return spark.createDataFrame([("uc01", "train", float(seconds))], "use_case string, step string, seconds double")

    got = runs.compare_durations({"sf1": timed(2), "sf5": timed(7.5)}).first()
    assert (got.sf5_sf1_ratio, got.sf5_sf1_percentage_change, got.sf5_duration) == (3.75, 275.0, "00:00:07.500000")

    def scored(x):
        return spark.createDataFrame([(1, x)], "usecase int, evaluation_score double")

    assert runs.compare_scores({"sf1": scored(0.5), "sf5": scored(0.4)}).first().sf5_to_sf1_percentage == "-20.00%"
    sizes = {n: spark.createDataFrame([("m", ["a"], 1, i, f"{i} bytes")], runs.ARTEFACTS) for n, i in (("sf1", 3), ("sf5", 9))}
    assert runs.compare_sizes(sizes).first()[:] == ("m", 3, 9, "3 bytes", "9 bytes")


def test_size_texts():
    texts = {0: "0 bytes", 10239: "10239 bytes", 10240: "10 kB", 626 * 1024**2: "626 MB", 3 * 1024**4: "3072 GB"}
    assert {n: size_text(n) for n in texts} == texts


def test_results_are_views(spark, full_run):
    assert spark.sql("SELECT count(*) FROM uc10_serve_results WHERE prediction IS NOT NULL").first()[0] == 150
