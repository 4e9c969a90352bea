"""Model fits on planted data: better than the trivial answer, and repeatable."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from millrace.functions import digests
from millrace.operators import arima, boosting, clustering, factorisation, kernel_svm, logistic, metrics, naive_bayes
from millrace.plans import device_failures, product_ratings, spam_reviews


def frame(spark, columns: dict):
    names = list(columns)
    rows = [tuple(x.item() if hasattr(x, "item") else x for x in row) for row in zip(*columns.values())]
    return spark.createDataFrame(rows, names)


def test_kmeans_finds_blobs(spark):
    rng = np.random.default_rng(3)
    centres = np.array([[0.1, 0.1], [0.1, 0.9], [0.9, 0.1], [0.9, 0.9]])
    points = np.vstack([c + rng.normal(0, 0.02, (60, 2)) for c in centres])
    df = frame(spark, {"id": np.arange(len(points)), "x": points[:, 0], "y": points[:, 1]})
    found = clustering.fit(df, "id", ["x", "y"], k=4, seed=2)
    again = clustering.fit(df.repartition(7), "id", ["x", "y"], k=4, seed=2).first()["centroids"]
    assert np.allclose(again, found.first()["centroids"], atol=1e-12)
    same = frame(spark, {"id": np.arange(5), "x": np.ones(5)})
    assert clustering.fit(same, "id", ["x"], k=3).first()["centroids"] == [[1.0]]
    by_place = sorted(found.first()["centroids"], key=lambda c: [round(x, 1) for x in c])
    assert np.allclose(by_place, centres, atol=0.02)
    silhouette = clustering.simplified_silhouette(df, found, ["x", "y"]).first()[0]
    assert 0.95 < silhouette <= 1
    sizes = clustering.assign(df, found, ["x", "y"]).groupBy("cluster_id").count()
    assert {r["count"] for r in sizes.collect()} == {60}


def simulate(phi, theta, n, seed):
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 1, n)
    d = np.zeros(n)
    for t in range(1, n):
        d[t] = phi * d[t - 1] + e[t] + theta * e[t - 1]
    return 100 + np.cumsum(d)


def test_arima_recovers_coefficients_and_survives_odd_series(spark):
    long = simulate(0.6, 0.3, 600, 5)
    rows = [("long", t, float(v)) for t, v in enumerate(long)]
    rows += [("flat", t, 7.0) for t in range(20)] + [("short", t, float(t)) for t in range(3)]
    series = spark.createDataFrame(rows, "k string, t int, y double").repartition(4)
    model = arima.fit(series, ["k"], "t", "y")
    by_key = {r.k: r for r in model.collect()}
    assert by_key["long"].phi == pytest.approx(0.6, abs=0.12)
    assert by_key["long"].theta == pytest.approx(0.3, abs=0.15)
    assert by_key["short"].phi is None and by_key["short"].n_obs == 3
    made = arima.forecast(model, ["k"], 3).collect()
    assert {r.k for r in made} == {"long", "flat"}
    assert [r.forecast for r in sorted(made, key=lambda r: r.week_index) if r.k == "flat"] == pytest.approx([7, 7, 7])
    m = by_key["long"]
    step, level = m.phi * m.last_diff + m.theta * m.last_residual, m.last_value
    for r in sorted((r for r in made if r.k == "long"), key=lambda r: r.week_index):
        level += step
        step *= m.phi
        assert r.forecast == pytest.approx(level)


def test_naive_bayes_probabilities_and_edge_documents(spark):
    train = spark.createDataFrame(
        [(1, 1, "win cash now"), (2, 1, "cash cash prize"), (3, 0, "meeting at noon"), (4, 0, "lunch at noon")],
        "id int, spam int, text string",
    )
    prepared = spam_reviews.preprocess(train, stem=False)
    model, priors = spam_reviews.train(prepared)
    assert model.agg(F.sum("spam_prob"), F.sum("non_spam_prob")).first()[:] == pytest.approx((1, 1))
    cash = model.filter("token = 'cash'").first()
    assert (cash.spam_prob, cash.non_spam_prob) == pytest.approx(((3 + 1) / (6 + 8), 1 / (6 + 8)))
    new = spark.createDataFrame([(10, "cash prize"), (11, "!!!"), (12, "zebra"), (13, "noon lunch"), (14, None)], "id int, text string")
    made = {r.id: r for r in spam_reviews.predict(spam_reviews.preprocess(new, stem=False), model, priors).collect()}
    assert set(made) == {10, 12, 13}  # no row without tokens
    assert made[10].predicted_spam == 1 and made[13].predicted_spam == 0
    assert made[12].log_spam_score == pytest.approx(math.log(0.5)) and made[12].predicted_spam == 0


def test_naive_bayes_rare_tokens_take_the_shuffled_path(spark, monkeypatch):
    monkeypatch.setattr(naive_bayes, "_COMMON", 0.2)
    test_naive_bayes_probabilities_and_edge_documents(spark)


def test_stemmed_tokens(spark):
    df = spark.createDataFrame([(1, "Running dogs\tbark"), (2, ""), (3, None), (4, "12 cats")], "id int, text string")
    found = {r.id: r.text for r in spam_reviews.preprocess(df).collect()}
    assert found == {1: ["run", "dogs\tbark"], 2: None, 3: None, 4: ["12", "cat"]}


def rings(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    minority = np.arange(n) % 10 == 0
    radius = np.where(minority, 1.0, 2.5) + rng.normal(0, 0.1, n)
    angle = rng.uniform(0, 2 * np.pi, n)
    return frame(spark, {"id": np.arange(n), "x": radius * np.cos(angle), "y": radius * np.sin(angle), "label": minority.astype(int)})


def test_kernel_svm_separates_rings(spark):
    df = rings(spark)
    model = kernel_svm.fit(df, ["x", "y"], "label", gamma=0.5, reg_param=0.01)
    made = kernel_svm.predict(df, model, "id").join(df, "id")
    assert metrics.mcc(made, "prediction", "label").first()[0] > 0.95
    assert kernel_svm.component_table(spark, model).count() == 100
    assert kernel_svm.predict(df.withColumn("x", F.lit(None)), model, "id").filter("prediction IS NOT NULL").count() == 0


def test_device_failures_rules(spark):
    rows = [(1, "2024-01-01", "a", "m", 0), (2, "2024-01-02", "a", "m", 0), (3, "2024-01-03", "a", "m", 1),
            (4, "2024-01-01", "b", "m", 0), (5, "2024-01-02", "b", "m", 0), (6, "2024-01-01", None, "m", 1)]
    df = spark.createDataFrame(rows, "id int, date string, serial_number string, model string, failure int")
    df = df.withColumn("date", F.to_date("date"))
    made = {r.id: (r.ttf_int, r.failure) for r in device_failures.preprocess(df, "train").collect()}
    assert made == {1: (2, 0), 2: (1, 1), 3: (0, 1)}
    assert device_failures.preprocess(df, "serve") is df
    with pytest.raises(ValueError):
        device_failures.preprocess(df, "other")
    with pytest.raises(ValueError, match="smart_10_raw"):
        device_failures.balance_and_scale(df)


def test_factorisation_beats_the_mean_and_falls_back(spark):
    rng = np.random.default_rng(9)
    u, v = rng.uniform(0.4, 1.3, (40, 3)), rng.uniform(0.4, 1.3, (30, 3))
    full = np.clip(np.rint(u @ v.T), 1, 5)
    cells = [(i, j, float(full[i, j])) for i in range(40) for j in range(30)]
    ratings = spark.createDataFrame(cells, "userid int, productid int, rating double")
    held = F.pmod(F.xxhash64("userid", "productid"), F.lit(5)) == 0
    train, test = ratings.filter(~held), ratings.filter(held)
    factors = product_ratings.train(train, rank=3, iterations=10, reg_param=0.02)
    made = product_ratings.predict(test.drop("rating"), factors, train)
    mean = train.agg(F.avg("rating")).first()[0]
    error = product_ratings.score(made, test).first()[0]
    assert error < test.agg(F.avg(F.abs(F.col("rating") - mean))).first()[0] * 0.7
    unknown = spark.createDataFrame([(999, 1), (1, 999)], "userid int, productid int")
    assert {r.prediction for r in product_ratings.predict(unknown, factors, train).collect()} == {float(round(mean))}


@pytest.mark.parametrize("block_rows", [3, 1000])
def test_block_product_equals_numpy(spark, block_rows):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(11, 4)), rng.normal(size=(7, 4))
    left = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], "row_id long, vals array<double>")
    right = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(b)], "row_id long, vals array<double>")
    got = np.zeros((11, 7))
    for r in factorisation.matrix_multiply(left, right, block_rows).collect():
        got[r.row_id, r.col_id] = r.value
    assert np.allclose(got, a @ b.T)
    rows = factorisation.as_rows(factorisation.all_pairs(left, right, block_rows)).orderBy("row_id").collect()
    assert np.allclose([r.vals for r in rows], np.clip(np.rint(a @ b.T), 1, 5))


def test_boosted_trees_learn_the_deciding_column(spark):
    rng = np.random.default_rng(4)
    x, noise = rng.integers(0, 3, 300), rng.normal(size=300)
    df = frame(spark, {"id": np.arange(300), "a": x, "b": noise, "label": x * 10})
    model = boosting.fit(df, ["a", "b"], "label", rounds=3, max_depth=2)
    made = boosting.predict(df, model, "id").join(df, "id")
    assert model.labels == [0, 10, 20]
    assert metrics.accuracy(made, "class_label_predicted", "label").first()[0] > 0.98
    assert {r["class"]: r.recall for r in boosting.class_metrics(made, "class_label_predicted", "label").collect()}[20] > 0.95


def plain_boosting(x, y, cuts, rounds, depth, classes):
    """Softmax boosting over given cuts, row by row; (round, class, node, feature, cut) of every split, and the margins."""
    bins = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1)
    margins, splits = np.zeros((len(x), classes)), set()
    for r in range(rounds):
        e = np.exp(margins - margins.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        for k in range(classes):
            g, h, node = p[:, k] - (y == k), 2 * p[:, k] * (1 - p[:, k]), np.zeros(len(x), int)
            for level in range(depth):
                for n in range((1 << level) - 1, (1 << level + 1) - 1):
                    rows = np.flatnonzero(node == n)
                    best, at = 1e-6, None
                    for f in range(x.shape[1]):
                        for b in range(len(cuts[f])):
                            left = rows[bins[rows, f] <= b]
                            gl, hl, gt, ht = g[left].sum(), h[left].sum(), g[rows].sum(), h[rows].sum()
                            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                            if hl >= 1 and ht - hl >= 1 and gain > best + 1e-9:
                                best, at = gain, (f, b)
                    if at:
                        splits.add((r, k, n, at[0], float(cuts[at[0]][at[1]])))
                        node[rows] = 2 * n + 1 + (bins[rows, at[0]] > at[1])
            for n in np.unique(node):
                rows = node == n
                margins[rows, k] += -0.3 * g[rows].sum() / (h[rows].sum() + 1)
    return splits, margins


def test_boosted_trees_equal_plain_boosting(spark, tmp_path):
    rng = np.random.default_rng(7)
    n = 400
    x = np.stack([rng.integers(0, 9, n), rng.normal(size=n).round(1), np.zeros(n)], axis=1)
    y = (x[:, 0] > 4).astype(int) + (x[:, 1] > 0.4) * (rng.uniform(size=n) < 0.8)
    df = frame(spark, {"id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "same": x[:, 2], "label": y}).repartition(3)
    cuts = {"a": [1, 3, 4, 6], "b": [-1, -0.3, 0.4, 0.9], "same": [0.0]}
    splits, margins = plain_boosting(x, y, [np.array(c, float) for c in cuts.values()], 3, 3, 3)
    model = boosting.fit(df, list(cuts), "label", rounds=3, max_depth=3, cuts=cuts)
    found = {tuple(r) for r in boosting.nodes(spark, model).where("feature IS NOT NULL").select("round", "class", "node", "feature", "cut").collect()}
    assert found == splits
    boosting.save(spark, model, str(tmp_path / "m"))
    for m in (model, boosting.load(spark, str(tmp_path / "m"))):
        made = {r.id: r.class_label_predicted for r in boosting.predict(df, m, "id").collect()}
        assert [made[k] for k in range(n)] == margins.argmax(axis=1).tolist()
    nulls = df.withColumn("b", F.when(F.col("id") % 5 > 0, F.col("b"))).withColumn("label", F.when(F.col("id") % 7 > 0, F.col("label")))
    assert boosting.predict(nulls, boosting.fit(nulls, ["a", "b"], "label", rounds=2, subsample=0.7), "id").count() == n


def test_histograms_read_only_what_lies_outside_the_frequent_bins():
    rng = np.random.default_rng(3)
    n, widths = 500, [4, 2, 9]
    bins = np.stack([np.where(rng.random(n) < 0.1, rng.integers(0, w, n), w - 1) for w in widths]).astype(np.uint8)
    outside = boosting._outside(bins, widths)
    assert len(outside[0]) == (bins != np.array(widths, np.uint8)[:, None] - 1).sum() < n
    label = rng.integers(0, 2, n).astype(np.int32)
    block = boosting._with_gradients(bins, outside, label, rng.normal(size=(n, 2)), 0, 1.0, (1, 0))
    tree, slot = boosting.Tree.empty(2), np.array([-1, 0, -1, -1, -1, -1, -1, -1], np.int32)
    tree.feature[0], tree.bin[0] = 0, 2  # only the left child is summed
    found = dict(boosting._histograms(iter([block]), [tree, tree], 1, [slot, slot], widths))
    for k in range(2):
        for f, width in enumerate(widths):
            plain = np.zeros((1, width, 2), np.int64)
            for r in np.flatnonzero(bins[0] <= 2):
                plain[0, bins[f, r]] += [int(block[4][k, r]), int(block[5][k, r])]
            assert (found[k, f] == plain).all()


def test_boosting_fills_its_blocks(spark):
    """A pass costs a task and sums of its own for each block and partition; batches of 10,000 rows must not be blocks."""
    df = spark.range(0, 150_000, numPartitions=2).select((F.col("id") % 9).cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("_label"))
    found = boosting._blocks(df, ["x"], [np.arange(8.0)], 2).map(lambda b: (len(b[2]), b[0].shape)).collect()
    full, rest = boosting.BLOCK_ROWS, 75_000 % boosting.BLOCK_ROWS
    assert sorted(found) == [(rest, (1, rest))] * 2 + [(full, (1, full))] * 2 * (75_000 // full)
    many = spark.range(0, 1000, numPartitions=40).select(F.lit(1.0).alias("x"), F.lit(0).alias("_label"))
    assert boosting._blocks(many, ["x"], [np.arange(8.0)], 2).getNumPartitions() == 1


def test_rows_come_down_to_their_nodes():
    rng = np.random.default_rng(5)
    for depth, of in ((3, np.uint8), (8, np.uint16)):
        tree, bins = boosting.Tree.empty(depth), rng.integers(0, 6, (4, 300)).astype(np.uint8)
        for node in range((1 << depth) - 1):
            if rng.random() < 0.8 and (not node or tree.feature[(node - 1) // 2] >= 0):
                tree.feature[node], tree.bin[node] = rng.integers(0, 4), rng.integers(0, 5)
        for levels in (0, 2, depth):
            plain = np.zeros(300, int)
            for r in range(300):
                for _ in range(levels):
                    f = tree.feature[plain[r]]
                    plain[r] = plain[r] if f < 0 else 2 * plain[r] + 1 + (bins[f, r] > tree.bin[plain[r]])
            placed = tree.place(bins, levels)
            assert placed.dtype == of and (placed == plain).all()


def test_factors_solve_their_equations_on_a_hot_item(spark):
    rng = np.random.default_rng(9)
    rows = [(u, 1, float(rng.integers(1, 6))) for u in range(300)] + [(int(u), int(i), float(rng.integers(1, 6))) for u, i in zip(rng.integers(0, 300, 500), rng.integers(2, 60, 500))]
    ratings = spark.createDataFrame([*rows, (None, 3, 1.0), (5, 2, None)], "userid long, productid long, rating double").repartition(4)
    whole = factorisation.fit(ratings, rank=6, iterations=3)
    parts = factorisation.fit(ratings, rank=6, iterations=3, chunk=16, block_ratings=90)  # the hot item in many chunks and blocks
    for (users, items) in (whole, parts):
        off = factorisation.residuals(ratings, items, users, "productid", "userid")
        assert off.agg(F.max("residual")).first()[0] < 1e-9 and off.count() == items.count()
    a, b = ({r.id: r.features for r in side.collect()} for side in (whole[1], parts[1]))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)
    named = ratings.select(F.concat(F.lit("u"), "userid").alias("userid"), "productid", "rating")
    assert factorisation.fit(named, rank=2, iterations=1)[0].schema["id"].dataType.simpleString() == "string"


def test_factorisation_removes_what_it_sent(spark, monkeypatch):
    """Disk must not grow with the sweeps, and residuals must not lay out a row for each number of each rating."""
    cells = [(k % 40, k * 7 % 31, float(k % 5 + 1)) for k in range(600)]
    ratings = spark.createDataFrame(cells, "userid long, productid long, rating double")
    whole = factorisation.fit(ratings, rank=3, iterations=2)

    def files() -> int:
        disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return disk.getAllFiles().mkString(" ").count("shuffle_")

    monkeypatch.setattr(factorisation, "PHASE_BYTES", 1 << 11)  # a few blocks at a time
    left = []
    for sweeps in (1, 2):
        before = files()
        parts = factorisation.fit(ratings, rank=3, iterations=sweeps, block_ratings=150)
        left.append(files() - before)
    assert left[1] <= left[0] + 4
    for a, b in zip(whole, parts, strict=True):
        a, b = ({r.id: r.features for r in side.collect()} for side in (a, b))
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)
    assert factorisation.residuals(ratings, parts[1], parts[0], "productid", "userid").agg(F.max("residual")).first()[0] < 1e-9


def test_factorisation_writes_factors_once_and_blocks_read_them(spark, monkeypatch, tmp_path):
    """A half-sweep must not send a factor to each block that needs it, if a file of it can be read by all; what is sent gives the same."""
    cells = [(k % 70 - 3, k * 7 % 31, float(k % 5 + 1)) for k in range(900)]
    ratings = spark.createDataFrame(cells, "userid long, productid long, rating double")
    settings = {"rank": 3, "iterations": 2, "chunk": 20, "block_ratings": 150}
    with monkeypatch.context() as m:
        m.setattr(factorisation, "mounted", lambda *_: None)
        sent = factorisation.fit(ratings, **settings)
        off = factorisation.residuals(ratings, sent[1], sent[0], "productid", "userid").collect()
    made = []
    monkeypatch.setattr(factorisation, "new_folder", lambda _: made.append(f"file://{tmp_path}/{len(made)}") or made[-1])
    monkeypatch.setattr(factorisation, "_letters", None)
    read = factorisation.fit(ratings, **settings)
    for a, b in zip(sent, read, strict=True):
        a, b = ({r.id: r.features for r in side.collect()} for side in (a, b))
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)
    also = factorisation.residuals(ratings, read[1], read[0], "productid", "userid").collect()
    assert {(r.id, r.n) for r in off} == {(r.id, r.n) for r in also} and max(r.residual for r in off + also) < 1e-9
    assert len(made) == 2 and not [*tmp_path.iterdir()]  # nothing is left


def test_factors_start_from_digests_of_their_ids():
    ids = np.array([0, 7, -5, 123, 99999, 2**63 - 1, -(2**63), 10])
    for some, k, heads in digests.md5_heads(ids, ["/0/1", "/12/1", "/" + "x" * 150, "/" + "9" * 54]):
        for at, head in zip(some, heads, strict=True):
            text = f"{ids[at]}{['/0/1', '/12/1', '/' + 'x' * 150, '/' + '9' * 54][k]}"
            assert int(head) == int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
    numbers = factorisation.start(ids, 4, 1)
    assert numbers.shape == (8, 4) and numbers[3, 2] == int(hashlib.md5(b"123/2/1").hexdigest()[:8], 16) / (4294967296.0 * 2)


def test_factorisation_lays_out_one_block_in_a_task(spark, monkeypatch):
    """A task that deals out holds what it has: that must not be all blocks of a file, nor an array for each block and home."""
    cells = [(k % 40, k * 7 % 31, float(k % 5 + 1)) for k in range(600)]
    ratings = spark.createDataFrame(cells, "user long, item long, rating double")
    held, dealt = [], RDD.partitionBy

    def counted(self, *args, **more):
        held.append(max(self.mapPartitions(lambda part: [sum(len(x) == len(factorisation._LAYOUT) for _, x in part)]).collect()))
        return dealt(self, *args, **more)

    monkeypatch.setattr(RDD, "partitionBy", counted)
    side = factorisation._laid_out(ratings, "user", "item", blocks=24, homes=3, rank=2, chunk=4)
    ((layout, routes),) = side.phases
    assert max(held) == 1 and sum(len(x[0]) for _, x in layout.collect()) >= 40
    assert routes.count() <= 3
    side.unpersist()


def test_factorisation_sums_chunks_in_time_of_their_number(monkeypatch):
    rng = np.random.default_rng(4)
    letters = [(0, (np.arange(k % 10, 700, 10), rng.uniform(size=(70, 2, 2)), rng.uniform(size=(70, 2)), np.ones(70))) for k in range(640)]
    rows, summed = [], factorisation._summed
    monkeypatch.setattr(factorisation, "_summed", lambda arrays: rows.append(sum(len(x[0]) for x in arrays)) or summed(arrays))
    ((home, (ids, made)),) = factorisation._met(iter(letters), 2, 0.1)
    gram, right = np.zeros((700, 2, 2)), np.zeros((700, 2))
    for _, (names, a, b, _) in letters:
        gram[names] += a
        right[names] += b
    assert home == 0 and (ids == np.arange(700)).all()
    assert np.allclose(made, np.linalg.solve(gram + 6.4 * np.eye(2), right[:, :, None])[:, :, 0])
    assert sum(rows) <= 3 * 640 * 70
    whole = np.arange(2000), np.full(2000, 4), np.ones(2000, np.int8), np.arange(8), np.tile(np.arange(4), 2000), np.ones(8000)
    assert len([*factorisation._solutions(whole, rng.uniform(size=(8, 2)), 0.1, 3)]) == 3  # a letter to each home


def test_logistic_regression_known_coefficients(spark):
    rng = np.random.default_rng(8)
    x, y = rng.uniform(0, 1, 4000), rng.uniform(0, 1, 4000)
    p = 1 / (1 + np.exp(-(-1 + 2 * x - 3 * y)))
    df = frame(spark, {"id": np.arange(4000), "x": x, "y": y, "label": (rng.uniform(size=4000) < p).astype(int)})
    model = logistic.fit(df, ["x", "y"], "label")
    coef = model.first()["coef"]
    assert coef == pytest.approx([-1, 2, -3], abs=0.45)
    made = logistic.probability(df, model, ["x", "y"], "id").join(df, "id")
    # the likelihood equations of a fit with intercept: mean probability equals the share of ones
    assert made.agg(F.avg("probability") - F.avg("label")).first()[0] == pytest.approx(0, abs=1e-6)


def test_metric_corner_cases(spark):
    def df(rows):
        return spark.createDataFrame(rows, "p int, y int")

    assert metrics.mcc(df([(1, 1), (1, 0)]), "p", "y").first()[0] == 0
    assert metrics.mcc(df([(1, 1), (0, 0)]), "p", "y").first()[0] == pytest.approx(1)
    assert metrics.mcc(df([(1, 0), (0, 1)]), "p", "y").first()[0] == pytest.approx(-1)
    assert metrics.accuracy(df([(1, 1), (1, None)]), "p", "y").first()[0] == 0.5
    assert metrics.f1(df([(1, 1), (1, 0), (0, 1), (0, None)]), "p", "y").first()[0] == pytest.approx(0.5)
    assert metrics.mae(df([(1, 3), (5, 4)]), "p", "y").first()[0] == 1.5
    assert metrics.log_error(df([(1, 1), (1, 3)]), "p", "y").first()[0] == pytest.approx(math.log(3) ** 2 / 2)
