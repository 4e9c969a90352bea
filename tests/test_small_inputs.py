"""The literal inputs of the extension scripts, with answers worked out by hand."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import udfs
from millrace.functions.expressions import planar_distance
from millrace.functions.stemming import porter_stem
from millrace.operators import logistic, neighbours, quantiles

PATIENTS = [
    (1, 1, 1, 70), (3, 1, 1, 50), (5, 1, 0, 40), (7, 1, 0, 75), (9, 1, 0, 70), (11, 0, 1, 65), (13, 0, 1, 45),
    (15, 0, 1, 40), (17, 0, 0, 55), (19, 0, 0, 50), (2, 1, 1, 80), (4, 1, 0, 60), (6, 1, 0, 65), (8, 1, 0, 80),
    (10, 1, 0, 60), (12, 0, 1, 50), (14, 0, 1, 35), (16, 0, 1, 50), (18, 0, 0, 45), (20, 0, 0, 60),
]


@pytest.mark.parametrize("optimizer", ["irls", "cg"])
def test_logistic_regression(spark, optimizer):
    df = spark.createDataFrame(PATIENTS, "id int, second_attack int, treatment int, trait_anxiety int")
    model = logistic.fit(df, ["treatment", "trait_anxiety"], "second_attack", optimizer)
    assert model.first()["coef"] == pytest.approx([-6.363470, -1.024106, 0.119045], rel=1e-3)


def test_median(spark):
    rows = [(1, "cat1", 1.21), (2, "cat1", 1.24), (3, "cat1", 1.18), (4, "cat1", 1.26), (5, "cat1", 1.15),
            (6, "cat2", 1.15), (7, "cat2", 1.26), (8, "cat2", 1.32), (9, "cat2", 1.30)]
    df = spark.createDataFrame(rows, "f0 int, f1 string, f2 double")
    for median in (quantiles.grouped_median, quantiles.median_by_user_aggregate):
        found = dict(median(df, ["f1"], "f2").collect())
        assert found == pytest.approx({"cat1": 1.21, "cat2": 1.28})


def test_vector_top_k(spark):
    items = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [4.0, 5.0, 6.0])], "id long, embedding array<float>")
    found = neighbours.nearest(items, "id", "embedding", [3, 1, 2], 5).collect()
    assert [r.id for r in found] == [1, 2]
    assert [r.distance for r in found] == pytest.approx([math.sqrt(6), math.sqrt(33)])


def test_point_distance(spark):
    df = spark.createDataFrame([("Point A", 30.0, 10.0), ("Point B", 40.0, 20.0)], "name string, x double, y double")
    a, b = df.filter("name = 'Point A'").alias("a"), df.filter("name = 'Point B'").alias("b")
    pair = a.join(b, F.lit(1) == 1)
    d = planar_distance(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))
    assert pair.select(d).first()[0] == pytest.approx(math.sqrt(200))


def test_python_functions_in_sql(spark):
    udfs.register(spark)
    assert spark.sql("SELECT pymax(3, 7), pymax(7, 3)").first()[:] == (7, 7)
    assert [r.token for r in spark.sql("SELECT * FROM split_tokens('a  b c')").collect()] == ["a", "b", "c"]


def test_series_average(spark):
    assert spark.range(1, 100_001).agg(F.avg("id")).first()[0] == 50000.5


# pairs from the published description of the algorithm
@pytest.mark.parametrize(
    "word, stem",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"),
        ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"),
        ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"),
        ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("rational", "ration"),
        ("digitizer", "digit"), ("operator", "oper"), ("feudalism", "feudal"), ("hopefulness", "hope"),
        ("triplicate", "triplic"), ("formative", "form"), ("electrical", "electr"), ("goodness", "good"),
        ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"),
        ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("generalizations", "gener"), ("oscillators", "oscil"),
    ],
)
def test_stem(word, stem):
    assert porter_stem(word) == stem
