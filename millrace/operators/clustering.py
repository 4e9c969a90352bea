"""K-means: seeds by oversampling, Lloyd steps, nearest centroid, simplified silhouette."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import materialise

_ONE_ROW = "centroids array<array<double>>"


def _coin(id_column: str, number: int, seed: int) -> Column:
    """A repeatable number in [0, 1) for a row and a round: the first 32 bits of a digest."""
    text = F.concat_ws("-", F.col(id_column).cast("string"), F.lit(str(number)), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def seeds(df: DataFrame, id_column: str, columns: Sequence[str], k: int, rounds: int = 2, seed: int = 1) -> list[list[float]]:
    """k starting points, or fewer if there are fewer different rows; the same whatever the partitioning.

    The first candidate is the row of the least coin. Every round takes each row with a probability of 2 k times
    its share of the squared distances to the candidates so far, by a coin that is a digest of its id. Candidates
    are weighed by the rows that they are nearest to; then the heaviest and, one after another, the one
    whose weight times squared distance from those chosen is largest start the clusters.
    """
    spark, names = df.sparkSession, [id_column, *columns]
    rows = df.select(*names).dropna()
    first = rows.orderBy(_coin(id_column, 0, seed), id_column).limit(1).collect()
    if not first:
        return []
    found = {tuple(first[0])}

    def table() -> DataFrame:
        ordered = sorted(found)
        return spark.createDataFrame([([[float(x) for x in c[1:]] for c in ordered],)], _ONE_ROW)

    for number in range(1, rounds + 1):
        near = assign(rows, table(), columns)
        total = near.agg(F.sum("distance")).first()[0]
        if not total:
            break
        taken = near.where(_coin(id_column, number, seed) < 2 * k * F.col("distance") / F.lit(total))
        found |= {tuple(r) for r in taken.select(*names).collect()}  # about 2 k rows
    ordered = sorted(found)
    weight = np.zeros(len(ordered))
    for r in assign(rows, table(), columns).groupBy("cluster_id").count().collect():
        weight[r["cluster_id"]] = r["count"]
    places = np.array([[float(x) for x in c[1:]] for c in ordered])
    chosen = [int(weight.argmax())]
    while len(chosen) < k:
        far = weight * ((places[:, None, :] - places[chosen][None, :, :]) ** 2).sum(axis=2).min(axis=1)
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    return places[chosen].tolist()


def fit(df: DataFrame, id_column: str, columns: Sequence[str], k: int = 4, max_iter: int = 300, seed: int = 1, tolerance: float = 1e-4) -> DataFrame:
    """One row with the centroids (index = cluster id): seeds, then Lloyd steps until none moves by more than the tolerance."""
    points = materialise(df.select(id_column, *[F.col(c).cast("double").alias(c) for c in columns]).dropna())
    return lloyd(points, columns, seeds(points, id_column, columns, k, seed=seed), max_iter, tolerance)


def lloyd(df: DataFrame, columns: Sequence[str], start: Sequence[Sequence[float]], steps: int, tolerance: float = 0.0) -> DataFrame:
    """One row with the centroids after a number of Lloyd steps from given points; one without rows stays."""
    spark, centres = df.sparkSession, [[float(x) for x in c] for c in start]
    for _ in range(steps if centres else 0):
        here = spark.createDataFrame([(centres,)], _ONE_ROW)
        means = assign(df, here, columns).groupBy("cluster_id").agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])
        before = [list(c) for c in centres]
        for r in means.collect():  # one row per centroid
            centres[r["cluster_id"]] = [r[c] for c in columns]
        if max(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) for a, b in zip(centres, before, strict=True)) <= tolerance**2:
            break
    return spark.createDataFrame([(centres,)], _ONE_ROW)


def _distances(columns: Sequence[str], centroids: Column) -> Column:
    """Squared distance of the row to every centroid, in centroid order."""
    point = [F.col(c).cast("double") for c in columns]

    def one(centroid: Column) -> Column:
        gaps = [(x - centroid[i]) * (x - centroid[i]) for i, x in enumerate(point)]
        return sum(gaps[1:], gaps[0])

    return F.transform(centroids, one)


def _with_distances(df: DataFrame, centroids: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``_d``; the centroid row comes from a scalar subquery, so nothing is joined."""
    here = df.withColumn("_centroids", centroids.select("centroids").scalar())
    return here.withColumn("_d", _distances(columns, F.col("_centroids"))).drop("_centroids")


def assign(df: DataFrame, centroids: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``cluster_id`` (0-based) and the squared ``distance`` to that centroid."""
    nearest = F.array_min("_d")
    return (
        _with_distances(df, centroids, columns)
        .withColumns({"distance": nearest, "cluster_id": F.array_position("_d", nearest) - 1})
        .drop("_d")
    )


def simplified_silhouette(df: DataFrame, centroids: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean of (b - a) / max(a, b), a and b the squared distances to the two nearest centroids."""
    nearest = _with_distances(df, centroids, columns).select(F.array_sort("_d").alias("_n"))
    a, b = F.col("_n")[0], F.col("_n")[1]
    return nearest.agg(F.avg(F.when(b == 0, F.lit(0.0)).otherwise((b - a) / b)).alias("silhouette"))
