"""Gaussian-kernel classifier: random Fourier features + linear support vector machine.

The random projection is part of the model (one row per component), so a stored
model predicts the same on every cluster.

The machine has squared hinge loss and is fitted by Newton steps: one pass sums the loss, its gradient and its
curvature over the mapped features, where they are mapped; the sums have a fixed size. The fit stops
on the gradient, which is returned with the model as its proof.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import materialise

_ARROW = pa.schema([("slot", pa.int32()), ("rows", pa.float64()), ("loss", pa.float64()), ("gradient", pa.binary()), ("curvature", pa.binary())])
Projection = list[tuple[list[float], float]]


@dataclass
class KernelSvm:
    """Everything a prediction needs: a few arrays, independent of the training data's size."""

    features: list[str]
    projection: Projection
    coefficients: list[float]
    intercept: float
    gradient: list[float] | None = None  # of the fit, by component and then the intercept


def random_projection(n_features: int, gamma: float, components: int, seed: int) -> Projection:
    """Weights ~ N(0, 2 * gamma) and offsets ~ U(0, 2 pi), one pair per component."""
    rng = np.random.default_rng(seed)
    weights = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(components, n_features))
    offsets = rng.uniform(0.0, 2.0 * math.pi, size=components)
    return [([float(x) for x in w], float(b)) for w, b in zip(weights, offsets)]


def _feature_map(projection: Projection):
    """Batch function: columns -> matrix of sqrt(2 / D) * cos(w.x + b)."""
    weights = np.array([w for w, _ in projection]).T
    offsets = np.array([b for _, b in projection])
    scale = math.sqrt(2.0 / len(projection))

    def apply(columns: Sequence[pa.Array]) -> np.ndarray:
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])
        return scale * np.cos(x @ weights + offsets)

    return apply


def _doubles(features: Sequence[str]) -> list[Column]:
    return [F.col(c).cast("double") for c in features]


_SUMS = "slot int, rows double, loss double, gradient binary, curvature binary"
_SLOTS = 16


def _moments(points: DataFrame, features: Sequence[str], projection: Projection, at: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Weight of all rows, and the sums of loss, gradient and curvature at these coefficients, the intercept last."""
    feature_map, width = _feature_map(projection), len(projection) + 1

    def row(slot: int, n: float, loss: float, g: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"slot": slot, "rows": n, "loss": loss, "gradient": g.tobytes(), "curvature": h.tobytes()}], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, g, h = 0.0, 0.0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([feature_map([batch.column(c) for c in features]), np.ones(batch.num_rows)])
            y, c = 2 * batch.column("label").to_numpy() - 1, batch.column("weight").to_numpy()
            margin = x @ at
            near = y * margin < 1  # rows on the right side and far enough cost nothing
            x, off, c_near = x[near], (margin - y)[near], c[near]
            n += c.sum()
            loss += float((c_near * off * off).sum())
            g += 2 * (c_near * off) @ x
            h += 2 * (x * c_near[:, None]).T @ x
        yield row(hash(n) % _SLOTS, n, loss, g, h)

    def summed(group: pa.Table) -> pa.Table:
        whole = lambda name: sum(np.frombuffer(b.as_py()) for b in group.column(name))
        n, loss = (float(group.column(name).to_numpy().sum()) for name in ("rows", "loss"))
        return pa.Table.from_batches([row(group.column("slot")[0].as_py(), n, loss, whole("gradient"), whole("curvature"))])

    parts = points.mapInArrow(run, _SUMS).groupBy("slot").applyInArrow(summed, _SUMS).collect()  # one row per slot
    gradient = sum(np.frombuffer(r["gradient"]) for r in parts)
    curvature = sum(np.frombuffer(r["curvature"]) for r in parts).reshape(width, width)
    return sum(r["rows"] for r in parts), sum(r["loss"] for r in parts), gradient, curvature


def fit(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    gamma: float | None = None,
    components: int | None = None,
    reg_param: float = 1.0,
    tol: float = 1e-3,
    max_iter: int = 200,
    balanced: bool = True,
    seed: int = 7,
    projection: Projection | None = None,
) -> KernelSvm:
    """``balanced`` weights a row by n / (2 * size of its class).

    ``tol`` bounds the largest entry of the gradient, ``max_iter`` the Newton steps, each one pass over the data.
    """
    n = len(features)
    projection = projection or random_projection(n, gamma or 1.0 / n, components or max(100, 2 * n), seed)
    y = F.col(label).cast("double")
    data = df.select(*[F.col(c).cast("double").alias(c) for c in features], y.alias("label")).dropna()
    weight = F.lit(1.0)
    if balanced:
        share = data.agg(F.avg("label")).first()[0]
        if share is None or not 0 < share < 1:
            raise ValueError("the balanced classifier needs rows of both classes")
        weight = F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share))
    points = materialise(data.withColumn("weight", weight))
    penalty = np.append(np.full(len(projection), reg_param), 0.0)
    here, before, least, gradient = np.zeros(len(projection) + 1), None, math.inf, np.zeros(0)
    for _ in range(max_iter + 1):
        total, loss, g, h = _moments(points, features, projection, here)
        if not total:
            raise ValueError("no rows to fit on")
        cost = loss / total + 0.5 * float(penalty @ (here * here))
        if before is not None and cost > least * (1 + 1e-12):
            here = (here + before) / 2  # the step went too far
            continue
        gradient = g / total + penalty * here
        if np.abs(gradient).max() <= tol:
            break
        curvature = h / total + np.diag(penalty)
        before, least = here, cost
        here = here - np.linalg.solve(curvature + 1e-12 * np.eye(len(here)), gradient)
    else:
        here = before  # the point that the gradient belongs to
        if tol > 0:
            warnings.warn(f"the fit stopped after {max_iter} steps, before its tolerance of {tol}", stacklevel=2)
    return KernelSvm(list(features), projection, here[:-1].tolist(), float(here[-1]), gradient.tolist())


def predict(df: DataFrame, model: KernelSvm, id_column: str) -> DataFrame:
    """(id, prediction 0/1) from the sign of the margin; NULL where a feature is NULL."""
    feature_map = _feature_map(model.projection)
    coefficients, intercept = np.array(model.coefficients), model.intercept

    def margins(*columns: pa.Array) -> pa.Array:
        return pa.array(feature_map(columns) @ coefficients + intercept)

    margin = F.arrow_udf(margins, T.DoubleType())(*_doubles(model.features))
    return df.select(id_column, F.when(F.isnan(margin), None).when(margin > 0, 1).otherwise(0).alias("prediction"))


def component_table(spark: SparkSession, model: KernelSvm) -> DataFrame:
    """The model as a table: random weights, offset and fitted coefficient per component."""
    rows = [(i, w, b, c) for i, ((w, b), c) in enumerate(zip(model.projection, model.coefficients))]
    return spark.createDataFrame(rows, "component int, weights array<double>, offset double, coefficient double")


def save(spark: SparkSession, model: KernelSvm, path: str) -> None:
    component_table(spark, model).coalesce(1).write.mode("overwrite").parquet(f"{path}/components")
    head = spark.createDataFrame([(model.features, model.intercept)], "features array<string>, intercept double")
    head.coalesce(1).write.mode("overwrite").parquet(f"{path}/head")


def load(spark: SparkSession, path: str) -> KernelSvm:
    rows = spark.read.parquet(f"{path}/components").orderBy("component").collect()
    head = spark.read.parquet(f"{path}/head").first()
    projection = [(list(r["weights"]), r["offset"]) for r in rows]
    return KernelSvm(list(head["features"]), projection, [r["coefficient"] for r in rows], head["intercept"])
