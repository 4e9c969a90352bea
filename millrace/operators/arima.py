"""ARIMA(1,1,1) without a mean term: one fit per series, forecast as an expression.

Input is one row per series and period (a weekly aggregate), so a series is as
long as the calendar, however many sales rows stand behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL_FIELDS = "phi double, theta double, last_value double, last_diff double, last_residual double, n_obs long"
_MIN_POINTS = 4


def _residuals(d: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of squared one-step errors and last error for many (phi, theta) at once."""
    e = np.zeros_like(phi)
    total = np.zeros_like(phi)
    for t in range(1, len(d)):
        e = d[t] - phi * d[t - 1] - theta * e
        total += e * e
    return total, e


def _fit_differences(d: np.ndarray) -> tuple[float, float, float]:
    """Conditional least squares over the stationary, invertible square by shrinking grids."""
    phi0 = theta0 = 0.0
    half = 0.99
    for _ in range(12):
        axis = np.linspace(-half, half, 15)
        phi, theta = np.meshgrid(np.clip(phi0 + axis, -0.99, 0.99), np.clip(theta0 + axis, -0.99, 0.99))
        total, _ = _residuals(d, phi.ravel(), theta.ravel())
        best = int(np.argmin(total))
        phi0, theta0 = float(phi.ravel()[best]), float(theta.ravel()[best])
        half *= 0.35
    _, e = _residuals(d, np.array([phi0]), np.array([theta0]))
    return phi0, theta0, float(e[0])


def fit(series: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """One row per series: keys, coefficients and the state a forecast starts from.

    A series with fewer than four points gets NULL coefficients.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in series.select(*keys).schema)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(time)[value].to_numpy(dtype=float)
        state = [None, None, None, None, None]
        if len(y) >= _MIN_POINTS:
            d = np.diff(y)
            scale = float(np.max(np.abs(d))) or 1.0
            phi, theta, e = _fit_differences(d / scale)
            state = [phi, theta, float(y[-1]), float(d[-1]), e * scale]
        names = ["phi", "theta", "last_value", "last_diff", "last_residual", "n_obs"]
        return pd.DataFrame([[*key, *state, len(y)]], columns=[*keys, *names])

    rows = series.select(*keys, time, F.col(value).cast("double").alias(value)).dropna()
    return rows.groupBy(*keys).applyInPandas(one, f"{schema}, {MODEL_FIELDS}")


def forecast(model: DataFrame, keys: Sequence[str], steps: int | Column) -> DataFrame:
    """(keys, week_index, forecast): one row per fitted series and step ahead.

    With D1 = phi * last_diff + theta * last_residual, step h adds D1 * phi^(h-1),
    so the level is a geometric sum and no recursion is needed.
    """
    steps = F.lit(steps) if isinstance(steps, int) else steps
    phi = F.col("phi")
    first = phi * F.col("last_diff") + F.col("theta") * F.col("last_residual")
    h = F.col("week_index")
    growth = F.when(phi == 1, h.cast("double")).otherwise((1 - F.pow(phi, h)) / (1 - phi))
    return (
        model.filter(phi.isNotNull() & (steps >= 1))
        .withColumn("week_index", F.explode(F.sequence(F.lit(1), steps.cast("int"))))
        .select(*keys, "week_index", (F.col("last_value") + first * growth).alias("forecast"))
    )
