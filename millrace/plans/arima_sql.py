"""The ARIMA(1,1,1) fit in SQL, to check ``arima.fit`` with: the same shrinking grids, one relation per grid."""

from __future__ import annotations

import numpy as np

_GRIDS, _POINTS, _EDGE, _SHRINK = 12, 15, 0.99, 0.35


def _double(x: float) -> str:
    text = repr(float(x))
    return text if "e" in text else f"{text}e0"


def _walk(changes: str) -> str:
    """Struct of the last change, the last one-step error and the sum of squared errors."""
    start = f"list_transform({changes}, lambda v: {{'d': v, 'e': 0e0, 's': 0e0}})"
    e = "x.d - phi * a.d - theta * a.e"
    return f"list_reduce({start}, lambda a, x: {{'d': x.d, 'e': {e}, 's': a.s + ({e}) * ({e})}})"


def fitted(weekly: str, keys: str, time: str, value: str) -> str:
    """Relations up to ``arima(keys, phi, theta, last_value, last_diff, last_residual, n_obs)``."""
    relations = [
        f"changes AS (SELECT {keys}, {time} t, {value} y, {value} - lag({value}) OVER (PARTITION BY {keys} ORDER BY {time}) d FROM {weekly})",
        f"""series AS (SELECT {keys}, list(d ORDER BY t) FILTER (WHERE d IS NOT NULL) ds, arg_max(y, t) last_value, arg_max(d, t) last_diff,
            CASE WHEN max(abs(d)) > 0 THEN max(abs(d)) ELSE 1e0 END scale, count(*) n_obs FROM changes GROUP BY {keys})""",
        f"grid0 AS (SELECT {keys}, list_transform(ds, lambda v: v / scale) z, 0e0 phi, 0e0 theta FROM series WHERE n_obs >= 4)",
    ]
    half = _EDGE
    for k in range(1, _GRIDS + 1):
        axis = "[" + ", ".join(map(_double, np.linspace(-half, half, _POINTS))) + "]"
        half *= _SHRINK

        def near(name: str, index: str) -> str:
            return f"greatest(least({name} + {axis}[{index} + 1], {_EDGE}e0), -{_EDGE}e0) {name}"

        relations.append(f"""grid{k} AS MATERIALIZED (
            SELECT {keys}, any_value(z) z, arg_min(phi, (s, i * {_POINTS} + j)) phi, arg_min(theta, (s, i * {_POINTS} + j)) theta
            FROM (SELECT *, ({_walk("z")}).s s FROM (
                SELECT {keys}, z, i, j, {near("phi", "j")}, {near("theta", "i")} FROM grid{k - 1}, range({_POINTS}) b(i), range({_POINTS}) c(j)))
            GROUP BY {keys})""")
    relations.append(f"""arima AS MATERIALIZED (
        SELECT {keys}, phi, theta, CASE WHEN phi IS NOT NULL THEN last_value END last_value, CASE WHEN phi IS NOT NULL THEN last_diff END last_diff,
               last_error * scale last_residual, n_obs
        FROM series LEFT JOIN (SELECT {keys}, phi, theta, ({_walk("z")}).e last_error FROM grid{_GRIDS}) USING ({keys}))""")
    return ",\n".join(relations)
