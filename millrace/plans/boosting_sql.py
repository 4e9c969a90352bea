"""Boosted trees as SQL: the same sums per (class, node, feature, bin), one level after another."""

from __future__ import annotations

from collections.abc import Mapping, Sequence


def fitted(rows: str, row_id: str, label: str, cuts: Mapping[str, Sequence[float]], rounds: int, depth: int, rate: float = 0.3) -> str:
    """CTEs that end in ``tree(round, class, node, feature, cut, gain, weight)`` from a relation with one row per point."""
    binned = " UNION ALL ".join(
        f"SELECT {row_id} AS id, {i} AS f, {' + '.join(f'CAST({name} > {c} AS INTEGER)' for c in bounds)} AS bin FROM {rows}"
        for i, (name, bounds) in enumerate(cuts.items())
    )
    cut_rows = ", ".join(f"({i}, {b}, {float(c)}::DOUBLE)" for i, bounds in enumerate(cuts.values()) for b, c in enumerate(bounds))
    steps = [
        f"points AS (SELECT {row_id} AS id, dense_rank() OVER (ORDER BY {label}) - 1 AS y FROM {rows} WHERE {label} IS NOT NULL)",
        f"x AS ({binned})",
        f"cut_at AS (SELECT * FROM (VALUES {cut_rows}) t(f, bin, cut))",
        "classes AS (SELECT DISTINCT y AS k FROM points)",
        "m0 AS (SELECT id, y, k, 0.0::DOUBLE AS m FROM points, classes)",
    ]
    parts = []
    for r in range(rounds):
        steps.append(f"e{r} AS (SELECT id, y, k, m, exp(m - max(m) OVER (PARTITION BY id)) AS e FROM m{r})")
        steps.append(f"p{r} AS (SELECT id, y, k, m, e / sum(e) OVER (PARTITION BY id) AS p FROM e{r})")
        steps.append(
            f"""n{r}_0 AS (SELECT id, y, k, m, 0 AS node, CAST(round((p - CASE WHEN k = y THEN 1 ELSE 0 END) * 16777216) AS BIGINT) AS g,
            CAST(round(greatest(2 * p * (1 - p), 1e-16) * 16777216) AS BIGINT) AS h FROM p{r})"""
        )
        for level in range(depth):
            n = f"n{r}_{level}"
            steps.append(
                f"""t{r}_{level} AS (SELECT k, node, CAST(sum(g) AS DOUBLE) / 16777216 AS gt, CAST(sum(h) AS DOUBLE) / 16777216 AS ht
                FROM {n} WHERE node IS NOT NULL GROUP BY k, node)"""
            )
            steps.append(
                f"""l{r}_{level} AS (SELECT k, node, c.f, c.bin, c.cut, CAST(sum(g) AS DOUBLE) / 16777216 AS gl, CAST(sum(h) AS DOUBLE) / 16777216 AS hl
                FROM (SELECT k, node, f, bin, sum(g) AS g, sum(h) AS h FROM {n} JOIN x USING (id) WHERE node IS NOT NULL GROUP BY ALL) s
                JOIN cut_at c ON c.f = s.f AND s.bin <= c.bin GROUP BY ALL)"""
            )
            steps.append(
                f"""s{r}_{level} AS (SELECT * FROM (SELECT *, gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1) AS gain
                FROM l{r}_{level} JOIN t{r}_{level} USING (k, node) WHERE hl >= 1 AND ht - hl >= 1) WHERE gain > 1e-6
                QUALIFY row_number() OVER (PARTITION BY k, node ORDER BY gain DESC, f, bin) = 1)"""
            )
            # rows of a leaf stay where they are, without a node to split
            steps.append(
                f"""n{r}_{level + 1} AS (SELECT a.id, a.y, a.k, a.m, a.g, a.h, CASE WHEN s.node IS NULL THEN NULL ELSE 2 * a.node + 1 + CAST(x.bin > s.bin AS INTEGER) END AS node
                FROM {n} a LEFT JOIN s{r}_{level} s ON s.k = a.k AND s.node = a.node LEFT JOIN x ON x.id = a.id AND x.f = s.f)"""
            )
            parts.append(f"SELECT {r} AS round, k AS class, node, f AS feature, cut, gain, NULL::DOUBLE AS weight FROM s{r}_{level}")
        leaves = []
        for level in range(depth + 1):
            split = f"AND NOT EXISTS (SELECT 1 FROM s{r}_{level} s WHERE s.k = a.k AND s.node = a.node)" if level < depth else ""
            leaves.append(
                f"SELECT k, node, -{rate} * (CAST(sum(g) AS DOUBLE) / 16777216) / (CAST(sum(h) AS DOUBLE) / 16777216 + 1) AS w, list(id) AS ids FROM n{r}_{level} a WHERE node IS NOT NULL {split} GROUP BY k, node"
            )
        steps.append(f"w{r} AS ({' UNION ALL '.join(leaves)})")
        parts.append(f"SELECT {r}, k, node, NULL, NULL, NULL, w FROM w{r}")
        steps.append(f"m{r + 1} AS (SELECT m.id, m.y, m.k, m.m + u.w AS m FROM m{r} m JOIN (SELECT k, w, unnest(ids) AS id FROM w{r}) u ON u.id = m.id AND u.k = m.k)")
    steps.append(f"tree AS ({' UNION ALL '.join(parts)})")
    return ", ".join(steps)
