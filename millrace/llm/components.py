"""Connected components of an edge table by alternating large and small stars.

Each round is a few grouped minima and joins; a node with very many links is never gathered in one
task, since adaptive execution splits its side of the joins. Rounds are stored in the shared folder.

Defined cases: edges with a null end and self links are ignored; repeated edges count once; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import drop_stored, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node that has a link."""
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        turned = stored(_small_star(_large_star(edges).distinct()).where("a <> b").distinct(), "edges")
        drop_stored(edges)
        edges = turned
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            # Stable: every node points at the smallest of its component.
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
