"""Mixing sources to target weights with the cube method.

Sources get shares of all words by weight; a source's share stops at ``most`` times its own size and
the excess goes to the others by weight (water filling). Every document of a source is taken
``floor(target / size)`` times, and once more with the fractional part as inclusion probability. Which
documents get the extra copy is decided by the cube method: in blocks of bounded size, probabilities
move along the null space of the constraints (documents, words) until at most two per block are
undecided; those meet in new blocks, level by level, until one block per source is left. Its last two
land on the 0/1 corner whose word total is nearest.

Blocks are dealt by a hash of the document, so a hot source is many blocks, and reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a source
without words has target 0 and takes nothing; repeated rows are decided together; an empty table
gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import stored

WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK = 4096
_UNIT = "doc_id long, source string, size long, m long, source_size long, target double, base long, p double, block long"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, n, target from source, source_size, n: one row per source, so its windows stay small."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double"))
    # A source is full when its bound per weight is below the level that the rest reaches.
    filled = Window.orderBy("bound", F.col("source").asc_nulls_last())
    before, after = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("bound", F.col("source_size") * most / F.col("w"))
    everything = F.sum("source_size").over(Window.partitionBy())
    level = (everything - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most) / F.sum("w").over(after)
    rows = rows.withColumn("level", level).withColumn("open", F.col("bound") > F.col("level"))
    final = F.min(F.when(F.col("open"), F.struct("bound", "level"))).over(Window.partitionBy())["level"]
    return rows.withColumn("final", final).select("source", "source_size", "n", F.when(F.col("final").isNull(), F.col("source_size") * F.lit(float(most))).otherwise(F.least(F.col("w") * F.col("final"), F.col("source_size") * F.lit(float(most)))).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, count: np.ndarray, coins: np.ndarray) -> np.ndarray:
    """Move probabilities until at most two are strictly between 0 and 1; sums of count and size stay as they are."""
    p, eps = p.tolist(), 1e-9
    s, c = size.tolist(), count.tolist()
    held: list[int] = []
    coin = iter(coins.tolist())
    for k in range(len(p)):
        if not eps < p[k] < 1 - eps:
            p[k] = float(round(p[k]))
            continue
        held.append(k)
        if len(held) < 3:
            continue
        i, j, k3 = held
        move = (c[j] * s[k3] - c[k3] * s[j], c[k3] * s[i] - c[i] * s[k3], c[i] * s[j] - c[j] * s[i])
        if not any(move):  # the three are proportional: two of them suffice
            move = (c[j], -c[i], 0)
        up = min((1 - p[x]) / m if m > 0 else -p[x] / m for x, m in zip(held, move, strict=True) if m)
        down = min(p[x] / m if m > 0 else (p[x] - 1) / m for x, m in zip(held, move, strict=True) if m)
        step = up if next(coin) * (up + down) < down else -down
        for x, m in zip(held, move, strict=True):
            p[x] += step * m
            if not eps < p[x] < 1 - eps:
                p[x] = float(round(p[x]))
        held = [x for x in held if eps < p[x] < 1 - eps]
    return np.array(p)


def land(p: np.ndarray, size: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Decide the last undecided ones: the corner with the nearest word total, then the nearest document total."""
    out, left = p.copy(), np.flatnonzero((p > 0) & (p < 1))
    best = min(range(1 << len(left)), key=lambda bits: (abs(sum(size[x] * ((bits >> k & 1) - p[x]) for k, x in enumerate(left))), abs(sum(count[x] * ((bits >> k & 1) - p[x]) for k, x in enumerate(left))), bits))
    for k, x in enumerate(left):
        out[x] = best >> k & 1
    return out


def _step(seed: int, last: bool):
    def run(group: pa.Table) -> pa.Table:
        # The id stays an Arrow column throughout: as numbers of another kind, wide ids beside a null would change.
        ids = pc.fill_null(group.column("doc_id"), -1).to_numpy()
        key = pd.util.hash_array(ids) ^ np.uint64(seed)
        group = group.take(pa.array(np.lexsort((group.column("size").to_numpy(), pc.is_valid(group.column("doc_id")).to_numpy(), ids, key))))
        m, p = group.column("m").to_numpy(), group.column("p").to_numpy()
        size, count = (group.column("size").to_numpy() * m).astype(np.float64), m.astype(np.float64)
        coins = np.random.default_rng([seed, len(group), int(size.sum())]).random(len(group) + 1)
        p = flight(p, size, count, coins)
        p = land(p, size, count) if last else p
        return group.set_column(group.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))

    return run


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = 7) -> DataFrame:
    """One row per distinct (doc_id, source, size): m rows alike, source_size, target, copies of each."""
    docs = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    units = stored(docs.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")), "mix-units")
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n"))
    goals = stored(targets(sources, weights, most), "mix-targets")
    longest = goals.agg(F.max("n")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rate = F.when(F.abs(rate - F.round(rate)) < 1e-12, F.round(rate)).otherwise(rate)
    blocks = F.ceil(F.col("n") / BLOCK)
    rows = units.alias("u").join(goals.alias("g"), F.col("u.source").eqNullSafe(F.col("g.source"))).select(
        "u.doc_id", "u.source", "u.size", "u.m", "g.source_size", "g.target", F.floor(rate).alias("base"), (rate - F.floor(rate)).alias("p"), F.pmod(F.xxhash64("u.doc_id", F.lit(seed)), F.greatest(blocks, F.lit(1))).alias("block")
    )
    # Each level leaves two of BLOCK undecided at most, so every source is one block after a few levels.
    most_blocks, decided, level = max(1, math.ceil(longest / BLOCK)), [], 0
    while True:
        last = most_blocks == 1
        done = rows.groupBy("source", "block").applyInArrow(_step(seed + level, last), _UNIT)
        done = stored(done, "mix-level")
        if last:
            decided.append(done)
            break
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        decided.append(done.where(~open_))
        # A new block takes the leftovers of BLOCK / 2 old ones.
        rows = done.where(open_).withColumn("block", F.floor(F.col("block") / (BLOCK // 2)))
        most_blocks, level = math.ceil(most_blocks / (BLOCK // 2)), level + 1
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "size", "m", "source_size", "target", (F.col("base") + F.round("p").cast("long")).alias("copies"))


def taken(mixed: DataFrame) -> DataFrame:
    """One row per document: the words that the mix takes of it."""
    rows = mixed.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with their own columns, whatever their names."""
    chosen = mix(docs, **settings).where("copies > 0").select("doc_id", "source", "size", "copies")
    # The document travels as one value, so that its columns meet no names of the operator.
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), word_count(F.col("text")).alias("words"))
    match = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & F.col("row.source").eqNullSafe(F.col("source")) & (F.col("words") == F.col("size"))
    return whole.join(chosen, match).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
