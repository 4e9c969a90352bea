"""Approximate nearest neighbours by cosine: robust-pruned directed graphs, one per shard, and beam search.

Vectors that are equal are one node with the ids of its smallest holders, so copies neither crowd a
graph nor hide each other. Nodes are dealt to shards of about ``SHARD`` by a hash. In each shard a graph
is grown in batches: a greedy beam search from the entry node proposes neighbours, relaxed distance
pruning keeps an edge only if no kept neighbour is nearer to its end by the factor ``alpha``, and the
reverse edges are pruned alike. Queries go to every shard in blocks, a beam search finds candidates,
candidates are scored exactly in double precision, and the best of all shards are kept.

A shard and a block of queries are all that a task holds at a time.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold null or
non-finite components take no part; a null id takes no part; ties go to the smaller id; a query's own id
is no candidate, other rows with an equal vector are; fewer candidates than k are all returned; repeated
rows count once; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import stored

K = 5
EVERY = 50
SHARD = 4096
QUERIES = 4096  # per block
DEGREE = 24
BEAM = 64  # while the graph is built
SEARCH_BEAM = 128
ALPHA = 1.2
BATCH = 512
_GRAPH = "shard int, node int, ids array<long>, vector array<double>, edges array<int>"
_HITS = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (doubles) of the rows that take part."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).where("vec_id IS NOT NULL AND size(vector) > 0")
    fine = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(fine)
    # The commonest length; a row per length is all that is sorted.
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")
    return rows.join(F.broadcast(length), F.size("vector") == F.col("n"), "left_semi")


def nodes(rows: DataFrame, keep: int) -> DataFrame:
    """vector, ids: each distinct vector with its ``keep`` smallest ids, of which the rest can never be in a result."""
    order = Window.partitionBy("vector").orderBy("vec_id")
    return rows.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep).groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _again(names: np.ndarray) -> np.ndarray:
    """Where a row lists a node that it has listed before."""
    order = np.argsort(names, 1, kind="stable")
    ranked = np.take_along_axis(names, order, 1)
    again = np.zeros(names.shape, bool)
    np.put_along_axis(again, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
    return again


def beam_search(unit: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy beam search of many queries in step; nodes found and their distances, nearest first.

    Nodes from ``upto`` on are not in the graph yet. Missing places hold node -1 and an infinite distance.
    """
    n, here = len(queries), np.arange(len(queries))[:, None]
    found = np.full((n, beam), -1, np.int32)
    far = np.full((n, beam), np.inf, np.float32)
    done = np.zeros((n, beam), bool)
    found[:, 0], far[:, 0] = entry, 1 - queries @ unit[entry]
    seen = np.zeros((n, upto), bool)
    seen[:, entry] = True
    while True:
        waiting = np.where(done | (found < 0), np.inf, far)
        live = np.flatnonzero(np.isfinite(waiting.min(1)))
        if not len(live):
            return found, far
        at = waiting[live].argmin(1)
        done[live, at] = True
        near = edges[found[live, at]]
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        rows, cols = np.nonzero(fresh)
        seen[live[rows], near[rows, cols]] = True
        distance = np.full(near.shape, np.inf, np.float32)
        distance[rows, cols] = 1 - np.einsum("ij,ij->i", queries[live[rows]], unit[near[rows, cols]])
        wide = np.concatenate([far[live], distance], 1)
        names = np.concatenate([found[live], np.where(fresh, near, -1)], 1)
        closed = np.concatenate([done[live], np.zeros(near.shape, bool)], 1)
        order = np.argsort(wide, 1, kind="stable")[:, :beam]
        line = here[: len(live)]
        far[live], found[live], done[live] = wide[line, order], names[line, order], closed[line, order]


def robust_prune(unit: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each point's candidates (-1: none), up to ``degree`` that no kept one is nearer to by the factor alpha."""
    bad = (candidates < 0) | (candidates == points[:, None]) | _again(candidates)
    vectors = unit[np.maximum(candidates, 0)]
    away = np.where(bad, np.inf, 1 - np.einsum("ij,ikj->ik", unit[points], vectors))
    line = np.arange(len(points))
    kept = np.full((len(points), degree), -1, np.int32)
    for place in range(degree):
        best = away.argmin(1)
        alive = np.isfinite(away[line, best])
        if not alive.any():
            break
        kept[alive, place] = candidates[line, best][alive]
        between = 1 - np.einsum("ij,ikj->ik", vectors[line, best], vectors)
        away[alive[:, None] & (alpha * between <= away)] = np.inf
        away[line, best] = np.inf
    return kept


def build_graph(unit: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, batch: int = BATCH) -> tuple[np.ndarray, int]:
    """Edges (n, degree; -1: none) and the entry node of a shard's graph over unit vectors."""
    n = len(unit)
    edges = np.full((n, degree), -1, np.int32)
    entry = int(np.argmax(unit @ unit.mean(0)))
    # The entry stands first; every batch is as large as the graph so far at most.
    order = np.concatenate([[entry], np.delete(np.arange(n), entry)])
    unit = unit[order]
    for grow in (1.0, alpha):
        at = 1 if grow == 1.0 else 0
        while at < n:
            stop = min(n, at + min(batch, max(at, 1)))
            points = np.arange(at, stop)
            reach = at if grow == 1.0 else n
            near, _ = beam_search(unit, edges, 0, unit[points], beam, reach)
            kept = robust_prune(unit, points, np.concatenate([near, edges[points]], 1), degree, grow)
            edges[points] = kept
            _link_back(unit, edges, points, kept, grow)
            at = stop
    return _renamed(edges, order), entry


def _link_back(unit: np.ndarray, edges: np.ndarray, points: np.ndarray, kept: np.ndarray, alpha: float) -> None:
    """Add the reverse of new edges; nodes whose places do not suffice are pruned."""
    degree = edges.shape[1]
    rows, cols = np.nonzero(kept >= 0)
    to, source = kept[rows, cols], points[rows].astype(np.int32)
    order = np.argsort(to, kind="stable")
    to, source = to[order], source[order]
    ends, first, counts = np.unique(to, return_index=True, return_counts=True)
    for k in range(0, len(ends), BATCH):
        some = slice(k, k + BATCH)
        wide = int(counts[some].max())
        offer = np.full((len(ends[some]), degree + wide), -1, np.int32)
        offer[:, :degree] = edges[ends[some]]
        for row, (a, c) in enumerate(zip(first[some].tolist(), counts[some].tolist(), strict=True)):
            offer[row, degree : degree + c] = source[a : a + c]
        offer[_again(offer)] = -1
        room = (offer >= 0).sum(1) <= degree
        packed = np.take_along_axis(offer, np.argsort(offer < 0, 1, kind="stable"), 1)[:, :degree]
        if not room.all():
            packed[~room] = robust_prune(unit, ends[some][~room], offer[~room], degree, alpha)
        edges[ends[some]] = packed


def _renamed(edges: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Edges in the numbering from before the nodes were put in order."""
    out = np.full_like(edges, -1)
    out[order] = np.where(edges >= 0, order[np.maximum(edges, 0)], -1)
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return (scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))).astype(np.float32)


def index(vectors: DataFrame, keep: int = K + 1, shard: int = SHARD) -> DataFrame:
    """The graph of every shard as a table: shard, node, ids, vector, edges."""
    distinct = stored(nodes(usable(vectors), keep), "vectors")
    shards = max(1, -(-distinct.count() // shard))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k", kind="stable").reset_index(drop=True)
        matrix = np.stack(group["vector"].to_numpy())
        edges, entry = build_graph(_unit(matrix))
        place = np.arange(len(group))
        place[[0, entry]] = place[[entry, 0]]  # the entry is node 0 in the table
        back = np.empty_like(place)
        back[place] = np.arange(len(place))
        named = np.where(edges >= 0, back[np.maximum(edges, 0)], -1)[place]
        return pd.DataFrame({"shard": group["shard"], "node": np.arange(len(group), dtype=np.int32), "ids": group["ids"].to_numpy()[place], "vector": list(matrix[place]), "edges": list(named)})

    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int")).withColumn("k", F.element_at("ids", 1))
    return stored(dealt.groupBy("shard").applyInPandas(run, _GRAPH), "graph")


def search(graph: DataFrame, queries: DataFrame, k: int = K, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score for queries (query_id, vector): the k nearest found in all shards."""
    shards = graph.agg(F.max("shard")).first()[0]
    if shards is None:
        return graph.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks = max(1, -(-queries.count() // QUERIES))
    # Every block of queries meets every shard; the queries are a stated share of the rows.
    asked = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards))))
    held = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(key, nodes_: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(nodes_) or not len(block):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        nodes_ = nodes_.sort_values("node")
        matrix, edges = np.stack(nodes_["vector"].to_numpy()), np.stack(nodes_["edges"].to_numpy())
        unit, ids = _unit(matrix), nodes_["ids"].to_numpy()
        parts = []
        for at in range(0, len(block), 256):
            some = block.iloc[at : at + 256]
            asked_ = np.stack(some["vector"].to_numpy())
            near, _ = beam_search(unit, edges, 0, _unit(asked_), max(beam, k + 1), len(unit))
            for query, vector, found in zip(some["query_id"].to_numpy(), asked_, near, strict=True):
                found = found[found >= 0]
                owners = [ids[f] for f in found]
                names = np.concatenate(owners)
                score = np.repeat(cosine(vector, matrix[found]), [len(o) for o in owners])
                names, score = names[names != query], score[names != query]
                best = np.lexsort((names, -score))[:k]
                parts.append((np.full(len(best), query), names[best], score[best]))
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        return pd.DataFrame({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})

    hits = asked.groupBy("shard", "block").cogroup(held.groupBy("shard", "block"))
    hits = hits.applyInPandas(lambda key, block, nodes_: run(key, nodes_, block), _HITS)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def cosine(vector: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Cosines of the original vectors, in double precision."""
    return (others * vector).sum(1) / (np.sqrt((vector * vector).sum()) * np.sqrt((others * others).sum(1)))


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """The k nearest found of every row whose id is divisible by ``every``."""
    graph = index(vectors, k + 1)
    queries = usable(vectors).where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector").dropDuplicates(["query_id"])
    return search(graph, queries, k)
