"""Nearest neighbours by exact distance, and neighbour-based oversampling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.expressions import l2_distance
from millrace.operators.sampling import repeat_rows
from millrace.session import materialise

_HITS = "query_id long, item_id long, distance double"
_CELLS = 1 << 24  # numbers of the points that a step of queries may gather
PART_ROWS = 2_000  # items around a pivot, on average
MOST_PIVOTS = 1 << 10  # they travel with every task


def nearest(items: DataFrame, id_column: str, vector: str, query: Sequence[float], k: int = 5) -> DataFrame:
    """The k items closest to one vector: a per-task top-k, then a merge."""
    target = F.array(*[F.lit(float(x)) for x in query])
    return (
        items.withColumn("distance", l2_distance(F.col(vector), target)).orderBy("distance", id_column).limit(k)
    )


def _closest(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, points: np.ndarray, k: int) -> pd.DataFrame:
    """Per query the k nearest of ``points``; ties go to the smaller id.

    A matrix product finds the points that may be among them; their distances are then taken exactly.
    """
    found = []
    lengths, asked = np.einsum("ij,ij->i", points, points), np.einsum("ij,ij->i", queries, queries)
    slack = 1e-12 * points.shape[1] * (lengths.max(initial=0.0) + asked.max(initial=0.0))
    step = max(1, _CELLS // max(1, points.size))
    for at in range(0, len(queries), step):
        q = queries[at : at + step]
        about = asked[at : at + step, None] - 2 * (q @ points.T) + lengths
        bound = np.partition(about, k - 1, axis=1)[:, k - 1] if len(points) > k else about.max(axis=1)
        which, near = np.nonzero(about <= bound[:, None] + slack)
        gaps = points[near] - q[which]
        d = np.sqrt(np.einsum("ij,ij->i", gaps, gaps))
        order = np.lexsort((ids[near], d, which))
        which, near, d = which[order], near[order], d[order]
        keep = np.arange(len(which)) - np.searchsorted(which, which) < k
        found.append(pd.DataFrame({"query_id": query_ids[at + which[keep]], "item_id": ids[near[keep]], "distance": d[keep]}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "item_id": [], "distance": []})


_PLACED = "id long, vec array<double>, part int, gap double"
_SENT = "id long, vec array<double>, part int, block int"


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2))


def _steps(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    step = max(1, _CELLS // (8 * pivots.size))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


class Pivots:
    """Points that items are gathered around; of each the number of items and how near and far they lie."""

    def __init__(self, places: np.ndarray) -> None:
        self.places = places
        self.between = _distances(places, places)
        self.count, self.near, self.far = (np.zeros(len(places)) for _ in range(3))

    def placed(self, points: DataFrame) -> DataFrame:
        """Every point with its nearest pivot and the distance to it."""
        places = self.places

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _steps(batches, places):
                d = _distances(_vectors(batch.column("vec")), places)
                part = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(part, pa.int32()), pa.array(d[np.arange(len(d)), part])], ["id", "vec", "part", "gap"])

        return points.select("id", "vec").mapInArrow(run, _PLACED)

    def measure(self, placed: DataFrame) -> None:
        for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("lo"), F.max("gap").alias("hi")).collect():  # a row per pivot
            self.count[r.part], self.near[r.part], self.far[r.part] = r.n, r.lo, r.hi

    def blocks(self, block_rows: int) -> np.ndarray:
        return np.maximum(1, np.ceil(self.count / block_rows)).astype(np.int64)

    def reached(self, d: np.ndarray, own: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Which parts but its own may hold a point within ``reach`` of each query; d are its distances to the pivots."""
        reach = (reach * (1 + 1e-9) + 1e-12 * d.max(axis=1))[:, None]
        mine = d[np.arange(len(d)), own][:, None]
        may = (self.count > 0) & (d - self.far <= reach) & (self.near - d <= reach)
        # Points of another part lie beyond the plane half way between the two pivots.
        apart = self.between[own]
        plane = np.divide(d**2 - mine**2, 2 * apart, out=np.zeros_like(d), where=apart > 0)
        may &= plane <= reach + 1e-9 * d
        may[np.arange(len(d)), own] = False
        return may


def _pivots(points: DataFrame, part_rows: int) -> Pivots | None:
    """Points of a small sample, each the one farthest from those before it, so that no cluster is without."""
    wanted = min(MOST_PIVOTS, -(-points.count() // part_rows))
    some = points.orderBy(F.xxhash64("id"), "id").limit(8 * wanted).select("vec").toArrow().column("vec")
    if not len(some):
        return None
    sample = _vectors(some)
    chosen, gap = [0], np.full(len(sample), np.inf)
    while len(chosen) < wanted:
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        if not gap.max() > 0:
            break
        chosen.append(int(gap.argmax()))
    return Pivots(sample[chosen])


def _sent(asked: DataFrame, pivots: Pivots, block_rows: int) -> DataFrame:
    """Queries, to each block of the parts they have to look into: their own, or with a ``reach`` the others within it."""
    blocks, again = pivots.blocks(block_rows), "reach" in asked.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches, pivots.places):
            own = batch.column("part").to_numpy()
            if again:
                d = _distances(_vectors(batch.column("vec")), pivots.places)
                reach = batch.column("reach").to_numpy(zero_copy_only=False)
                which, part = np.nonzero(pivots.reached(d, own, reach))
            else:
                which, part = np.arange(len(own)), own
            n = blocks[part]
            which, part, first = np.repeat(which, n), np.repeat(part, n), np.repeat(np.cumsum(n) - n, n)
            rows = batch.select(["id", "vec"]).take(pa.array(which))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(part, pa.int32()), pa.array(np.arange(len(which)) - first, pa.int32())], ["id", "vec", "part", "block"])

    return asked.mapInArrow(run, _SENT)


def _best(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy("distance", "item_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _search(items: DataFrame, queries: DataFrame, k: int, block_rows: int, part_rows: int, seen: list[DataFrame] | None = None) -> DataFrame:
    points, asked = (df.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")) for df in (items, queries))
    pivots = _pivots(points, part_rows)
    if pivots is None:
        return points.sparkSession.createDataFrame([], _HITS)
    placed, asked = materialise(pivots.placed(points)), materialise(pivots.placed(asked))
    pivots.measure(placed)
    blocks = F.array(*[F.lit(int(n)) for n in pivots.blocks(block_rows)])
    held = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.get(blocks, F.col("part"))).cast("int")).groupBy("part", "block")

    def merge(near: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if near.empty or asking.empty:
            return pd.DataFrame({"query_id": [], "item_id": [], "distance": []})
        return _closest(asking["id"].to_numpy(), np.stack(asking["vec"].to_numpy()), near["id"].to_numpy(), np.stack(near["vec"].to_numpy()), k)

    def looked(sent: DataFrame) -> DataFrame:
        if seen is not None:
            seen.append(sent)
        return held.cogroup(sent.groupBy("part", "block")).applyInPandas(merge, _HITS)

    # First each query looks into its own part; the k-th distance there says how far it still has to look.
    first = materialise(_best(looked(_sent(asked.select("id", "vec", "part"), pivots, block_rows)), k).drop("rank"))
    far = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("far"))
    reach = F.coalesce("far", F.lit(float("inf"))).alias("reach")
    second = looked(_sent(asked.join(far, asked.id == far.query_id, "left").select("id", "vec", "part", reach), pivots, block_rows))
    return first.unionByName(second)


def knn(items: DataFrame, queries: DataFrame, k: int, block_rows: int = 20_000, part_rows: int = PART_ROWS) -> DataFrame:
    """(query_id, item_id, distance, rank) for ``items(id, vec)`` and ``queries(id, vec)``; exact.

    Items lie in parts around pivots. A query looks into its own part first, then only into parts that
    the distance of its k-th hit so far can reach: by how near and far a part lies from its pivot, and by
    the plane between the two pivots. A large part is many blocks; a task hands on at most k hits per query.
    """
    return _best(_search(items, queries, k, block_rows, part_rows), k)


def compared(items: DataFrame, queries: DataFrame, k: int, block_rows: int = 20_000, part_rows: int = PART_ROWS) -> DataFrame:
    """(pairs, all_pairs): how many pairs of a query and an item such a search compares, and how many there are."""
    seen: list[DataFrame] = []
    _search(items, queries, k, block_rows, part_rows, seen)
    points = items.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    pivots = _pivots(points, part_rows)
    counts = pivots.placed(points).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    visits = seen[0].unionByName(seen[1]).where("block = 0").groupBy("part").agg(F.count(F.lit(1)).alias("q"))
    every = queries.agg(F.count(F.lit(1))).scalar() * items.agg(F.count(F.lit(1))).scalar()
    return counts.join(visits, "part").agg(F.sum(F.col("n") * F.col("q")).alias("pairs")).withColumn("all_pairs", every)


def _uniform(seed: int, row: str, number: str) -> Column:
    """A repeatable number in [0, 1): the first 32 bits of md5 of ``row-number-seed``."""
    text = F.concat_ws("-", F.col(row).cast("string"), F.col(number).cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _neighbours_of_others(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest other items; k + 1 are looked up, as a row is its own nearest."""
    found = materialise(knn(items, queries, k + 1).filter("query_id <> item_id"))
    again = Window.partitionBy("query_id").orderBy("rank")
    return found.withColumn("rank", F.row_number().over(again)).filter(F.col("rank") <= k)


def adasyn(
    df: DataFrame, id_column: str, features: Sequence[str], label: str, k: int = 5, seed: int = 42
) -> DataFrame:
    """(features, label, synthetic): all rows plus synthetic rows of class 1 up to the size of class 0.

    A minority row gets synthetic rows in proportion to the share of majority rows
    among its k nearest neighbours; each lies between the row and one of its k
    nearest minority neighbours. All random choices are hashes of the row.
    """
    rows = df.select(
        F.col(id_column).cast("long").alias("id"),
        F.array(*[F.col(c).cast("double") for c in features]).alias("vec"),
        F.col(label).cast("int").alias("label"),
    )
    minority = rows.filter("label = 1").select("id", "vec")
    around = _neighbours_of_others(rows.select("id", "vec"), minority, k)
    majority = rows.filter("label = 0").select(F.col("id").alias("item_id"))
    hard = around.join(majority, "item_id").groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("hits"))
    hard = materialise(hard)
    missing = rows.agg(F.count_if(F.col("label") == 0) - F.count_if(F.col("label") == 1)).scalar()
    wanted = hard.select("id", F.rint(F.col("hits") * missing / hard.agg(F.sum("hits")).scalar()).cast("long").alias("g"))

    partners = (
        _neighbours_of_others(minority, minority, k)
        .groupBy(F.col("query_id").alias("id"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"]).alias("partners"))
    )
    pick = F.floor(_uniform(seed, "id", "no") * F.size("partners")).cast("int")
    chosen = repeat_rows(wanted.join(partners, "id"), "g", "no", ["id"]).select(
        "id", "no", F.col("partners")[pick].alias("partner"), _uniform(seed + 1, "id", "no").alias("step")
    )
    base = minority.select("id", F.col("vec").alias("a"))
    other = minority.select(F.col("id").alias("partner"), F.col("vec").alias("b"))
    made = chosen.join(base, "id").join(other, "partner")
    mixed = F.zip_with("a", "b", lambda x, y: x + (y - x) * F.col("step"))
    synthetic = made.select(mixed.alias("vec"), F.lit(1).alias("label"), F.lit(True).alias("synthetic"))
    everything = rows.select("vec", "label", F.lit(False).alias("synthetic")).unionByName(synthetic)
    return everything.select(
        *[F.col("vec")[i].alias(c) for i, c in enumerate(features)], F.col("label").alias(label), "synthetic"
    )
