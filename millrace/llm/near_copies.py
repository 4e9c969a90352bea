"""Groups of documents whose sets of five-word shingles have a similarity (shared by all) of 0.8 or more, exactly.

Fingerprints of 64 bits cannot promise that: two documents at 0.8 differ in about ten bits, and keys for
that many are too short to be selective. So SimHash links within a few bits are only the first candidates;
the complete ones come from prefixes of the sets. All shingles stand in one order, rare ones first. Two sets
at 0.8 share a shingle among the first n - ceil(0.8 n) + 1 of the larger and the first n - ceil(8 n / 9) + 1
of the smaller one, and the places of the first shared one leave room for the overlap that 0.8 needs.
Every candidate is then checked by the two whole sets, after a check that needs few bytes: of the shingles
each set keeps the parities of 1024 classes, and two parities differ only where a shingle is not shared.

The order may be any; only the number of candidates depends on it. Shingles counted in a sample of the
documents come last, the commonest of all at the end, so that a common passage is no key.

A key gives, whatever its size, only links to its first set and between neighbours by size at first. Copies of one
text are joined by these. Once their groups are known, the pairs of a key that still lie in different groups are
held against each other by size, place and parities where they lie; only those that can be similar leave the task.

Defined cases: words and shingles are those of ``simhash``; sets are compared by 64-bit hashes of the shingles,
and equal sets are one; texts without words are alike; a null doc_id keeps its row and links others; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import simhash
from millrace.llm.common import partitions, row_bytes, stored
from millrace.llm.components import components

SHINGLE = 5
# One document in so many is counted for the order, and shingles seen at least so often come last.
SAMPLED = 16
COMMON = 8
MOST_COMMON = 300_000
# Up to so many sets are named to every task that looks for them; more are joined.
MOST_BROADCAST = 1_000_000
_BLOCK = 1 << 15  # pairs held against each other at a time
_CLASSES = 1024


def shingle_set(text: bytes) -> np.ndarray:
    """The hashes of the shingles, sorted, each once."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *simhash.shingle_hashes(text, SHINGLE)]))


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes())


def _probed(n):
    return n - (4 * n + 4) // 5 + 1


def _indexed(n):
    return n - (8 * n + 8) // 9 + 1


def parities(hashes: np.ndarray) -> bytes:
    """Of each class of hashes, whether their number is odd."""
    odd = np.bincount((hashes % np.uint64(_CLASSES)).astype(np.int64), minlength=_CLASSES) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have 0.8 or more in common."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return not len(y)
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 5 * both >= 4 * (len(x) + len(y) - both)


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, node (names the set), fp of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps = [], []
            for text in row_bytes(batch.column("text")):
                pieces = list(simhash.shingle_hashes(text, SHINGLE))
                nodes.append(_node(np.unique(np.concatenate([np.zeros(0, np.uint64), *pieces]))))
                fps.append(simhash.majority(pieces))
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *longs], ["doc_id", "node", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, node long, fp long")


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample of the documents, sorted, and how frequent in powers of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in row_bytes(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text).view(np.int64))], ["token"])

    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
    counted = some.mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") >= COMMON)
    rows = counted.orderBy(F.desc("c"), "token").limit(MOST_COMMON).toArrow()
    tokens = rows.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.log2(rows.column("c").to_numpy()[order]).astype(np.uint8)


def _prefix(hashes: np.ndarray, common: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of all."""
    n = _probed(len(hashes))
    if not len(common):
        return hashes[:n]
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    last = np.where(common[at] == hashes, level[at].astype(np.int64) + 1, 0)
    return hashes[np.argsort(last, kind="stable")[:n]]


def prefixes(docs: DataFrame) -> DataFrame:
    """node, size, tokens, odd: the prefix and the parities of every distinct set that is not empty."""
    common, level = common_shingles(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for s in map(shingle_set, row_bytes(batch.column("text"))) if len(s)]
            nodes = np.array([_node(s) for s in sets], np.uint64).view(np.int64)
            tokens = [_prefix(s, common, level).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([len(s) for s in sets], pa.int32()), pa.array(tokens, pa.list_(pa.int64())), pa.array([parities(s) for s in sets], pa.binary())], ["node", "size", "tokens", "odd"])

    return docs.select("text").mapInArrow(run, "node long, size int, tokens array<long>, odd binary").dropDuplicates(["node"])


_PAIRS = "a long, b long, token long, size int, at int"


def _fit(small: tuple[np.ndarray, np.ndarray], large: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which pairs of (size, place) can have their first shared shingle here and reach 0.8."""
    (n, p), (m, q) = small, large
    return (5 * n >= 4 * m) & (p < _indexed(n)) & (np.minimum(n - p, m - q) >= (4 * (n + m) + 8) // 9)


def _pair_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64()), none, none], ["a", "b", "token", "size", "at"])


def _first_pairs(token: np.ndarray, node: np.ndarray, size: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of whole keys, sorted by key and size: candidates with the first set and between neighbours; and the rows of keys of three or more."""
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    length = np.diff(first, append=len(token))
    head, place = np.repeat(first, length), np.arange(len(token))
    for other in (head, place - 1):
        k = place[place > head + (other is not head)]
        k = k[_fit((size[other[k]], at[other[k]]), (size[k], at[k]))]
        if len(k):
            yield _pair_rows(node[other[k]], node[k])
    more = np.repeat(length > 2, length)
    if more.any():
        m = int(more.sum())
        yield pa.RecordBatch.from_arrays([pa.array(node[more]), pa.nulls(m, pa.int64()), pa.array(token[more]), pa.array(size[more].astype(np.int32)), pa.array(at[more].astype(np.int32))], ["a", "b", "token", "size", "at"])


def _bits(odd: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(odd.to_pylist()), np.uint64).reshape(-1, _CLASSES // 64)


def _can_be(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether parities differ in no more classes than sets at 0.8, of n shingles together, can have apart."""
    return np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= n - 2 * ((4 * n + 8) // 9)


def _by_key(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """The columns in stretches of whole keys; the first column is the key that the rows are sorted by."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([_bits(batch.column(n)) if n == "odd" else batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names])
        if sum(len(h[0]) for h in held) >= 1 << 16 and held[0][0][0] != held[-1][0][-1]:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.flatnonzero(whole[0] != whole[0][-1])[-1]) + 1
            yield [x[:cut] for x in whole]
            held = [[x[cut:] for x in whole]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def candidates(short: DataFrame) -> DataFrame:
    """Pairs a, b of nodes; and with b null the rows of keys of three or more: node a, token, size, at."""
    rows = short.select("node", "size", F.posexplode("tokens").alias("at", "token"))
    rows = rows.repartition(partitions(short.sparkSession), "token").sortWithinPartitions("token", "size", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _by_key(batches, ("token", "node", "size", "at")):
            yield from _first_pairs(*columns)

    return rows.mapInArrow(run, _PAIRS)


def _apart(token: np.ndarray, node: np.ndarray, size: np.ndarray, at: np.ndarray, group: np.ndarray, odd: np.ndarray) -> Iterator[pa.RecordBatch]:
    """All candidates of whole keys whose sets are in different groups and can be similar."""
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])).tolist()
    for f, e in zip(first, [*first[1:], len(token)], strict=True):
        if (group[f:e] == group[f]).all():
            continue
        rows = max(1, _BLOCK // (e - f))
        for b in range(f, e, rows):
            x = np.arange(b, min(e, b + rows))[:, None]
            y = np.arange(b, e)[None, :]
            i, j = np.nonzero((x < y) & (group[x] != group[y]) & _fit((size[x], at[x]), (size[y], at[y])))
            i, j = i + b, j + b
            keep = _can_be(odd[i], odd[j], size[i] + size[j])
            if keep.any():
                yield _pair_rows(node[i[keep]], node[j[keep]])


def remaining(crowded: DataFrame, linked: DataFrame, short: DataFrame) -> DataFrame:
    """Pairs of a key that the links found so far leave in different groups, and that can be similar."""
    reached = stored(components(linked), "near-components")
    rows = crowded.join(reached, crowded.a == reached.node, "left").select("token", "a", "size", "at", F.coalesce("component", "a").alias("component"))
    rows = rows.join(short.select(F.col("node").alias("a"), "odd"), "a")
    rows = rows.repartition(partitions(crowded.sparkSession), "token").sortWithinPartitions("token", "size", "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _by_key(batches, ("token", "a", "size", "at", "component", "odd")):
            yield from _apart(*columns)

    return rows.mapInArrow(run, _PAIRS).select("a", "b").distinct()


def possible(pairs: DataFrame, short: DataFrame) -> DataFrame:
    """The pairs a, b whose parities do not differ in more classes than sets at 0.8 can have shingles apart."""
    x, y = (short.select(F.col("node").alias(k), F.col("size").alias(f"{k}_size"), F.col("odd").alias(f"{k}_odd")) for k in ("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = sum(batch.column(f"{k}_size").to_numpy(zero_copy_only=False).astype(np.int64) for k in ("a", "b"))
            yield batch.select(["a", "b"]).filter(pa.array(_can_be(_bits(batch.column("a_odd")), _bits(batch.column("b_odd")), n)))

    return pairs.join(x, "a").join(y, "b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs a, b whose whole sets are similar."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t) for t in row_bytes(batch.column("text"))]
            nodes = np.array([_node(s) for s in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "hashes"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = stored(pairs, "near-pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = stored(asked, "near-asked")
    if asked.count() <= MOST_BROADCAST:
        asked = F.broadcast(asked)
    whole = docs.select("text").mapInArrow(sets, "node long, hashes binary").join(asked, "node", "left_semi").dropDuplicates(["node"])
    whole = stored(whole, "near-sets")
    x, y = whole.select(F.col("node").alias("a"), F.col("hashes").alias("x")), whole.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    return stored(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "near-links")


def _fingerprint_pairs(marks: DataFrame) -> DataFrame:
    """Sets with one fingerprint, and the first sets of fingerprints within SimHash's bits."""
    names = stored(marks.groupBy("fp", "node").agg(F.lit(1)).select("fp", "node"), "near-names")
    first = names.groupBy("fp").agg(F.min("node").alias("first"))
    same = names.join(first, "fp").select(F.col("first").alias("a"), F.col("node").alias("b")).where("a <> b")
    linked = simhash.links(first.select("fp"))
    a, b = first.select(F.col("fp").alias("a"), F.col("first").alias("x")), first.select(F.col("fp").alias("b"), F.col("first").alias("y"))
    near = linked.join(a, "a").join(b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.unionByName(near)


def links(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs a, b of similar nodes that connect every two that are similar."""
    short = stored(prefixes(docs), "near-prefixes")
    found = stored(candidates(short), "near-candidates")
    pairs = found.where("b IS NOT NULL").select("a", "b").unionByName(_fingerprint_pairs(marks)).distinct()
    linked = confirmed(possible(pairs, short), docs)
    crowded = found.where("b IS NULL")
    if crowded.isEmpty():
        return linked
    return linked.unionByName(confirmed(remaining(crowded, linked, short), docs))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, component_id: the smallest document id reachable over links, its own included."""
    marks = stored(marked(docs), "near-marks")
    reached = components(links(docs, marks))
    first = marks.groupBy("node").agg(F.min("doc_id").alias("first"))
    joined = first.join(reached.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    joined = stored(joined, "near-groups")
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    return marks.join(joined.join(least, "component").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without those that have a smaller id in their group; rows that repeat the kept id stay one."""
    gone = groups(docs).where("doc_id > component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
