"""SimHash fingerprints of word shingles, linked within a few differing bits, by pigeonring filtering.

The 64 bits are cut into segments laid out as a ring. If two fingerprints differ in at most ``bits``
positions, some segment starts a chain in which every prefix of l segments differs in at most
``l * bits / segments`` positions. With 2 bits and 5 segments that is two equal segments, then at most
one differing bit over the third and fourth, then at most two over all. The equal start of the chain is
the key that candidates meet by, the rest of the chain prunes them before the full Hamming distance.

Only distinct fingerprints are compared, so copies cost nothing. Runs of more than ``PAIRWISE``
fingerprints under one key are linked through the values one bit away from each, which finds every link
up to two bits without a pair for each two members.

Defined cases: words are maximal runs without white space, A-Z lowered; a text with fewer words than a
shingle is one shingle; a text without words, or null, has fingerprint zero, linked like any other;
repeated rows share a component; a null doc_id keeps its row and is passed over for the smallest id; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import partitions, row_bytes, stored
from millrace.llm.components import components

SHINGLE = 3
BITS = 2
SEGMENTS = 5
SEED = 42
PAIRWISE = 64
_PIECE = 1 << 20


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, at most about a megabyte of it at a time."""
    at = 0
    while len(text) - at > _PIECE:
        cut = next((k for k in range(at + _PIECE, len(text)) if text[k] in b" \t\n\x0b\x0c\r"), len(text))
        yield text[at:cut].split()
        at = cut
    yield text[at:].split()


def shingle_hashes(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> Iterator[np.ndarray]:
    """Hashes of the word shingles of a text, a piece at a time; a text of fewer words is one shingle."""
    none, carried = True, []
    few: list[bytes] = []
    for words in _pieces(text.lower()):
        words = carried + words
        carried = words[-(shingle - 1) :] if shingle > 1 else []
        if len(words) < shingle:
            few = words
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        of = xxhash.xxh64_intdigest
        yield np.array([of(line[a:b], seed) for a, b in zip(begins.tolist(), ends[shingle - 1 :].tolist())], np.uint64)
        none = False
    if none and few:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(few), seed)], np.uint64)


def majority(pieces: Iterable[np.ndarray]) -> int:
    """The bits that most of the hashes have set."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in pieces:
        total += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * ones > total).tolist())


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, shingle, seed) for t in row_bytes(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(values)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _ring(segments: int) -> list[tuple[int, list[int]]]:
    """For each start segment: how far to rotate left, and the widths from there on."""
    widths = [64 // segments + (k < 64 % segments) for k in range(segments)]
    return [(sum(widths[:k]), widths[k:] + widths[:k]) for k in range(segments)]


def _budgets(bits: int, segments: int) -> list[int]:
    return [bits * l // segments for l in range(1, segments + 1)]


def _equal_start(widths: list[int], bits: int) -> int:
    """Bits at the head of the ring that a chain must have equal."""
    return sum(w for w, budget in zip(widths, _budgets(bits, len(widths)), strict=True) if budget == 0)


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by)) if by else x


def _near(x: np.ndarray, y: np.ndarray, widths: list[int], bits: int) -> np.ndarray:
    """Which pairs keep every prefix of the chain within its budget; the last prefix is the full distance."""
    differ, keep, upto = x ^ y, np.ones(len(x), bool), 0
    for width, budget in zip(widths, _budgets(bits, len(widths)), strict=True):
        upto += width
        if budget or upto == 64:
            keep &= np.bitwise_count(differ >> np.uint64(64 - upto)) <= budget
    return keep


def _links(start: int, ring: np.ndarray, segments: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among sorted rotated fingerprints that have one start segment."""
    _, widths = _ring(segments)[start]
    head = _equal_start(widths, bits)
    key = ring >> np.uint64(64 - head)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    length = np.diff(first, append=len(ring))
    big = (length > PAIRWISE) & (bits == 2)
    a, b = [], []
    small = np.repeat(~big, length)
    run = np.repeat(np.arange(len(first)), length)[small]
    some = ring[small]
    for step in range(1, int(length[~big].max(initial=1))):
        at = np.flatnonzero(run[step:] == run[:-step])
        at = at[_near(some[at], some[at + step], widths, bits)]
        a.append(some[at])
        b.append(some[at + step])
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64 - head, dtype=np.uint64)])
    for f, n in zip(first[big].tolist(), length[big].tolist(), strict=True):
        group = ring[f : f + n]
        values = (group[:, None] ^ flips[None, :]).reshape(-1)
        order = np.argsort(values, kind="stable")
        same = np.flatnonzero(values[order][1:] == values[order][:-1])
        owner = order // len(flips)
        a.append(group[owner[same]])
        b.append(group[owner[same + 1]])
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def links(distinct: DataFrame, bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """Edges a, b that connect all distinct fingerprints ``fp`` within ``bits`` of each other."""
    rings = F.array(*[F.struct(F.lit(k).alias("start"), (F.shiftleft("fp", by).bitwiseOR(F.shiftrightunsigned("fp", 64 - by)) if by else F.col("fp")).alias("ring"), F.lit(_equal_start(widths, bits)).alias("head")) for k, (by, widths) in enumerate(_ring(segments))])
    rows = distinct.select(F.explode(rings).alias("r")).select("r.start", "r.ring", F.expr("shiftrightunsigned(r.ring, 64 - r.head)").alias("key"))
    rows = rows.repartition(partitions(distinct.sparkSession), "start", "key").sortWithinPartitions("start", "key", "ring")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def found(starts: np.ndarray, rings_: np.ndarray) -> Iterator[pa.RecordBatch]:
            for start in np.unique(starts).tolist():
                a, b = _links(start, rings_[starts == start], segments, bits)
                back = (64 - _ring(segments)[start][0]) % 64
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(_rotate(x, back).view(np.int64)) for x in (a, b)], ["a", "b"])

        for batch in batches:
            columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("start", "key", "ring")]
            if not batch.num_rows:
                continue
            held.append((columns[0], columns[1], columns[2].view(np.uint64)))
            # Everything before the last key is complete.
            if sum(len(h[0]) for h in held) >= 1 << 18:
                s, k, r = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.flatnonzero((k != k[-1]) | (s != s[-1]))[-1]) + 1 if ((k != k[-1]) | (s != s[-1])).any() else 0
                yield from found(s[:cut], r[:cut])
                held = [(s[cut:], k[cut:], r[cut:])]
        if held:
            s, _, r = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from found(s, r)

    return rows.mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """doc_id, fp, component_id: the smallest document id reachable over links, its own included."""
    marked = stored(fingerprints(docs, shingle), "simhash")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    reached = components(links(distinct.select("fp"), bits, segments))
    joined = distinct.join(reached, distinct.fp == reached.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    joined = stored(joined, "simhash-components")
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    names = joined.join(least, "component").select("fp", "component_id")
    return marked.join(names, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """The documents without those that have a smaller id in their group; rows that repeat the kept id stay one."""
    gone = groups(docs, **settings).where("doc_id > component_id").select(F.col("doc_id").alias("_gone")).distinct()
    kept = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    return kept
