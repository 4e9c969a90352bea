"""Removal of every byte that a 200-byte string repeated elsewhere covers, by merging sorted suffix runs.

Sorting all suffixes of a corpus would exchange each byte up to 200 times. Suffixes are therefore sampled
by content: the anchor of a window of ``WINDOW`` bytes is the leftmost of its ``GRAM``-byte strings with the
smallest hash. Equal windows have equal anchors at equal places, so only windows of anchors whose strings
are equal can be equal. Consecutive windows mostly share their anchor; they are handled as one region.

1. Anchors are counted by their hash, pre-aggregated where they are found. Anchors met once are done.
2. If all regions of a hash are the same (a second hash of the region's bytes), all its windows repeat.
3. Else the windows must be told apart. Tasks sort the suffixes at those anchors, front-code the runs
   (length of the prefix shared with the one before, then the rest) and exchange them by anchor. A loser
   tree merges the runs; it knows each head's common prefix with the last output, compares only from
   there, and yields the sorted suffixes with their common prefixes. The bytes before the anchors are
   ranked alike. A window with d bytes before its anchor repeats if another suffix is in its class of
   common prefixes of at least ``WINDOW - d`` and of at least d backwards. That is exact, and needs no pair.
4. Repeated windows come back to their documents, whose covered bytes are cut out.

Step 2 trusts two independent 64-bit hashes together; all else compares bytes.

Defined cases: a null or empty text, or one shorter than a window, loses nothing; repeated rows are
documents of their own, so each is a repeat of the other; a null doc_id is a value like any other; bytes
are cut without regard to characters; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import flat_bytes, partitions, row_bytes, stored, text_or_empty

WINDOW = 200
GRAM = 64
_REACH = WINDOW - GRAM + 1  # grams of a window
PIECE = 1 << 20
_PLACE = np.uint64((1 << 21) - 1)
_BASE = 0x9E3779B97F4A7C15
_ANCHORS = "id long, dk long, h long, d long, at int, off int, n int"
_RUNS = "bucket int, count int, shared binary, rest_length binary, rest binary, before_length binary, before binary, owner binary"
_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place, by doubling."""
    h, width = data.astype(np.uint64) + np.uint64(1), 1
    while width < GRAM:
        h = h[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + h[width:]
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def window_anchors(h: np.ndarray) -> np.ndarray:
    """For every window, the place of the leftmost gram with the smallest hash (its upper bits)."""
    low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= _REACH:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = _REACH - width
    return ((np.minimum(low[:-rest], low[rest:]) if rest else low) & _PLACE).astype(np.int64)


def _regions(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, anchor and its hash, of each region of the texts laid end to end."""
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none, none, none, none.astype(np.uint64)
    h = gram_hashes(data)
    anchor = window_anchors(h)
    inside = np.maximum(lengths - WINDOW + 1, 0)
    valid = np.repeat(np.tile([True, False], len(lengths)), np.stack([inside, lengths - inside], 1).reshape(-1))[: len(anchor)]
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, none, none.astype(np.uint64)
    anchor = anchor[at]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
    first = np.flatnonzero(new)
    return at[first], np.diff(first, append=len(at)), anchor[first], h[anchor[first]]


def _text_pieces(starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first row, end row, first byte, end byte) of pieces; a long text becomes several that overlap by a window less one."""
    row, rows = 0, len(starts) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(starts, starts[row] + PIECE, side="right")) - 1)
        begin, end = int(starts[row]), int(starts[stop])
        while end - begin > PIECE + WINDOW and stop == row + 1:
            yield row, stop, begin, begin + PIECE + WINDOW - 1
            begin += PIECE
        yield row, stop, begin, end
        row = stop


def _anchor_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    data, starts = flat_bytes(batch.column("text"))
    for row, stop, begin, end in _text_pieces(starts):
        bounds = np.clip(starts[row : stop + 1], begin, end)
        piece = data[begin:end]
        first, n, anchor, h = _regions(piece, np.diff(bounds))
        if not len(first):
            continue
        whole, digest = piece.tobytes(), xxhash.xxh3_64_intdigest
        d = np.array([digest(whole[a:b]) for a, b in zip(first.tolist(), (first + n + WINDOW - 1).tolist(), strict=True)], np.uint64)
        owner = row + np.searchsorted(bounds, first + begin, side="right") - 1
        take = pa.array(owner)
        columns = [batch.column("id").take(take), batch.column("dk").take(take), h.view(np.int64), d.view(np.int64), (first + begin - starts[owner]).astype(np.int32), (anchor - first).astype(np.int32), n.astype(np.int32)]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["id", "dk", "h", "d", "at", "off", "n"])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a key that tells rows apart unless they are alike."""
    text = text_or_empty()
    return docs.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("doc_id", text).alias("dk"))


def anchors(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _anchor_rows(batch)

    return rows.select("id", "dk", "text").mapInArrow(run, _ANCHORS)


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no comparison."""
    end = min(len(a), len(b))
    while known < end and a[known : known + 16] == b[known : known + 16]:
        known += 16
    while known < end and a[known] == b[known]:
        known += 1
    return min(known, end)


def front_code(suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of sorted strings: the length shared with the one before, and the rest."""
    shared = [0, *map(common_prefix, suffixes, suffixes[1:])][: len(suffixes)]
    return shared, [s[k:] for s, k in zip(suffixes, shared, strict=True)]


def merge_runs(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, int]]:
    """Merge front-coded sorted runs by a loser tree: (run, place in it, common prefix with the output before).

    ``known[r]`` is the common prefix of run r's head with the winner it last lost to, or with the last
    output if it is on the way up; of two heads the one that shares more with that string is smaller.
    """
    count = max(1, len(runs))
    heads, known, place = [b""] * count, [-1] * count, [0] * count
    for r, (_, rest) in enumerate(runs):
        if rest:
            heads[r], known[r] = rest[0], 0
    losers = [-1] * count

    def play(x: int, y: int) -> tuple[int, int]:
        """Winner and loser; the loser learns its common prefix with the winner."""
        if known[x] != known[y]:
            return (x, y) if known[x] > known[y] else (y, x)
        if known[x] < 0:
            return x, y
        a, b = heads[x], heads[y]
        same = common_prefix(a, b, known[x])
        if same < len(b) and (same == len(a) or a[same] < b[same]):
            known[y] = same
            return x, y
        if same == len(a) == len(b):
            known[y] = same
            return x, y
        known[x] = same
        return y, x

    def build(node: int) -> int:
        if node >= count:
            return node - count
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if count > 1 else 0
    while known[winner] >= 0:
        yield winner, place[winner], known[winner]
        shared, rest = runs[winner]
        k = place[winner] = place[winner] + 1
        if k < len(rest):
            heads[winner], known[winner] = heads[winner][: shared[k]] + rest[k], shared[k]
        else:
            known[winner] = -1
        node = (winner + count) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def _ends(lengths: np.ndarray) -> list[int]:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).tolist()


def _cut(data: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = _ends(lengths)
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


_OWNER = np.dtype([("id", "<i8"), ("dk", "<i8"), ("at", "<i4"), ("off", "u1"), ("n", "u1")])


def _run_rows(batch: pa.RecordBatch, buckets: int) -> Iterator[pa.RecordBatch]:
    """Sorted, front-coded runs of the suffixes at the listed anchors of a batch of documents, one per bucket."""
    found: dict[int, list[tuple[bytes, bytes, tuple]]] = {}
    names = ("id", "dk", "hs", "spots")
    for text, id_, dk, hs, spots in zip(row_bytes(batch.column("text")), *(batch.column(c).to_pylist() for c in names), strict=True):
        for h, spot in zip(hs, spots, strict=True):
            at, off, n = spot >> 16, spot >> 8 & 255, spot & 255
            found.setdefault(h % buckets, []).append((text[at + off : at + n - 1 + WINDOW], text[at : at + off], (id_, dk, at, off, n)))
    for bucket, items in found.items():
        items.sort()
        shared, rest = front_code([i[0] for i in items])
        before = [i[1] for i in items]
        lengths = lambda parts: np.array([len(p) for p in parts], np.uint8).tobytes()
        yield pa.RecordBatch.from_pylist([{"bucket": bucket, "count": len(items), "shared": np.array(shared, np.uint8).tobytes(), "rest_length": lengths(rest), "rest": b"".join(rest), "before_length": lengths(before), "before": b"".join(before), "owner": np.array([i[2] for i in items], _OWNER).tobytes()}], schema=_RUN_SCHEMA)


_RUN_SCHEMA = pa.schema([("bucket", pa.int32()), ("count", pa.int32()), *((n, pa.binary()) for n in ("shared", "rest_length", "rest", "before_length", "before", "owner"))])


def repeated_windows(shared: np.ndarray, before: list[bytes], off: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which windows repeat, of suffixes in sorted order with their common prefixes: a row of flags by distance before the anchor."""
    count = len(before)
    backwards = [b[::-1] for b in before]
    order = np.array(sorted(range(count), key=backwards.__getitem__), np.int64)
    common = np.array([0, *(common_prefix(backwards[a], backwards[b]) for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True))], np.int64)
    flags = np.zeros((count, _REACH), bool)
    left = np.empty(count, np.int64)
    for back in range(_REACH):
        some = np.flatnonzero((off - n < back) & (back <= off))
        if len(some) < 2:
            continue
        right = np.cumsum(shared < WINDOW - back)
        left[order] = np.cumsum(common < back)
        _, kind, size = np.unique(right[some] * (count + 1) + left[some], return_inverse=True, return_counts=True)
        flags[some, back] = size[kind] > 1
    return flags


def _merged(runs: list[dict]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of one bucket, as ranges of their documents."""
    coded, owners, befores = [], [], []
    for run in runs:
        coded.append((list(run["shared"]), _cut(run["rest"], np.frombuffer(run["rest_length"], np.uint8))))
        owners.append(np.frombuffer(run["owner"], _OWNER))
        befores.append(_cut(run["before"], np.frombuffer(run["before_length"], np.uint8)))
    merged = list(merge_runs(coded))
    starts = _ends(np.array([len(o) for o in owners]))
    at = np.array([starts[r] + k for r, k, _ in merged], np.int64)
    shared = np.array([s for _, _, s in merged], np.int64)
    owner = np.concatenate(owners)[at]
    before = [befores[r][k] for r, k, _ in merged]
    off, n = owner["off"].astype(np.int64), owner["n"].astype(np.int64)
    # Suffixes that share less than a gram with both neighbours are alone; groups are taken a few at a time.
    group = np.cumsum(shared < GRAM)
    cuts = [0]
    edges = np.flatnonzero(np.diff(group)) + 1
    for edge in edges.tolist():
        if edge - cuts[-1] >= 20_000:
            cuts.append(edge)
    cuts.append(len(at))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a < 2:
            continue
        part = shared[a:b].copy()
        part[0] = 0
        rows, back = np.nonzero(repeated_windows(part, before[a:b], off[a:b], n[a:b]))
        if not len(rows):
            continue
        window = owner["at"][a:b][rows].astype(np.int64) + off[a:b][rows] - back
        order = np.lexsort((window, rows))
        rows, window = rows[order], window[order]
        new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (window[1:] != window[:-1] + 1)])
        first = np.flatnonzero(new)
        length = np.diff(first, append=len(rows))
        yield pa.RecordBatch.from_arrays([pa.array(owner["id"][a:b][rows[first]]), pa.array(owner["dk"][a:b][rows[first]]), pa.array(window[first] << 8 | length)], ["id", "dk", "range"])


def told_apart(rows: DataFrame, mixed: DataFrame) -> DataFrame:
    """id, dk, range: repeated windows among anchors whose regions differ; a range is first window * 256 + number."""
    spark = rows.sparkSession
    buckets = 8 * partitions(spark)
    spot = F.col("at").cast("long") * 65536 + F.col("off") * 256 + F.col("n")
    # A set: rows alike list the same spots, and each of them lays out its own.
    lists = mixed.groupBy("id", "dk").agg(F.collect_set(F.struct("h", spot.alias("spot"))).alias("s")).select("id", "dk", F.col("s.h").alias("hs"), F.col("s.spot").alias("spots"))
    laid = rows.select("id", "dk", "text").join(lists, ["id", "dk"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _run_rows(batch, buckets)

    runs = laid.mapInArrow(emit, _RUNS).repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for run in batch.to_pylist():
                if held and run["bucket"] != held[0]["bucket"]:
                    yield from _merged(held)
                    held = []
                held.append(run)
        if held:
            yield from _merged(held)

    return runs.mapInArrow(merge, "id long, dk long, range long")


def repeated_ranges(rows: DataFrame) -> DataFrame:
    """id, dk, ranges: the repeated windows of every document that has any."""
    found = anchors(rows)
    keys = found.groupBy("h").agg(F.count("*").alias("c"), F.min("d").alias("low"), F.max("d").alias("high")).where("c > 1").select("h", (F.col("low") != F.col("high")).alias("mixed"))
    keys = stored(keys, "keys")  # apart from the aggregate's placement, the join's hot partitions can be split
    marked = stored(found.select("id", "dk", "h", "at", "off", "n").join(keys, "h"), "anchors")
    alike = marked.where("NOT mixed").select("id", "dk", (F.col("at").cast("long") * 256 + F.col("n")).alias("range"))
    return alike.unionByName(told_apart(rows, marked.where("mixed"))).groupBy("id", "dk").agg(F.collect_list("range").alias("ranges"))


def covered(ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs of bytes that windows cover."""
    begin = np.sort(ranges)
    begin, end = begin >> 8, (begin >> 8) + (begin & 255) - 1 + WINDOW
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], begin[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return begin[first], reach[np.append(first[1:], len(begin)) - 1]


def _cut_out(text: bytes, ranges: list[int] | None) -> tuple[bytes, int, int]:
    """The text without its covered bytes, how many were covered, and in how many runs."""
    if not ranges:
        return text, 0, 0
    begins, ends = covered(np.array(ranges, np.int64))
    kept, at = [], 0
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    left = b"".join(kept)
    return left, len(text) - len(left), len(begins)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, and the kept bytes as ``kept``."""
    rows = keyed(docs)
    ranges = stored(repeated_ranges(rows), "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(len(text), *_cut_out(text, r)) for text, r in zip(row_bytes(batch.column("text")), batch.column("ranges").to_pylist(), strict=True)]
            columns = [pa.array([x[0] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.int64()), pa.array([hashlib.sha256(x[1]).hexdigest() for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.join(ranges, ["id", "dk"], "left").select("doc_id", "text", "ranges").mapInArrow(run, f"{_OUT}, kept binary")
