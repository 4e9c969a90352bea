"""Spelling variants: words one edit apart, found in k-d trees over letter counts.

A word is the vector of how often it holds each letter. One replaced letter changes two counts by one, one
inserted or deleted letter changes one, so words one edit apart are at a distance (sum of differences) of
at most two if they are equally long and of one if their lengths differ by one. Words of each length are
cut into cells by a k-d tree fitted on a bounded sample; a word looks into each cell of its own length and
of the lengths beside it whose box is within that distance. In a cell a tree over the cell's own
words is searched for all of them at once, and subtrees whose box lies too far away are left out. Only what the
boxes leave is compared letter by letter. Cells hand on one row per word that looked in, with the number of
near words and the best of them, so no pairs are laid out.

A word belongs to one cell, so each near pair is met exactly once from either side. A length of few words
is one cell. A cell holds about ``CELL`` words of which only equal vectors cannot be cut apart.

Defined cases: a null text has no words; a null doc_id is the empty text in front of the colon; repeated rows
count each; an empty table gives an empty table; columns besides the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import by_bytes, flat_bytes, stored
from millrace.llm.packed_ids import _distinct_words

SHORTEST = 6
SEEN = 5
RATIO = 5
EVERY = 199
CELL = 1 << 15  # words of a cell, as the sample promises
SAMPLE = 1 << 17  # words that the cells are fitted on
LEAF = 48
PIECE = 8 << 20
_DIMENSIONS = 32  # a to z, and accented letters folded into six
_PAIRS = 1 << 18  # comparisons laid out at a time

Cell = tuple[int, int, object, object] | int  # (dimension, bound, at most the bound, above it), or the number of a cell


# words and their numbers


def _crc_table() -> np.ndarray:
    """The checksum's step for each byte, from its polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()
_LONG = 48  # bytes beyond which a run's checksum is left to zlib


def _letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to A-Z, a-z or U+00C0 to U+00FF, which UTF-8 spells C3 and one more."""
    inside = ((data | 32) >= 97) & ((data | 32) <= 122)
    accent = np.flatnonzero(data == 0xC3)
    inside[accent] = inside[accent + 1] = True
    return inside


def checksums(data: np.ndarray, begin: np.ndarray, length: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The crc32 of runs of bytes, each going on from the checksum before it; all runs advance together."""
    out = ~before
    order = np.argsort(-length, kind="stable")
    order = order[np.searchsorted(-length[order], -_LONG) :]
    at, state, left = begin[order], out[order], length[order]
    most = int(left[0]) if len(left) else 0
    active = len(left) - np.searchsorted(left[::-1], np.arange(1, most + 1))
    for step, n in enumerate(active.tolist()):
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + step]) & 0xFF] ^ state[:n] >> np.uint32(8)
    out[order] = state
    out = ~out
    for k in np.flatnonzero(length > _LONG).tolist():
        out[k] = zlib.crc32(data[begin[k] : begin[k] + length[k]].tobytes(), int(before[k]))
    return out


def _counted(data: np.ndarray, starts: np.ndarray, ids: list, every: int, shortest: int) -> pa.RecordBatch:
    """word, n of a batch of texts."""
    inside = _letters(data) if len(data) else np.zeros(0, bool)
    first = np.zeros(len(data) + 1, bool)
    first[starts[:-1]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    at = np.flatnonzero(begins)
    if not len(at):
        return pa.RecordBatch.from_arrays([pa.array([], pa.string()), pa.array([], pa.int64())], ["word", "n"])
    letters = data[inside]
    letters[(letters >= 65) & (letters <= 90)] |= 32
    begin = np.cumsum(inside)[at] - 1
    length = np.diff(begin, append=len(letters))
    prefixes = np.array([zlib.crc32(f"{'' if k is None else k}:".encode()) for k in ids], np.uint32)
    h = checksums(letters, begin, length, prefixes[np.searchsorted(starts, at, side="right") - 1]).astype(np.int64)
    distinct, kind = _distinct_words(letters, begin, length)
    changed = np.flatnonzero(h % every == 0)
    n = np.bincount(kind, minlength=len(distinct))
    np.subtract.at(n, kind[changed], 1)
    whole = letters.tobytes()
    words = [whole[a:b].decode() for a, b in zip(begin[distinct].tolist(), (begin[distinct] + length[distinct]).tolist(), strict=True)]
    made = []
    for k in changed.tolist():
        word = words[kind[k]]
        cut = int(h[k]) % len(word)
        made.append(word[:cut] + word[cut + 1 :])
    rows = [(w, c) for w, c in zip([*words, *made], [*n.tolist(), *[1] * len(made)], strict=True) if c and len(w) >= shortest]
    return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.int64())], ["word", "n"])


def word_counts(docs: DataFrame, every: int = EVERY, shortest: int = SHORTEST, seen: int = SEEN) -> DataFrame:
    """word, n: runs of letters of whole texts, a known share of them misspelt by their checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, PIECE):
            yield _counted(*flat_bytes(batch.column("text")), batch.column("doc_id").to_pylist(), every, shortest)

    counts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= seen)


# letter counts and trees over them


def spelled(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of equally long words, a row each; and their counts."""
    letters = np.array(words.to_pylist(), dtype=str)
    letters = letters.view(np.uint32).reshape(len(letters), -1) if len(letters) else np.zeros((0, 1), np.uint32)
    dimension = np.where(letters < 0xC0, (letters - 97) % 26, 26 + letters % 6).astype(np.int64)
    counts = np.zeros((len(letters), _DIMENSIONS), np.int32)
    for column in dimension.T:
        counts[np.arange(len(letters)), column] += 1
    return letters, counts


def _cut(counts: np.ndarray) -> tuple[int, int] | None:
    """The dimension and bound that part these words most evenly; none if all are alike."""
    middle = np.median(counts, axis=0).astype(np.int64)
    best, found = 0, None
    for bound in (middle, middle - 1):
        below = (counts <= bound).sum(0)
        part = np.minimum(below, len(counts) - below)
        k = int(part.argmax())
        if part[k] > best:
            best, found = int(part[k]), (k, int(bound[k]))
    return found


def fit_cells(counts: np.ndarray, words: int, cell: int, number: Iterator[int]) -> Cell:
    """A tree whose leaves hold about ``cell`` of all ``words`` words each, fitted on a sample's counts."""
    found = _cut(counts) if words > cell and len(counts) > 1 else None
    if found is None:
        return next(number)
    below = counts[:, found[0]] <= found[1]
    share = int(words * below.mean())
    return (*found, fit_cells(counts[below], share, cell, number), fit_cells(counts[~below], words - share, cell, number))


def reached(tree: Cell, counts: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each cell with the rows whose distance to its box is at most ``radius``."""

    def walk(node: Cell, rows: np.ndarray, off: np.ndarray, low: dict, high: dict) -> Iterator[tuple[int, np.ndarray]]:
        if not len(rows):
            return
        if isinstance(node, int):
            yield node, rows
            return
        dimension, bound, left, right = node
        value = counts[rows, dimension]
        # How far the rows already are from the box in this dimension, and how far from each half.
        was = np.maximum(0, np.maximum(low.get(dimension, -1) - value, value - high.get(dimension, 1 << 30)))
        lower, upper = np.maximum(was, value - bound), np.maximum(was, bound + 1 - value)
        for child, far, box in ((left, lower, (low, high | {dimension: bound})), (right, upper, (low | {dimension: bound + 1}, high))):
            total = off + far - was
            keep = total <= radius
            yield from walk(child, rows[keep], total[keep], *box)

    yield from walk(tree, np.arange(len(counts)), np.zeros(len(counts), np.int64), {}, {})


def _one_edit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of letters are one edit apart; rows of y are as long as those of x, or one longer."""
    if x.shape[1] == y.shape[1]:
        return (x != y).sum(1) == 1
    n = x.shape[1]
    head = np.cumprod(x == y[:, :n], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
    tail = np.cumprod(x[:, ::-1] == y[:, :0:-1], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
    return head + tail >= n


class Tree:
    """The words of a cell in a k-d tree with boxes; equal vectors share a leaf, whatever their number."""

    def __init__(self, letters: np.ndarray, counts: np.ndarray) -> None:
        self.letters, self.counts = letters, counts
        self.order = np.arange(len(letters))
        # of each node: from, to, box, and its first child (the second is next), or -1
        self.nodes: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        self.child: list[int] = []
        if len(letters):
            self._add(0, len(letters))
        for node in self.nodes:  # grows while it is read
            a, b = node[:2]
            rows = self.order[a:b]
            found = _cut(counts[rows]) if b - a > LEAF else None
            if found:
                below = counts[rows, found[0]] <= found[1]
                self.order[a:b] = np.concatenate([rows[below], rows[~below]])
                middle = a + int(below.sum())
                self.child.append(len(self.nodes))
                self._add(a, middle)
                self._add(middle, b)
            else:
                self.child.append(-1)

    def _add(self, a: int, b: int) -> None:
        counts = self.counts[self.order[a:b]]
        self.nodes.append((a, b, counts.min(0), counts.max(0)))

    def near(self, letters: np.ndarray, counts: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of (row that asks, word of the tree) one edit apart."""
        waiting = [(0, np.arange(len(letters)))] if self.nodes and len(letters) else []
        while waiting:
            node, rows = waiting.pop()
            (a, b, low, high), child = self.nodes[node], self.child[node]
            asked = counts[rows]
            off = np.maximum(low - asked, 0).sum(1) + np.maximum(asked - high, 0).sum(1)
            rows = rows[off <= radius]
            if not len(rows):
                continue
            if child >= 0:
                waiting += [(child, rows), (child + 1, rows)]
                continue
            step = max(1, _PAIRS // (b - a))
            for k in range(0, len(rows), step):
                yield from self._verified(rows[k : k + step], self.order[a:b], letters, counts, radius)

    def _verified(self, rows: np.ndarray, own: np.ndarray, letters: np.ndarray, counts: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        apart = np.zeros((len(rows), len(own)), np.int32)
        mine, theirs = self.counts[own], counts[rows]
        for d in np.flatnonzero((mine.max(0) != mine.min(0)) | (theirs.max(0) != theirs.min(0)) | (mine[0] != theirs[0])).tolist():
            apart += np.abs(theirs[:, d][:, None] - mine[:, d][None, :])
        i, j = np.nonzero(apart <= radius)
        x, y = letters[rows[i]], self.letters[own[j]]
        close = _one_edit(x, y) if x.shape[1] <= y.shape[1] else _one_edit(y, x)
        if close.any():
            yield rows[i[close]], own[j[close]]


# the search as a Spark job


def cells(words: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> dict[int, Cell]:
    """A tree per length that has more words than a cell, fitted on at most ``sample`` words of all."""
    sizes = {r.length: r.w for r in words.groupBy(F.char_length("word").alias("length")).agg(F.count("*").alias("w")).where(F.col("w") > cell).collect()}
    if not sizes:
        return {}
    rate = min(1.0, sample / sum(sizes.values()))
    # A share of the words by their hash; the bound holds twice over what the share promises.
    some = words.where(F.char_length("word").isin(list(sizes)) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1)).select("word").limit(2 * sample).toArrow().column("word").combine_chunks()
    lengths = np.array([len(w) for w in some.to_pylist()])
    trees = {}
    for length, count in sorted(sizes.items()):
        rows = some.take(pa.array(np.flatnonzero(lengths == length)))
        if len(rows):
            trees[length] = fit_cells(spelled(rows)[1], count, cell, iter(range(1 << 30)))
    return trees


_SENT = "length int, cell int, own boolean, word string, n long"
_FOUND = "word string, n_near long, best_n long, best string"


def sent(words: DataFrame, trees: dict[int, Cell]) -> DataFrame:
    """Each word to its own cell, and to the cells of three lengths that it has to look into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("word")
            lengths = np.array([len(w) for w in column.to_pylist()], np.int64)
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                some = batch.take(pa.array(at))
                counts = spelled(some.column("word"))[1]
                for target, radius, own in ((length, 0, True), (length, 2, False), (length - 1, 1, False), (length + 1, 1, False)):
                    for cell, rows in reached(trees.get(target, 0), counts, radius):
                        part = some.take(pa.array(rows))
                        n = len(rows)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, target), pa.int32()), pa.array(np.full(n, cell), pa.int32()), pa.array(np.full(n, own)), part.column("word"), part.column("n")], ["length", "cell", "own", "word", "n"])

    return words.select("word", "n").mapInArrow(run, _SENT)


def _search(group: pa.Table) -> pa.Table:
    """Of every word that looks into a cell how many near words it finds there, and the best of them."""
    own = group.column("own").to_numpy(zero_copy_only=False)
    words, n = group.column("word").combine_chunks(), group.column("n").to_numpy()
    mine = np.flatnonzero(own)
    tree = Tree(*spelled(words.take(pa.array(mine))))
    out: list[pa.Table] = []
    asking = np.flatnonzero(~own) if len(mine) else np.zeros(0, np.int64)
    lengths = np.array([len(w) for w in words.take(pa.array(asking)).to_pylist()], np.int64)
    # Among equally frequent words the first in code-point order is best.
    names = words.take(pa.array(mine)).to_pylist()
    rank = np.empty(len(mine), np.int64)
    rank[sorted(range(len(mine)), key=lambda k: (-n[mine[k]], names[k]))] = np.arange(len(mine))
    for length in np.unique(lengths).tolist():
        rows = asking[lengths == length]
        letters, counts = spelled(words.take(pa.array(rows)))
        near, best = np.zeros(len(rows), np.int64), np.full(len(rows), len(mine), np.int64)
        for x, y in tree.near(letters, counts, 2 if length == tree.letters.shape[1] else 1):
            np.add.at(near, x, 1)
            np.minimum.at(best, x, rank[y])
        hit = np.flatnonzero(near)
        by_rank = np.argsort(rank)
        chosen = mine[by_rank[best[hit]]]
        out.append(pa.table([words.take(pa.array(rows[hit])), pa.array(near[hit]), pa.array(n[chosen]), words.take(pa.array(chosen))], ["word", "n_near", "best_n", "best"]))
    empty = pa.table([pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string())], ["word", "n_near", "best_n", "best"])
    return pa.concat_tables([empty, *out])


def near_words(words: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """word, n_near, best_n, best of every word that has a near word; near words one edit apart."""
    found = sent(words, cells(words, cell, sample)).groupBy("length", "cell").applyInArrow(_search, _FOUND)
    least = F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("least")  # text orders by its UTF-8 bytes, as code points do
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least).select("word", "n_near", (-F.col("least.minus")).alias("best_n"), "least.best")


def roots(forms: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, root of every word with a form: the last of its chain of forms.

    Counts grow by ``ratio`` from form to form, so a chain is short: steps double as often as the largest count allows.
    """
    most = forms.agg(F.max("form_n")).first()[0] or 1
    links, doublings = 1, 0
    while ratio**links <= most:
        links += 1
    while 1 << doublings < links:
        doublings += 1
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(doublings):
        now = stored(now, "spelling-roots")
        next_ = now.select(F.col("word").alias("via"), F.col("root").alias("beyond"))
        now = now.join(next_, now.root == next_.via, "left").select("word", F.coalesce("beyond", "root").alias("root"))
    return now


def variants(docs: DataFrame, shortest: int = SHORTEST, seen: int = SEEN, ratio: int = RATIO, every: int = EVERY, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = stored(word_counts(docs, every, shortest, seen), "spelling-words")
    near = stored(near_words(words, cell, sample), "spelling-near")
    worth = F.col("best_n") >= ratio * F.col("n")
    known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(worth, F.col("best")).alias("form"), F.when(worth, F.col("best_n")).alias("form_n"))
    known = stored(known, "spelling-forms")
    ends = roots(known.where("form IS NOT NULL"), ratio)
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
