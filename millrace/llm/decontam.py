"""Benchmark decontamination by spaced-seed hashing, with column expressions only.

A seed is the hash of the words at the places of a fixed mask; the places between are ignored. The two
masks (six of eight words each) are chosen so that any 13 words of which two are substituted still hold
a hit. Seeds of the documents meet seeds of the benchmark in a join. Around every hit, document and item
are laid side by side and an overlap is confirmed if some window of 13 words (or the whole item, if it
is shorter) has 0.8 or more of its words equal.

An item of fewer words has masks of its own length: with s words that may differ it is cut into s + 2
blocks, and each mask keeps two of them, so that s substitutions always leave one mask whole. Items
without such words (1 to 4) are one hash. Documents carry those masks only for lengths that items have.

The benchmark's seeds are broadcast if their counted number is at most ``MOST_BROADCAST``; beyond that the
join is shuffled, and adaptive execution splits seeds that are common in the documents.

Defined cases: words are lowered and separated by white space; a null or empty text matches nothing; repeated documents are reported by id once per item; a null
doc_id or item_id is a value like any other; an empty table on either side gives an empty table; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored

MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
WINDOW = 13
SHARE = 0.8
MOST_BROADCAST = 1_000_000
_BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    return F.split(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_BLANKS)), r"[\x20\x09-\x0D]+")


def seeded(rows: DataFrame, key: str, masks=MASKS) -> DataFrame:
    """key, at, seed: one row per mask and place where the masks fit; masks span the same number of words."""
    span = masks[0][-1]
    if any(m[0] != 0 or m[-1] != span for m in masks):
        raise ValueError("masks must begin at 0 and span the same number of words")
    hashed = rows.select(key, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    # The words of a place side by side, so that all that follows is generated code over plain numbers.
    # The outer form: an inner explode makes the optimizer compute the array twice, to filter on its size.
    offsets = sorted({k for m in masks for k in m})
    count = F.greatest(F.size("h") - span, F.lit(0))
    beside = F.arrays_zip(*[F.slice("h", k + 1, count) for k in offsets])
    placed = hashed.select(key, F.posexplode_outer(beside).alias("at", "w")).where("at IS NOT NULL")
    each = F.array(*[F.xxhash64(F.lit(number), *[F.col("w")[str(offsets.index(k))] for k in mask]) for number, mask in enumerate(masks)])
    return placed.select(key, "at", F.explode(each).alias("seed"))


def short_masks(length: int, share: float = SHARE) -> tuple[tuple[int, ...], ...]:
    """Masks over a whole item, of which one is whole wherever the words that may differ stand."""
    differ = length - math.ceil(length * share - 1e-9)
    blocks = min(length, differ + 2) if differ else 1
    cuts = [k * length // blocks for k in range(blocks + 1)]
    kept = combinations(range(blocks), blocks - differ)
    return tuple(tuple(p for k in some for p in range(cuts[k], cuts[k + 1])) for some in kept)


def short_seeds(rows: DataFrame, key: str, lengths: list[int], share: float, whole: bool) -> DataFrame:
    """key, at, seed of the masks of short items: ``whole`` for items, each by its own length, else at every place."""
    hashed = rows.select(key, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    hashed = hashed.withColumn("size", F.size("h"))
    span = max(lengths)
    beside = F.arrays_zip(*[F.slice("h", k + 1, F.greatest(F.size("h"), F.lit(1))) for k in range(span)])
    placed = hashed.select(key, "size", F.posexplode_outer(beside).alias("at", "w")).where("at = 0" if whole else "at IS NOT NULL")
    each = []
    for n in lengths:
        fits = F.col("size") == n if whole else F.col("at") + n <= F.col("size")
        each += [F.when(fits, F.xxhash64(F.lit(n), F.lit(number), *[F.col("w")[str(k)] for k in mask])) for number, mask in enumerate(short_masks(n, share))]
    return placed.select(key, "at", F.explode_outer(F.array_compact(F.array(*each))).alias("seed")).where("seed IS NOT NULL")


def _met(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """doc_id, item_id, shift of equal seeds."""
    theirs = stored(theirs.select("item_id", F.col("at").alias("item_at"), "seed").distinct(), "seeds")
    if theirs.count() <= MOST_BROADCAST:
        theirs = F.broadcast(theirs)
    return ours.join(theirs, "seed").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()


def hits(docs: DataFrame, items: DataFrame, masks=MASKS, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, shift: where an item's first word would stand in the document."""
    size = F.size(words(F.col("text")))
    items = items.where(words(F.col("text"))[0] != "").select("item_id", "text")
    found = _met(seeded(docs.select("doc_id", "text"), "doc_id", masks), seeded(items.where(size >= window), "item_id", masks))
    short = items.where(size < window)
    lengths = sorted(r.n for r in short.select(size.alias("n")).distinct().collect())
    if not lengths:
        return found
    return found.unionByName(_met(short_seeds(docs, "doc_id", lengths, share, False), short_seeds(short, "item_id", lengths, share, True)))


def _best_window(doc: Column, item: Column, shift: Column, window: int) -> tuple[Column, Column]:
    """The most equal words in a window of the overlap, and the window's length."""
    length = F.least(F.size(item), F.lit(window))
    low, high = F.greatest(F.lit(0), -shift), F.least(F.size(item), F.size(doc) - shift)
    same = F.transform(F.sequence(low, F.greatest(high - 1, low)), lambda k: (F.get(item, k) == F.get(doc, k + shift)).cast("int"))
    sums = F.transform(F.sequence(F.lit(1), F.greatest(F.size(same) - length + 1, F.lit(1))), lambda k: F.aggregate(F.slice(same, k, length), F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))))
    return F.when(high - low >= length, F.array_max(sums)).otherwise(F.lit(0)), length


def overlaps(docs: DataFrame, items: DataFrame, masks=MASKS, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, matched, window: each document and item that share a confirmed overlap."""
    found = stored(hits(docs, items, masks, window, share), "hits")
    ours = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
    theirs = items.select(F.col("item_id").alias("_item"), words(F.col("text")).alias("_words"))
    laid = found.join(ours, F.col("doc_id").eqNullSafe(F.col("_doc"))).join(theirs, F.col("item_id").eqNullSafe(F.col("_item")))
    # Stored, as the words would otherwise be split again for every place that is compared; only hits are left.
    laid = stored(laid.select("doc_id", "item_id", "shift", words(F.col("_text")).alias("d"), F.col("_words").alias("i")), "laid")
    matched, length = _best_window(F.col("d"), F.col("i"), F.col("shift"), window)
    scored = laid.select("doc_id", "item_id", matched.alias("matched"), length.alias("window"))
    return scored.where(F.col("matched") >= F.ceil(F.col("window") * share - 1e-9)).groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("window").alias("window"))


def clean(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """The documents without a confirmed overlap."""
    bad = overlaps(docs, items, **settings).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti")
