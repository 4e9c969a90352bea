"""Byte-pair encoding by a priority queue of merges, and decoding by joining vocabulary strings.

A word is a doubly linked list of symbols. Every neighbouring pair that the merge table knows stands in a
queue, ordered by merge rank and then by place. The least entry is taken; it is stale, and skipped, if
the pair at its place is no longer the one that it was made for. Else the pair becomes one symbol, its
right half leaves the list, and the pairs with its two new neighbours join the queue. A word of n bytes
costs n log n, whatever it holds.

Texts are cut into words as the vocabulary file's own pre-tokenizer cuts them; each distinct word is
encoded once by a worker and remembered. Special strings are single tokens, as is the library's default.
Decoding gathers the bytes of the vocabulary strings, one after another, and reads them as UTF-8, with
U+FFFD for what is none.

Defined cases: a null or empty text has no ids, and decodes to the empty text; repeated rows give equal
rows; ids that the vocabulary lacks (null ids rows too) decode to nothing; an empty table gives an empty
table. ``encode`` ignores columns besides the id and the text; ``decode`` keeps all columns.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from millrace.llm.common import by_bytes, flat_bytes
from millrace.llm.packed_ids import WordEncoder
from millrace.llm.token_counts import _byte_letters

PIECE = 4 << 20  # bytes of text, or ids of four bytes, in work at a time
LONG = 1 << 12  # a word beyond it keeps its links and first entries in arrays
_PLACE = 40  # an entry of the queue is rank << _PLACE | place
_HERE = (1 << _PLACE) - 1


class QueueEncoder(WordEncoder):
    """Ids of many texts at once; words are encoded by the queue of merges."""

    most_words = 300_000

    def __init__(self, path: str) -> None:
        super().__init__(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, added = spec["model"], spec["added_tokens"]
        if spec["normalizer"] or model.get("dropout") or any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in added):
            raise ValueError(f"{path}: only byte-level vocabularies without normalising, dropout or padded specials")
        vocabulary = model["vocab"]
        self.of_byte = [vocabulary[letter] for letter in _byte_letters()]
        # Symbols by pair, and the symbol that each rank makes.
        self.ranks: dict[int, int] = {}
        self.made = array("i")
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(vocabulary[left] << 32 | vocabulary[right], len(self.made))
            self.made.append(vocabulary[left + right])
        self.special_ids = {x["content"].encode(): x["id"] for x in added}
        self.special_pattern = re.compile(b"|".join(map(re.escape, sorted(self.special_ids, key=len, reverse=True)))) if added else None

    def merge(self, word: bytes) -> list[int] | array:
        """The ids of one word."""
        ranks, made = self.ranks, self.made
        symbol = [self.of_byte[b] for b in word]
        n = len(symbol)
        first = [rank << _PLACE | k for k in range(n - 1) if (rank := ranks.get(symbol[k] << 32 | symbol[k + 1])) is not None]
        if not first:
            return symbol
        first.sort()  # the queue is this ordered run, and a heap of what comes later
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        if n > LONG:
            symbol, right, left, first = array("i", symbol), array("i", right), array("i", left), array("q", first)
        heap: list[int] = []
        at, many = 0, len(first)
        while True:
            if at < many and (not heap or first[at] < heap[0]):
                entry = first[at]
                at += 1
            elif heap:
                entry = heappop(heap)
            else:
                break
            rank, here = entry >> _PLACE, entry & _HERE
            gone = right[here]
            if symbol[here] < 0 or gone >= n or ranks.get(symbol[here] << 32 | symbol[gone]) != rank:
                continue  # stale
            whole = symbol[here] = made[rank]
            symbol[gone] = -1
            beyond = right[here] = right[gone]
            before = left[here]
            if beyond < n:
                left[beyond] = here
                if (rank := ranks.get(whole << 32 | symbol[beyond])) is not None:
                    heappush(heap, rank << _PLACE | here)
            if before >= 0 and (rank := ranks.get(symbol[before] << 32 | whole)) is not None:
                heappush(heap, rank << _PLACE | before)
        return [s for s in symbol if s >= 0] if n <= LONG else array("i", (s for s in symbol if s >= 0))

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        each = [self.merge(word) for word in words]
        counts = np.fromiter(map(len, each), np.int64, len(each))
        return np.concatenate([np.zeros(0, np.uint32), *(np.array(ids, np.uint32) for ids in each)]), counts

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end and the number of each text; ``starts`` as from ``flat_bytes``."""
        whole = data.tobytes()
        if not self.special_ids or not self.special_pattern.search(whole):
            return super().encode(data, starts)
        # Texts fall into parts between special strings; the string after a part is one id.
        parts, after, texts = [], [], []
        for text, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
            for found in self.special_pattern.finditer(whole, a, b):
                parts.append(whole[a : found.start()])
                after.append(self.special_ids[found.group()])
                texts.append(text)
                a = found.end()
            parts.append(whole[a:b])
            after.append(-1)
            texts.append(text)
        ids, counts = super().encode(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]))
        after = np.array(after)
        closed = after >= 0
        ids = np.insert(ids, np.cumsum(counts)[closed], after[closed].astype(np.uint32))
        return ids, np.bincount(texts, counts + closed, len(starts) - 1).astype(np.int64)


class Strings:
    """The bytes of every vocabulary string, end to end."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = {letter: byte for byte, letter in enumerate(_byte_letters())}
        vocabulary = spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec["added_tokens"]}
        table = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            table[number] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        table.append(b"")  # stands for all ids beyond the vocabulary
        self.lengths = np.array([*map(len, table)], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(table), np.uint8)

    def joined(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids; ids end to end, and the number of each text."""
        ids = np.minimum(ids, len(self.lengths) - 1)
        length = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(length)])
        source = np.repeat(self.begins[ids] - ends[:-1], length) + np.arange(ends[-1])
        whole = self.data[source].tobytes()
        cuts = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [whole[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@functools.cache
def encoder(path: str) -> QueueEncoder:
    return QueueEncoder(path)


@functools.cache
def strings(path: str) -> Strings:
    return Strings(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids of every document; ids as little-endian unsigned 32-bit integers end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = encoder(path)
        for batch in by_bytes(batches, PIECE):
            ids, counts = queue.encode(*flat_bytes(batch.column("text")))
            whole, cuts = ids.astype("<u4").tobytes(), (4 * np.concatenate([[0], np.cumsum(counts)])).tolist()
            rows = [whole[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(rows, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows with the text that their ids spell, in one more column."""
    if into in encoded.columns:
        raise ValueError(f"there is a column {into} already")
    schema = StructType([*encoded.schema.fields]).add(into, StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = strings(path)
        for batch in by_bytes(batches, PIECE, ids):
            sizes = pc.fill_null(pc.binary_length(batch.column(ids)), 0).to_numpy(zero_copy_only=False)
            numbers = np.frombuffer(b"".join(x or b"" for x in batch.column(ids).to_pylist()), "<u4").astype(np.int64)
            texts = pa.array(table.joined(numbers, sizes // 4), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, into])

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the text that they decode to."""
    digested = encode(docs, path).withColumn("ids_sha256", F.sha2("ids", 256))
    return decode(digested, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
