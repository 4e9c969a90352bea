"""Token ids in files of fixed-width packed bits, with block offsets for random access.

A shard holds the ids of consecutive documents, each followed by the end id. Ids take the fewest bits
that the vocabulary needs and are packed in blocks of ``BLOCK`` ids; every block begins at a byte, so
block k is read and unpacked by itself. Layout: magic, width, block size, then the blocks; a footer
holds the byte offset of every block, the number of ids, and the id counts of the documents.

Encoding splits a batch into words by array operations, has the tokenizer encode each word once, and
puts the documents together from the words' ids. That is what the tokenizer itself does with a text,
since byte-level BPE never merges across words; texts with its special strings go to it whole.

Defined cases: a null text is empty and gives the end id alone; documents come in ascending id, null
ids first, ties by text; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import files
from millrace.llm.common import by_bytes, flat_bytes, new_folder, partitions, stored, text_or_empty
from millrace.llm.lexing import class_table, word_starts

END = 2
BLOCK = 1 << 14
MAGIC = b"MRPK"
_SPACE = "\u0120"  # how byte-level vocabularies spell a space
MOST_WORDS = 400_000  # words remembered by a worker before it starts anew
PIECE = 4 << 20  # bytes of text encoded at a time


def bits_needed(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as consecutive little-endian bit fields of ``width`` bits."""
    if width % 8 == 0:
        return ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : width // 8].tobytes()
    bits = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(bits, axis=1, bitorder="little")[:, :width].reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, count: int, width: int) -> np.ndarray:
    if width % 8 == 0:
        out = np.zeros((count, 4), np.uint8)
        out[:, : width // 8] = np.frombuffer(data, np.uint8).reshape(count, width // 8)
        return out.view("<u4").reshape(-1)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width, bitorder="little").reshape(count, width)
    out = np.zeros((count, 32), np.uint8)
    out[:, :width] = bits
    return np.packbits(out, axis=1, bitorder="little").view("<u4").reshape(-1)


class ShardWriter:
    def __init__(self, folder: str, width: int, block: int = BLOCK) -> None:
        self.out, self.uri = files.writer(folder, "ids")
        self.width, self.block, self.held, self.waiting = width, block, [], 0
        self.offsets: list[int] = []
        self.lengths: list[np.ndarray] = []
        self.total = 0
        head = MAGIC + bytes([width]) + block.to_bytes(4, "little")
        self.out.write(head)
        self.at = len(head)

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.held.append(ids)
        self.waiting += len(ids)
        self.total += len(ids)
        self.lengths.append(lengths)
        if self.waiting >= self.block:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.block * self.block
            for k in range(0, whole, self.block):
                self._write(flat[k : k + self.block])
            self.held, self.waiting = [flat[whole:]], len(flat) - whole

    def _write(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> tuple[str, int]:
        if self.waiting:
            self._write(np.concatenate(self.held))
        footer = zlib.compress(b"".join([np.array([self.total, len(self.offsets)], "<u8").tobytes(), np.array(self.offsets, "<u8").tobytes(), np.concatenate([np.zeros(0, "<u4"), *self.lengths]).astype("<u4").tobytes()]))
        self.out.write(footer + len(footer).to_bytes(8, "little"))
        self.out.close()
        return self.uri, self.total


class ShardReader:
    """Random access to the ids of a shard."""

    def __init__(self, uri: str) -> None:
        self.file = files.reader(uri)
        size = self.file.size()
        magic = self.file.read_at(9, 0)
        if magic[:4] != MAGIC:
            raise ValueError(f"{uri} is no shard of packed ids")
        self.width, self.block = magic[4], int.from_bytes(magic[5:9], "little")
        length = int.from_bytes(self.file.read_at(8, size - 8), "little")
        footer = zlib.decompress(self.file.read_at(length, size - 8 - length))
        self.total, blocks = np.frombuffer(footer[:16], "<u8").tolist()
        self.offsets = np.frombuffer(footer[16 : 16 + 8 * blocks], "<u8")
        self.lengths = np.frombuffer(footer[16 + 8 * blocks :], "<u4")

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, from the blocks that hold them."""
        parts = []
        for k in range(start // self.block, -(-stop // self.block)):
            count = min(self.block, self.total - k * self.block)
            whole = unpack(self.file.read_at(-(-count * self.width // 8), int(self.offsets[k])), count, self.width)
            parts.append(whole[max(0, start - k * self.block) : stop - k * self.block])
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")


class WordEncoder:
    """Ids of many texts at once; remembers the ids of the words it has met."""

    most_words = MOST_WORDS

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.special = [x["content"].encode() for x in json.load(file)["added_tokens"]]
        self.kinds = class_table(lambda text: [span for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)])
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with a space
        self.opens[[i for token, i in vocabulary.items() if token.startswith(_SPACE)]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begins, self.counts = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end and counts. Words that begin with a space are told apart by that, so many go in one call."""
        parts, counts = [np.zeros(0, np.uint32)], []
        for k in range(0, len(words), 1000):
            some = words[k : k + 1000]
            ids = np.array(self.tokenizer.encode(b"".join(some).decode(), add_special_tokens=False).ids, np.uint32) if all(len(w) > 1 and w[0] == 32 for w in some) else None
            begins = np.flatnonzero(self.opens[ids]) if ids is not None else []
            if len(begins) != len(some):
                each = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)]
                ids, begins = np.array([i for e in each for i in e], np.uint32), np.cumsum([0, *map(len, each[:-1])])
            parts.append(ids)
            counts.append(np.diff(begins, append=len(ids)))
        return np.concatenate(parts), np.concatenate(counts)

    def _learn(self, words: list[bytes]) -> None:
        flat, counts = self._encode_words(words)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.uint32)])
        if len(self.known) + len(words) > len(self.begins):
            more = np.zeros(max(len(self.begins), len(words)), np.int64)
            self.begins, self.counts = np.concatenate([self.begins, more]), np.concatenate([self.counts, more])
        self.ids[self.used : self.used + len(flat)] = flat
        n = len(self.known)
        self.begins[n : n + len(words)] = self.used + np.cumsum(counts) - counts
        self.counts[n : n + len(words)] = counts
        self.used += len(flat)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end and the number of each text; ``starts`` as from ``flat_bytes``."""
        texts = len(starts) - 1
        whole = data.tobytes()
        if any(s in whole for s in self.special):
            each = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([whole[a:b].decode() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.array([len(e) for e in each], np.int64)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(texts, np.int64)
        if len(self.known) > self.most_words:
            self.forget()
        begin = word_starts(data, starts[:-1][starts[:-1] < starts[1:]], self.kinds)
        length = np.diff(begin, append=len(data))
        distinct, kind = _distinct_words(data, begin, length)
        words = [whole[a:b] for a, b in zip(begin[distinct].tolist(), (begin[distinct] + length[distinct]).tolist(), strict=True)]
        number = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(number < 0)):
            new = new[np.argsort(data[begin[distinct[new]]] != 32, kind="stable")]  # those with a space first
            number[new] = np.arange(len(self.known), len(self.known) + len(new))
            self._learn([words[k] for k in new.tolist()])
        number = number[kind]
        counts = self.counts[number]
        first = np.cumsum(counts) - counts
        source = np.repeat(self.begins[number] - first, counts) + np.arange(int(counts.sum()))
        per_text = np.add.reduceat(np.append(counts, 0), np.minimum(np.searchsorted(begin, starts[:-1]), len(counts)))
        per_text[starts[:-1] == starts[1:]] = 0
        return self.ids[source], per_text


def _distinct_words(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place for each distinct word, and for every word the number of its distinct one; exact."""
    rank = np.arange(len(data), dtype=np.int32) - np.repeat(begin.astype(np.int32), length)
    powers = np.cumprod(np.full(int(length.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
    terms = powers.take(rank)
    terms *= data + np.uint64(1)
    hashed = np.add.reduceat(terms, begin) ^ (length.astype(np.uint64) << np.uint64(48))
    kind, found = pd.factorize(hashed)
    distinct = np.zeros(len(found), np.int64)
    distinct[kind[::-1]] = np.arange(len(begin) - 1, -1, -1)
    rank += np.repeat(begin[distinct][kind].astype(np.int32), length)
    if (length == length[distinct][kind]).all() and np.array_equal(data.take(rank), data):
        return distinct, kind
    # Two words share a hash: name them by their bytes.
    whole, seen = data.tobytes(), {}
    kind = np.fromiter((seen.setdefault(whole[b : b + n], len(seen)) for b, n in zip(begin.tolist(), length.tolist(), strict=True)), np.int64, len(begin))
    return np.unique(kind, return_index=True)[1], kind


@functools.cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


_MANIFEST = "shard int, uri string, ids long, part int, doc_ids array<long>"
_OUT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_shards(docs: DataFrame, path: str, folder: str, end: int = END) -> DataFrame:
    """Shards in ascending document order; rows of (shard, uri, ids, part, document ids in order).

    The ids of a shard's documents come in parts of bounded length, so no row grows with the shard.
    """
    spark = docs.sparkSession
    placed = docs.select("doc_id", text_or_empty().alias("text")).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    placed = placed.withColumn("shard", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, shard, names = encoder(path), None, None, []
        for batch in by_bytes(batches, PIECE):
            if writer is None:
                shard = batch.column("shard")[0].as_py()
                writer = ShardWriter(folder, bits_needed(encode.tokenizer.get_vocab_size()))
            ids, counts = encode.encode(*flat_bytes(batch.column("text")))
            ids = np.insert(ids, np.cumsum(counts), np.uint32(end))
            writer.add(ids, counts + 1)
            names.append(batch.column("doc_id"))
        if writer:
            uri, total = writer.close()
            flat = pa.concat_arrays(names).cast(pa.int64())
            step = 100_000
            parts = [flat[k : k + step].to_pylist() for k in range(0, len(flat), step)]
            n = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array([uri] * n), pa.array([total] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(parts, pa.list_(pa.int64()))], ["shard", "uri", "ids", "part", "doc_ids"])

    return stored(placed.mapInArrow(run, _MANIFEST), "ids-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    # One row per shard: the running total over them is a small window.
    before = manifest.where("part = 0").select("shard", F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("before"))
    rows = manifest.join(before, "shard").repartition(partitions(manifest.sparkSession), "shard", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _read_part(row)

    return rows.mapInArrow(run, _OUT)


def _read_part(row: dict) -> pa.RecordBatch:
    shard = ShardReader(row["uri"])
    first = row["part"] * 100_000
    ends = np.cumsum(shard.lengths, dtype=np.int64)
    lengths = shard.lengths[first : first + len(row["doc_ids"])].astype(np.int64)
    at = int(ends[first] - lengths[0])
    starts = at + np.cumsum(lengths) - lengths
    sums = []
    k = 0
    while k < len(lengths):  # a run of documents at a time, of about a million ids
        stop = max(k + 1, int(np.searchsorted(starts, starts[k] + (1 << 20))))
        ids = shard.ids(int(starts[k]), int(starts[stop - 1] + lengths[stop - 1])).astype("<u4")
        for a, n in zip((starts[k:stop] - starts[k]).tolist(), lengths[k:stop].tolist(), strict=True):
            sums.append(zlib.crc32(ids[a : a + n].tobytes()))
        k = stop
    return pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["before"]), pa.array(lengths), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """Write all documents as packed shards and read them back."""
    return read_shards(write_shards(docs, path, new_folder(docs.sparkSession, "packed-ids"), end))
