"""Encoding and decoding next to the library, on odd rows and on every code point."""

from __future__ import annotations

import hashlib
import random
import sys

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import bpe, packed_ids, token_counts
from tests.llm.conftest import prose
from tests.llm.test_operators import key, rows_of

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: Each code point alone, beside a letter, a number, a mark, a virama and before a contraction.
CONTEXTS = ("{}", "a{}b", "1{}2", "!{}'ll", "्{}", " {} ")


def every_code_point(step=256):
    # Beyond these ranges lie private and unassigned code points alone: some of each plane stand for them.
    chars = [chr(c) for c in range(sys.maxunicode + 1) if (c < 0x33800 or 0xE0000 <= c < 0xE0200 or c % 256 < 2) and not 0xD800 <= c < 0xE000]
    for context in CONTEXTS:
        for k in range(0, len(chars), step):
            yield "\n".join(context.format(c) for c in chars[k : k + step])


def as_arrays(texts):
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def split(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


@pytest.mark.parametrize("make", [bpe.QueueEncoder, packed_ids.WordEncoder])
def test_every_code_point_has_the_ids_of_the_library(make):
    library, mine = Tokenizer.from_file(PATH), make(PATH)
    texts = [*every_code_point()]
    for k in range(0, len(texts), 2000):
        some = texts[k : k + 2000]
        ids, counts = mine.encode(*as_arrays(some))
        assert split(ids, counts) == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]


def test_every_code_point_has_the_count_of_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, machine = Tokenizer.from_file(path), token_counts.TokenMachine(path)
    texts = [*every_code_point(64)]
    for k in range(0, len(texts), 4000):
        some = texts[k : k + 4000]
        assert machine.count([t.encode() for t in some]).tolist() == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]


def test_one_long_text_with_little_room(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(3)
    scripts = [range(97, 123), range(0x430, 0x450), range(0x3B1, 0x3C9), range(0x5D0, 0x5EA), range(0x905, 0x939), range(0x4E00, 0x9FFF)]
    text = " ".join("".join(chr(rng.choice(letters)) for _ in range(rng.randint(1, 12))) for letters in rng.choices(scripts, k=40_000))
    machine = token_counts.TokenMachine(path)
    monkeypatch.setattr(token_counts, "MOST_CELLS", 1 << 20)
    want = len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)
    assert machine.count([text.encode()]).tolist() == [want]
    assert machine.count([b"x y", text.encode()])[1] == want
    assert machine.next.size < 8 << 20


def test_random_texts_and_long_words():
    library, mine, rng = Tokenizer.from_file(PATH), bpe.QueueEncoder(PATH), random.Random(4)
    letters = "abeinorst'  \n\tAB019.,éñ中🙂́"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["a" * 20_000, "ab" * 9000 + "c", "".join(rng.choice("etaoin") for _ in range(30_000)), " " * 9000 + "x", ""]
    texts += ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endof", "text|> <|endoftext|", "x <|endoftext|>"]
    ids, counts = mine.encode(*as_arrays(texts))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert split(ids, counts) == want
    decoded = bpe.Strings(PATH).joined(ids.astype(np.int64), counts)
    assert decoded == texts == [library.decode(x, skip_special_tokens=False) for x in want]


def test_decode_is_the_library_on_any_ids():
    library, table, rng = Tokenizer.from_file(PATH), bpe.Strings(PATH), random.Random(6)
    runs = [[rng.choice([rng.randrange(256), rng.randrange(50_257), 50_257, 70_000]) for _ in range(rng.randint(0, 12))] for _ in range(3000)]
    got = table.joined(np.array([i for run in runs for i in run], np.int64), np.array([len(run) for run in runs]))
    assert got == [library.decode(run, skip_special_tokens=False) for run in runs]


def test_round_trip(spark, docs, corpus, no_docs):
    library = Tokenizer.from_file(PATH)
    want = []
    for doc_id, text, *_ in corpus:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert rows_of(bpe.round_trip(docs, PATH)) == sorted(want, key=key)
    assert bpe.round_trip(no_docs, PATH).count() == 0
    encoded = bpe.encode(docs, PATH)
    assert {r.text for r in bpe.decode(encoded, PATH, into="text").collect()} == {text or "" for _, text, *_ in corpus}
    nothing = spark.createDataFrame([(1, None), (2, b"")], "a int, ids binary")
    assert rows_of(bpe.decode(nothing, PATH).select("a", "decoded")) == [(1, ""), (2, "")]
    with pytest.raises(ValueError):
        bpe.decode(encoded, PATH, into="ids")
