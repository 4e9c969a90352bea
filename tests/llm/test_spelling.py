"""Spelling variants next to plain Python, on odd rows."""

from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import spelling
from tests.llm.conftest import DOCS, document
from tests.llm.test_operators import rows_of


def occurrences(rows, every=199):
    n = collections.Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return n


def one_edit(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def expected(rows, shortest=6, seen=5, ratio=5, every=199):
    n = {w: c for w, c in occurrences(rows, every).items() if len(w) >= shortest and c >= seen}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=lambda r: r[0])


def misspelt(rng, word):
    k = rng.randrange(len(word))
    letter = rng.choice("abcdefghijklmnopqrstuvwxyzéàÿ×")
    return rng.choice([word[:k] + word[k + 1 :], word[:k] + letter + word[k:], word[:k] + letter + word[k + 1 :], word[:k] + word[k : k + 2][::-1] + word[k + 2 :]])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    stems = ["".join(rng.choice("abcdeéaio") for _ in range(rng.randint(5, 9))) for _ in range(40)] + ["a" * 12, "ab" * 40, "k" * 300]
    words = []
    for stem in stems:
        words += [stem] * rng.choice([40, 150])
        words += [w for _ in range(25) for w in [misspelt(rng, stem)] * rng.randint(1, 8)]
        words += [misspelt(rng, misspelt(rng, stem)) for _ in range(20)] * 2
    words += ["wonderful"] * 400 + ["wondeful"] * 60 + ["wndeful"] * 8
    words += [w.upper() for w in words[::7]] + ["anagrm", "nagram", "agramn"] * 6
    rng.shuffle(words)
    out = [document(k, rng.choice([" ", "-", "3", "\n", "中", "Ā"]).join(words[k::90])) for k in range(90)]
    return [*out, document(None, None), document(None, "aaaaaaa " * 300), document(1, ""), document(2, " 12 .."), out[0], out[1]]


def test_variants(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    want = expected(rows)
    assert sum(r[1] is not None for r in want) > 50 and any(r[1] != r[2] for r in want if r[1])
    got = sorted((tuple(r) for r in spelling.variants(docs).collect()), key=lambda r: r[0])
    assert got == want
    assert spelling.variants(docs.limit(0)).count() == 0


def test_many_small_cells_and_more_edits(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = sorted((tuple(r) for r in spelling.variants(docs, 4, 2, 3, 20, cell=12, sample=200).collect()), key=lambda r: r[0])
    assert got == expected(rows, 4, 2, 3, 20)


def test_trees_leave_out_most_words():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(6000)} | {"abcdefgh", "abcdefgx"})
    letters, counts = spelling.spelled(pa.array(words))
    tree = spelling.Tree(letters, counts)
    compared = []
    plain = spelling.Tree._verified
    spelling.Tree._verified = lambda self, rows, own, *rest: (compared.append(len(rows) * len(own)), plain(self, rows, own, *rest))[1]
    try:
        found = {(words[x], words[y]) for xs, ys in tree.near(letters, counts, 2) for x, y in zip(xs, ys, strict=True)}
    finally:
        spelling.Tree._verified = plain
    gaps = collections.defaultdict(list)
    for w in words:
        for k in range(8):
            gaps[w[:k] + "*" + w[k + 1 :]].append(w)
    assert found == {(a, b) for group in gaps.values() for a in group for b in group if a != b}
    assert sum(compared) < 0.5 * len(words) ** 2


def test_checksums():
    rng = random.Random(2)
    parts = [bytes(rng.randrange(256) for _ in range(rng.choice([1, 2, 7, 40, 48, 49, 500]))) for _ in range(200)]
    data = np.frombuffer(b"".join(parts), np.uint8)
    length = np.array([*map(len, parts)])
    before = np.array([zlib.crc32(str(k).encode()) for k in range(200)], np.uint32)
    got = spelling.checksums(data, np.cumsum(length) - length, length, before)
    assert got.tolist() == [zlib.crc32(f"{k}".encode() + p) for k, p in enumerate(parts)]


def test_equal_rows_follow_one_form(spark):
    rows = [document(k, "receive receive receive receive receive recieve") for k in range(9)] + [document(50, None)]
    got = rows_of(spelling.variants(spark.createDataFrame(rows, DOCS), every=1 << 40))
    assert got == [("receive", None, "receive", 45, 0, None), ("recieve", None, "recieve", 9, 0, None)]  # a swap is two edits
