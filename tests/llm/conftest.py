from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, seed long, h long"
VOCABULARY = [f"{a}{b}" for a in ("the", "on", "er", "ing", "tion", "éa", "über", "ño") for b in ("", "st", "re", "lo", "x9", "'s", ".", ",")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", "", "a", "an"]) for _ in range(n))


def document(doc_id, text, lang="en", source="src1"):
    """A row with extra columns whose names the operators use themselves."""
    return (doc_id, text, lang, source, None if text is None else len(text), "x", 1, 2)


@pytest.fixture(scope="session")
def corpus():
    """Odd rows: null, empty, blank, one word, repeated, long, copies, near copies."""
    rng = random.Random(5)
    base = prose(rng, 120)
    long = prose(rng, 9000)
    texts = [None, "", " \n\t", "one", "two words", base, base, base.upper(), base + " extra", base.replace(" ", "  ", 3), long, long + " end", "a" * 700, "ab " * 300, "<|endoftext|> x <|endoftext|>", "\u0338x É İ Σσς 中文١٢ 🙂", "nul\x00l"]
    texts += [prose(rng, rng.randint(1, 150)) for _ in range(30)]
    rows = [document(k, t, source=[None, "a", "b", "ü"][k % 4]) for k, t in enumerate(texts)]
    return [*rows, rows[5], document(None, base), document(None, None)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
