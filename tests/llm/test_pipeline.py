"""Every stage of the pipeline on planted documents, next to plain Python; a stage that loses a clean document fails."""

from __future__ import annotations

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import mixing, quality
from tests.llm.conftest import DOCS, document, prose
from tests.llm.test_operators import edited, plain_near_groups, plain_overlaps, rows_of

CLEAN, JUNK, TOXIC, COPY, LEAK = range(5)


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder of tables; and of each document what it was made as."""
    rng = random.Random(21)
    items = [(k, prose(rng, n)) for k, n in enumerate([13, 20, 34, 16])]
    made: dict[int, int] = {}
    rows = []

    def add(text, kind):
        doc_id = len(rows) * 3 + 1
        made[doc_id] = kind
        rows.append(document(doc_id, text, lang=rng.choice(["en", "de"]), source=rng.choice(["a", "b", None, "c"])))

    for _ in range(300):
        add(prose(rng, rng.randint(30, 120)), CLEAN)
    for _ in range(150):
        add(" ".join(w + rng.choice(["***", "$$$", "%%%"]) for w in prose(rng, rng.randint(30, 120)).split()), JUNK)
        words = prose(rng, rng.randint(30, 120)).split()
        for _ in range(3):
            words.insert(rng.randrange(len(words)), rng.choice(["scumbag", "vermin", "filth"]))
        add(" ".join(words), TOXIC)
    originals = [r[1] for r in rows[:60] if len(r[1].split()) > 90]
    for text in originals:
        for copy in (text, text + " more", edited(rng, text, 1)):
            add(copy, COPY)
    for k in range(24):
        words = items[k % 4][1].split()
        words[rng.randrange(len(words))] = "changed"
        add(f"{prose(rng, 30)} {' '.join(words)} {prose(rng, 30)}", LEAK)
    rng.shuffle(rows)
    labels = [(d, int(k not in (JUNK,)), int(k == TOXIC)) for d, k in made.items() if d % 4]
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(rows, DOCS).select("doc_id", "text", "lang", "source", "n_chars").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return folder, made, items


def test_every_stage_and_the_whole(spark, planted):
    folder, made, items = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda rows: {r.doc_id for r in rows}

    # The classifier: its scores worked out row by row, no clean document lost.
    before = docs.collect()
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = stages["quality classifier"](spark, docs, folder)
    want = set()
    for r in before:
        text = model.text.intercept + sum(model.text.weights[f] for f in quality.text_features((r.text or "").encode()))
        meta = model.meta.intercept + sum(model.meta.weights[f] for f in quality.meta_features(r.lang, r.source, r.n_chars))
        logit = model.text.scale * text + model.text.shift + model.meta.scale * meta + model.meta.shift - model.prior
        want |= {r.doc_id} if logit >= 0 else set()
    after = good.collect()
    assert good.columns == columns and ids(after) == want
    assert {d for d, k in made.items() if k in (CLEAN, COPY, LEAK)} <= want
    assert len({d for d, k in made.items() if k in (JUNK, TOXIC)} & want) <= 20  # of 300

    # Near copies: one document of each group by five-word similarity, by comparing all pairs.
    before = after
    single = stages["SimHash near-dedup"](spark, good, folder)
    after = single.collect()
    assert single.columns == columns
    assert ids(after) == {d for d, group in plain_near_groups([(r.doc_id, r.text) for r in before]) if d == group}
    assert {d for d, k in made.items() if k == LEAK} <= ids(after) and len(after) < len(before)

    # Benchmark passages: every window against every window.
    before = after
    clean = stages["benchmark decontamination"](spark, single, folder)
    after = clean.collect()
    found = {d for d, *_ in plain_overlaps([(r.doc_id, r.text) for r in before], items)}
    assert clean.columns == columns and ids(after) == ids(before) - found
    assert found == {d for d, k in made.items() if k == LEAK}

    # The mix: whole documents, as often as their source's share says; nothing else changes.
    before = after
    mixed = stages["mixing sources to target weights"](spark, clean, folder)
    after = mixed.collect()
    taken = {r.doc_id: r for r in mixing.mix(clean).collect()}
    assert mixed.columns == columns
    assert collections.Counter(r.doc_id for r in after) == +collections.Counter({d: r.copies for d, r in taken.items()})
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}
    for source in {r.source for r in taken.values()}:
        own = [r for r in taken.values() if r.source == source]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 2 * max(r.size for r in own)
        assert all(r.copies in (math.floor(r.target / r.source_size), math.floor(r.target / r.source_size) + 1) for r in own)

    # The ids, and the run of all stages.
    library, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for r in sorted(after, key=lambda r: (r.doc_id, r.text)):
        tokens = [*library.encode(r.text, add_special_tokens=False).ids, 2]
        want.append((r.doc_id, at, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
        at += len(tokens)
    assert rows_of(stages["token-ID / binary output"](spark, mixed, folder)) == sorted(want)
    assert rows_of(corpus_pipeline.run(spark, folder)) == sorted(want)
