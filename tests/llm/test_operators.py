"""Every operator next to plain Python, on odd rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from millrace.llm import ann, components, decontam, files, mixing, packed_ids, quality, simhash, suffix_dedup, token_counts, url_filter, warc
from tests.llm.conftest import DOCS, document, prose


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


# 1 token counts


def test_token_counts(docs, corpus, no_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = []
    for doc_id, text, *_ in corpus:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 2048))
    assert rows_of(token_counts.token_counts(docs, path)) == sorted(want, key=key)
    assert token_counts.token_counts(no_docs, path).count() == 0


def test_token_machine_is_the_library_on_random_text():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, machine, rng = Tokenizer.from_file(path), token_counts.TokenMachine(path), random.Random(2)
    letters = "ab'strevlmdABST  \n\t\r0  éñ中12٣.,!’𝔸🙂\u0301\u200b\u0085\u3000\x1c_-ΣİßÉ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["the" * 400, "'" * 40]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert machine.count([t.encode() for t in texts]).tolist() == want


def test_token_machine_with_little_room(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [prose(random.Random(k), 3000).encode() for k in range(30)]
    machine = token_counts.TokenMachine(path)
    want = machine.count(texts).tolist()
    monkeypatch.setattr(token_counts, "MOST_CELLS", machine.next.size // 2)
    machine.forget()
    assert machine.count(texts).tolist() == want


# 2 suffix dedup


def covered_by_brute_force(texts, window=200):
    seen = collections.Counter(t[p : p + window] for t in texts for p in range(len(t) - window + 1))
    out = []
    for t in texts:
        cover = bytearray(len(t))
        for p in range(len(t) - window + 1):
            if seen[t[p : p + window]] > 1:
                cover[p : p + window] = b"\1" * window
        kept = bytes(b for b, c in zip(t, cover) if not c)
        spans = sum(1 for k, c in enumerate(cover) if c and (k == 0 or not cover[k - 1]))
        out.append((len(t), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out


def spliced(rng, count):
    """Texts that share passages of about 200 bytes, some a byte short."""
    pool = [prose(rng, 60).encode()[: rng.choice([199, 200, 201, 250])] for _ in range(6)]
    make = lambda: b" ".join(rng.choice([rng.choice(pool), prose(rng, rng.randint(1, 40)).encode()]) for _ in range(rng.randint(1, 5)))
    return [make().decode(errors="ignore") for _ in range(count)]


def test_suffix_dedup(spark, docs, corpus, no_docs):
    extra = [document(1000 + k, t) for k, t in enumerate(spliced(random.Random(3), 60))]
    everything = corpus + extra
    got = rows_of(suffix_dedup.remove_repeats(docs.unionByName(spark.createDataFrame(extra, DOCS))).drop("kept"))
    want = covered_by_brute_force([(r[1] or "").encode() for r in everything])
    assert got == sorted(((r[0], *w) for r, w in zip(everything, want, strict=True)), key=key)
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_suffix_dedup_of_texts_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    text = prose(random.Random(4), 900).encode()
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "dk": [1, 2], "text": [text.decode(), "x" * 300]})
    windows = collections.Counter()
    for rows in suffix_dedup._anchor_rows(batch):
        for r in rows.to_pylist():
            windows.update((r["id"], p) for p in range(r["at"], r["at"] + r["n"]))
    assert windows == collections.Counter([(1, p) for p in range(len(text) - 199)] + [(2, p) for p in range(101)])


def test_merge_runs_yields_sorted_suffixes_with_their_common_prefixes():
    rng = random.Random(1)
    for count in (1, 2, 3, 7):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 20))) for _ in range(count)]
        merged = list(suffix_dedup.merge_runs([suffix_dedup.front_code(r) for r in runs]))
        strings = [runs[r][k] for r, k, _ in merged]
        assert strings == sorted(s for r in runs for s in r)
        assert [c for *_, c in merged][1:] == [suffix_dedup.common_prefix(a, b) for a, b in zip(strings, strings[1:])]


# 3 URL filter


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "https://A.Example.NET/en/1?x://y", "http://example.com/de/2#f", "http://badexample.com/de/2", "http://x.org/fr/", "http://x.org/fr", "http://shop.net", "http://shop.net/a", "ftp://org/fr/z", "http://www.casino-games.info/en/1", "http://blog.thereon.info/en/1"]
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)] + [(4, urls[4], None, None)], "page_id long, url string, html string, score string")
    model = url_filter.fit(url_filter.labelled_table(spark))
    got = {r.page_id: r for r in url_filter.judge(pages, model).collect()}
    for k, url in enumerate(urls):
        found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")
        fits = [r for r in url_filter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        rule = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule and rule[1] + rule[2])
        if rule:
            assert got[k].verdict == rule[0]
    assert got[12].verdict == "block" and got[13].verdict == "allow"
    assert url_filter.judge(pages.limit(0), model).count() == 0


def test_url_scores_and_unseen_hosts(spark):
    model = url_filter.fit(url_filter.labelled_table(spark))
    blocked, clean = ["casino-win", "cheap-pills", "free-bets", "adult-x", "spam-farm", "ads-track"], ["theron", "tionsh", "ththan", "quiet-harbour", "maple"]
    assert not any(name in url for name in blocked + clean for url, _ in url_filter.LABELLED)
    urls = [f"https://{p}{n}.example.com/en/{k}" for k, n in enumerate(blocked + clean) for p in ("", "www.")] + ["http://Ü😀é.x/ß/中文", "http://x", "", None]
    urls.append("http://" + "casino." * 70_000 + "com/" + "é" * 500_000)
    rows = url_filter.judge(spark.createDataFrame([*enumerate(urls)], "page_id long, url string"), model).collect()

    def grams(text, side):
        marked, seed = f"^{text}$", xxhash.xxh64_intdigest(side.encode(), 42)
        return [xxhash.xxh64_intdigest(marked[k : k + n].encode(), seed) for n in url_filter.SIZES for k in range(len(marked) - n + 1)]

    for r in rows:
        want = model.intercept
        for text, side in ((r.host, "h"), (r.path, "p")):
            found = [(h - (1 << 64) if h >> 63 else h) % url_filter.BUCKETS for h in grams(text, side)]
            want += sum(model.weights[j] for j in found) / max(1, len(found)) ** 0.5
        assert r.score == pytest.approx(want, abs=1e-6)
    blocks = [r.score > 0 for r in sorted(rows, key=lambda r: r.page_id)]
    assert sum(blocks[:12]) >= 10 and not any(blocks[12:22]), [(r.host, r.score) for r in rows[:22]]


# 4 mixing


def test_targets_are_filled_by_weight(spark, docs, corpus):
    mixed = mixing.mix(docs).collect()
    size = collections.Counter()
    for r in corpus:
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    names = sorted((s for s in size if s is not None), key=lambda s: s) + ([None] if None in size else [])
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    goal, open_ = {}, set(names)
    while open_:  # plain water filling
        rest = sum(size.values()) - sum(goal.values())
        full = {s for s in open_ if rest * weight[s] / sum(weight[x] for x in open_) > 3 * size[s]}
        goal |= {s: 3.0 * size[s] for s in full} if full else {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        open_ -= full or open_
    for r in mixed:
        assert r.source_size == size[r.source] and math.isclose(r.target, goal[r.source], abs_tol=1e-6)
        assert 0 <= r.copies <= 3
    for s in names:
        most = max(r.size * r.m for r in mixed if r.source == s)
        assert abs(sum(r.size * r.m * r.copies for r in mixed if r.source == s) - goal[s]) <= 2 * most
    assert rows_of(mixing.mix(docs)) == sorted(map(tuple, mixed), key=key)  # reruns agree
    taken = mixing.taken(mixing.mix(docs))
    assert taken.count() == len(corpus)


def test_mixed_documents_keep_their_columns(docs, no_docs):
    copies = {(r.doc_id, r.source, r.size): r.copies * r.m for r in mixing.mix(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(copies.values())
    assert mixing.mixed_documents(no_docs).count() == 0


def test_wide_ids_beside_a_null_stay_whole(spark):
    wide = 1 << 60
    rows = [document(wide + k, "w " * (k + 1), source="a") for k in range(7)] + [document(None, "w w", source="a"), document(-wide - 1, "", source=None)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    ids = {r[0] for r in rows}
    assert {r.doc_id for r in mixing.mix(docs).collect()} == {r.doc_id for r in mixing.taken(mixing.mix(docs)).collect()} == ids
    taken = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert collections.Counter(r.doc_id for r in mixed.collect()) == +collections.Counter(taken)


def test_stages_take_columns_of_any_name(spark):
    import corpus_pipeline

    names = ["copies", "_words", "_copy", "_id", "_source", "_size", "_gone", "_bad", "row", "words", "size", "copy", "target"]
    rows = [(k, f"some words of document number {k} " * 4, "en", "a", 9, *[f"x{k}"] * len(names)) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    items = spark.createDataFrame([(1, "some words of document number 3 some words of document number 3")], "item_id long, text string")
    for made in (mixing.mixed_documents(docs), corpus_pipeline.near.keep_one(docs), simhash.keep_one(docs), decontam.clean(docs, items)):
        assert made.columns == docs.columns
        assert {r._gone for r in made.collect()} <= {f"x{k}" for k in range(6)}
    assert 3 not in {r.doc_id for r in decontam.clean(docs, items).collect()}


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 50, 3000):
        p, size, count = np.full(n, 0.37), rng.integers(0, 900, n).astype(float), np.ones(n)
        out = mixing.flight(p, size, count, rng.random(n + 1))
        assert ((out >= 0) & (out <= 1)).all() and ((out > 0) & (out < 1)).sum() <= 2
        assert abs((out - p).sum()) < 1e-5 and abs(((out - p) * size).sum()) < 1e-2
        landed = mixing.land(out, size, count)
        assert set(landed.tolist()) <= {0.0, 1.0}


def test_a_source_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rows = [document(k, "w " * (k % 9), source="hot" if k % 3 else "small") for k in range(900)]
    mixed = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(mixed) == 900
    for s in ("hot", "small"):
        own = [r for r in mixed if r.source == s]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 8


# 5 WARC


def test_warc_round_trip(spark):
    big, big2 = "<p>é" * 400, "b" * 1000
    rows = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, big), (4, "u", ""), (5, "u", None), (6, "u", "s" * 999), (7, "u", "s" * 999), (8, "u", big2), (9, "u", big2 + "c"), (3, "again", big), (10, "u", "\r\n\r\nContent-Length: 5\r\n\r\n" * 60), (None, "u", "z" * 2000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = rows_of(warc.round_trip(pages))
    want = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        same = [r[0] for r in rows if r[0] is not None and (r[2] or "").encode() == data and len(data) >= 1000]
        keeper = max(same, default=page_id)
        want.append((page_id, len(data), hashlib.sha1(data).hexdigest(), *(("response", None) if page_id == keeper else ("revisit", keeper))))
    assert got == sorted(want, key=key)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_cut_off_archives_are_noticed(tmp_path):
    data = zlib.compress(warc.record(1, "u", "x" * 5000, "d", 5000, None), wbits=31)
    (tmp_path / "cut.gz").write_bytes(data[:-20])
    with pytest.raises(ValueError):
        warc.rewrite(str(tmp_path / "cut.gz"), str(tmp_path / "out"))


# 6 packed ids


@pytest.mark.parametrize("width", [1, 7, 8, 13, 16, 17, 32])
def test_packing_at_any_width(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001, dtype=np.uint64).astype(np.uint32)
    data = packed_ids.pack(ids, width)
    assert len(data) == -(-1001 * width // 8) and (packed_ids.unpack(data, 1001, width) == ids).all()


def test_shards_can_be_read_anywhere(tmp_path):
    writer = packed_ids.ShardWriter(str(tmp_path), 17, block=64)
    ids = np.arange(1000, dtype=np.uint32) * 131
    for a in range(0, 1000, 130):
        writer.add(ids[a : a + 130], np.array([len(ids[a : a + 130])]))
    uri, total = writer.close()
    reader = packed_ids.ShardReader(uri)
    assert total == 1000
    for a, b in ((0, 1000), (63, 65), (500, 500), (999, 1000), (128, 192)):
        assert (reader.ids(a, b) == ids[a:b]).all()


def test_packed_ids_round_trip(docs, corpus, no_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, at, want = Tokenizer.from_file(path), 0, []
    for doc_id, text in sorted(((r[0], r[1] or "") for r in corpus), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert rows_of(packed_ids.round_trip(docs, path)) == sorted(want, key=key)
    assert packed_ids.round_trip(no_docs, path).count() == 0


# 7 SimHash


def plain_fingerprint(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(corpus):
    prints = [plain_fingerprint(r[1]) for r in corpus]
    group = list(range(len(corpus)))
    for a in range(len(corpus)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((corpus[k][0] for k in range(len(corpus)) if group[k] == g and corpus[k][0] is not None), default=None) for g in set(group)}
    return [(r[0], p, least[g]) for r, p, g in zip(corpus, prints, group, strict=True)]


@pytest.mark.parametrize("pairwise", [0, 64])
def test_simhash_groups(docs, corpus, no_docs, pairwise, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.groups(docs).collect()]
    assert sorted(got, key=key) == sorted(plain_groups(corpus), key=key)
    assert simhash.groups(no_docs).count() == 0


@pytest.mark.parametrize("bits,segments", [(2, 5), (2, 4), (3, 7), (1, 3)])
def test_links_connect_what_is_near(spark, bits, segments):
    rng = random.Random(bits)
    values = {rng.getrandbits(64) for _ in range(150)}
    for v in list(values):
        for _ in range(4):
            v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), bits, segments).collect()
    near = {frozenset((a, b)) for a in values for b in values if a < b and (a ^ b).bit_count() <= bits}
    assert {frozenset((e.a % (1 << 64), e.b % (1 << 64))) for e in edges} == near


def test_keep_one(docs, corpus):
    first = {r[0]: r[2] for r in plain_groups(corpus)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, c in first.items() if d is None or d == c}


def five_words(text):
    words = (text or "").encode().lower().split()  # as bytes: A-Z only
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain_near_groups(rows):
    """The smallest id reachable over pairs with five-word similarity of 0.8 or more."""
    sets = [five_words(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(x & y) >= 4 * len(x | y) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group, strict=True) if h == g and r[0] is not None), default=None) for g in set(group)}
    return [(r[0], least[g]) for r, g in zip(rows, group, strict=True)]


def edited(rng, text, times):
    words = text.split()
    for k in range(times):
        at = rng.randrange(len(words))
        words[at : at + rng.randint(0, 1)] = [f"new{k}"] * rng.randint(0, 2)
    return " ".join(words)


@pytest.mark.parametrize("sampled,common", [(16, 8), (1, 2), (1, 300)])
def test_pipeline_near_copies_share_five_words(spark, corpus, no_docs, sampled, common, monkeypatch):
    import corpus_pipeline
    from millrace.llm import near_copies

    for name, value in (("SAMPLED", sampled), ("COMMON", common)):
        monkeypatch.setattr(near_copies, name, value)
    rng = random.Random(8)
    passage, hot = prose(rng, 60), prose(rng, 100)
    texts = [f"{prose(rng, rng.randint(5, 60))} {passage}" for _ in range(25)]  # a common passage
    texts += [prose(rng, 100) for _ in range(40)]
    texts += [edited(rng, t, rng.randint(1, 5)) for t in texts[25:] for _ in range(3)]
    texts += [edited(rng, hot, rng.randint(1, 3)) for _ in range(40)]  # one large group
    rows = [*corpus, *(document(1000 + k, t) for k, t in enumerate(texts))]
    want = plain_near_groups(rows)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    assert sorted(map(tuple, near_copies.groups(docs).collect()), key=key) == sorted(want, key=key)
    kept = corpus_pipeline.near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, c in want if d is None or d == c}
    assert corpus_pipeline.near_copies(spark, no_docs, "").count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}


# 8 quality classifier


def labelled_corpus(n, seed):
    rng, rows, labels = random.Random(seed), [], []
    for k in range(n):
        kind = k % 5
        text = prose(rng, rng.randint(30, 120))
        if kind == 3:
            text = " ".join(w + rng.choice(["***", "$$$", "%%%"]) for w in text.split())
        if kind == 4:
            words = text.split()
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["scumbag", "vermin", "filth"]))
            text = " ".join(words)
        rows.append(document(k, text, lang=rng.choice(["en", "de", None]), source=rng.choice(["a", "b", None])))
        labels.append((k, int(kind != 3), int(kind == 4), "x"))
    return rows, labels


def test_quality_on_held_out_documents(spark, no_docs):
    rows, labels = labelled_corpus(900, 1)
    docs = spark.createDataFrame(rows, DOCS)
    seen = spark.createDataFrame([r for r in labels if r[0] < 600] + [(0, None, None, "x"), (None, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    model = quality.fit(docs, seen)
    got = {r.doc_id: r.keep for r in quality.score(docs, model).collect()}
    right = [got[k] == (q == 1 and t == 0) for k, q, t, _ in labels if k >= 600]
    assert len(got) == 900 and sum(right) / len(right) >= 0.97
    kept = quality.kept_documents(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, keep in got.items() if keep}
    assert quality.score(no_docs, model).count() == 0


def test_quality_of_odd_rows_and_no_labels(docs, corpus, spark):
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scored = quality.score(docs, quality.fit(docs, nothing)).collect()
    assert len(scored) == len(corpus) and all(r.keep for r in scored)


# 9 neighbours


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(3)
    matrix = rng.normal(size=(1500, 16)).astype(np.float32)
    matrix[700:1000] = matrix[50]  # a common vector
    rows = [(k, v.tolist(), "x") for k, v in enumerate(matrix)]
    odd = [(5000, None, "x"), (5001, [0.0] * 16, "x"), (5050, [float("nan")] + [1.0] * 15, "x"), (5051, [None] + [1.0] * 15, "x"), (5052, [1.0] * 15, "x"), (None, [1.0] * 16, "x"), (3, matrix[3].tolist(), "x")]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, shard string")
    got = collections.defaultdict(list)
    for r in sorted(ann.search(ann.index(vectors, shard=500), ann.usable(vectors).where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "vector")).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    exact = matrix.astype(np.float64)
    hit = total = 0
    for q in range(0, 1500, 50):
        score = ann.cosine(exact[q], exact)
        score[q] = -2
        best = np.lexsort((np.arange(1500), -score))[:5]
        hit, total = hit + len({v for v, _ in got[q]} & set(best.tolist())), total + 5
        for v, s in got[q]:
            assert math.isclose(s, score[v], rel_tol=1e-12)
    assert set(got) == set(range(0, 1500, 50)) and hit / total >= 0.9
    assert [v for v, _ in got[50]] == [700, 701, 702, 703, 704]


def test_nearest_of_few(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [2.0, 0.0])], "vec_id long, embedding array<float>")
    got = rows_of(ann.nearest(vectors).select("query_id", "rank", "vec_id"))
    assert got == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]
    assert ann.nearest(vectors.limit(0)).count() == 0


# 10 decontamination


def plain_overlaps(rows, items):
    out = set()
    for doc_id, text in rows:
        d = (text or "").lower().split()
        for item_id, item in items:
            i = (item or "").lower().split()
            n = min(13, len(i))
            best = 0
            for a in range(len(i) - n + 1):
                for b in range(len(d) - n + 1):
                    best = max(best, sum(x == y for x, y in zip(i[a : a + n], d[b : b + n])))
            if n >= 8 and best >= math.ceil(0.8 * n - 1e-9):
                out.add((doc_id, item_id, best, n))
    return out


def test_decontamination(spark, no_docs):
    rng = random.Random(9)
    items = [(k, prose(rng, n)) for k, n in enumerate([13, 14, 30, 20, 40, 7])] + [(10, None), (11, "")]
    rows = [document(None, None), document(1, ""), document(2, "short")]
    for k in range(60):
        _, item = rng.choice(items[:5])
        words = item.split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = "zzz"
        rows.append(document(10 + k, f"{prose(rng, rng.randint(0, 30))} {' '.join(words)} {prose(rng, rng.randint(0, 30))}".strip()))
    rows += [document(100 + k, prose(rng, 80)) for k in range(20)] + [rows[5]]
    docs = spark.createDataFrame(rows, DOCS)
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, seed string")
    want = plain_overlaps([(r[0], r[1]) for r in rows], items)
    got = {tuple(r) for r in decontam.overlaps(docs, bench).collect()}
    assert got == want and want
    bad = {r[0] for r in want}
    clean = decontam.clean(docs, bench)
    assert clean.columns == docs.columns and sorted(map(key, ((r.doc_id,) for r in clean.collect()))) == sorted(key((r[0],)) for r in rows if r[0] not in bad)
    assert decontam.overlaps(no_docs, bench).count() == 0 and decontam.overlaps(docs, bench.limit(0)).count() == 0


def test_two_substitutions_in_thirteen_words_leave_a_hit():
    for a in range(13):
        for b in range(13):
            assert any(all(at + k not in (a, b) for k in mask) for mask in decontam.MASKS for at in range(13 - mask[-1]))


def test_masks_of_short_items_leave_a_hit():
    for n in range(1, 13):
        differ = n - math.ceil(0.8 * n - 1e-9)
        for gone in itertools.combinations(range(n), differ):
            assert any(not set(gone) & set(mask) for mask in decontam.short_masks(n)), (n, gone)


def test_decontamination_of_short_items(spark):
    """Items of 1 to 13 words, with every allowed set of substitutions and one more, in one pass of rows."""
    rng = random.Random(12)
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(1, 14)] + [(20, None), (21, " "), (22, "")]
    rows, want = [document(0, None), document(1, ""), document(2, " ")], set()
    for n, text in items[:13]:
        allowed = n - math.ceil(0.8 * n - 1e-9)
        for differ in range(min(n, allowed + 1) + 1):
            for gone in itertools.combinations(range(n), differ):
                words = ["zzz" if k in gone else w for k, w in enumerate(text.split())]
                before, after = ([prose(rng, 3)] * rng.randint(0, 1) for _ in range(2))
                rows.append(document(len(rows), " ".join([*before, *words, *after])))
                if differ <= allowed:
                    want.add((len(rows) - 1, n, n - differ, n))
    docs = spark.createDataFrame(rows, DOCS)
    got = {tuple(r) for r in decontam.overlaps(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want


# files and the pipeline


def test_attempts_write_different_files(tmp_path):
    (one, a), (two, b) = files.writer(str(tmp_path), "x"), files.writer(str(tmp_path), "x")
    one.close(), two.close()
    assert a != b


def test_pipeline_takes_effect(spark):
    import __spark_entry__ as entry
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    folder = entry.SMOKE_DIR
    docs, counts = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        counts.append(docs.count())
    path, at, want = public_tokenizers.path("byte_bpe_50k.json"), 0, []
    library = Tokenizer.from_file(path)
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id, r.text)):
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert rows_of(corpus_pipeline.run(spark, folder)) == sorted(want)
    assert counts[1] < 200 and counts[2] < counts[1]
