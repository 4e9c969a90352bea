"""One query per operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import ann, bpe, decontam, mixing, packed_ids, phrases, quality, simhash, spelling, suffix_dedup, token_counts, url_filter, warc
from millrace.llm.common import table
from millrace.llm.registry import query


@query("op3_url_filter")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.fit(url_filter.labelled_table(spark)))


@query("op4_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT payload_digest, payload_bytes, max(page_id) AS keeper FROM d WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM d LEFT JOIN g USING (payload_digest, payload_bytes)
"""


@query("op5_warc", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op6_packed_ids")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_ids.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query("op10_decontam")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_nearest")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query("op13_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
p AS (SELECT lang, [x FOR x IN string_split_regex(piece, '[\x20\x09]+') IF x <> ''] AS w FROM pieces),
f1 AS (SELECT lang, phrase, count(*) AS a FROM (SELECT lang, unnest(w) AS phrase FROM p) GROUP BY ALL),
f2 AS (SELECT lang, x[1] AS w1, x[2] AS w2, count(*) AS a FROM (SELECT lang, unnest([[w[i], w[i + 1]] FOR i IN range(1, len(w))]) AS x FROM p) GROUP BY ALL),
f3 AS (SELECT lang, x[1] AS w1, x[2] AS w2, x[3] AS w3, count(*) AS a FROM (SELECT lang, unnest([[w[i], w[i + 1], w[i + 2]] FOR i IN range(1, len(w) - 1)]) AS x FROM p) GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f1 GROUP BY lang),
c2 AS (SELECT * FROM f2 WHERE a >= 10),
c3 AS (SELECT * FROM f3 WHERE a >= 10),
held AS (SELECT lang, w1, w2, max(a) AS longer FROM (SELECT lang, w1, w2, a FROM c3 UNION ALL SELECT lang, w2, w3, a FROM c3) GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, 1 AS k, c.a, l.a AS l, r.a AS r
  FROM c2 c LEFT JOIN held h ON h.lang = c.lang AND h.w1 = c.w1 AND h.w2 = c.w2
  JOIN f1 l ON l.lang = c.lang AND l.phrase = c.w1 JOIN f1 r ON r.lang = c.lang AND r.phrase = c.w2
  WHERE h.longer IS NULL OR 100 * h.longer < 50 * c.a
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 1, c.a, l.a, r.a
  FROM c3 c JOIN f1 l ON l.lang = c.lang AND l.phrase = c.w1 JOIN f2 r ON r.lang = c.lang AND r.w1 = c.w2 AND r.w2 = c.w3
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 2, c.a, l.a, r.a
  FROM c3 c JOIN f2 l ON l.lang = c.lang AND l.w1 = c.w1 AND l.w2 = c.w2 JOIN f1 r ON r.lang = c.lang AND r.phrase = c.w3),
scored AS (SELECT *, CAST(1000000 * a::HUGEINT * a::HUGEINT // (l::HUGEINT * r::HUGEINT) AS BIGINT) AS score FROM cuts),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM low JOIN n USING (lang)
QUALIFY rank <= 2000
"""


@query("op12_phrases", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT 0 AS step, CAST(range AS UINTEGER) AS byte, CAST(range AS UINTEGER) AS v FROM range(256)
  UNION ALL
  SELECT step + 1, byte, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::UINTEGER) ELSE v >> 1 END FROM bits WHERE step < 8),
crc AS (SELECT list(v ORDER BY byte) AS t FROM bits WHERE step = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
d AS (SELECT id, run, count(*) AS c FROM runs GROUP BY ALL),
bytes AS (SELECT id, run, c, flatten([CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS UINTEGER)] ELSE [195::UINTEGER, CAST(ord(x) - 64 AS UINTEGER)] END FOR x IN string_split(id || ':' || run, '')]) AS b FROM d),
h AS (SELECT run, c, length(run) AS size, xor(list_reduce(list_prepend(4294967295::UINTEGER, b), lambda s, x: xor(t[CAST(xor(s, x) & 255 AS INTEGER) + 1], s >> 8)), 4294967295::UINTEGER) AS h FROM bytes, crc),
made AS (SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, CAST(h % size AS INTEGER)) || substring(run, CAST(h % size AS INTEGER) + 2) ELSE run END AS word, c FROM h),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n, length(word) AS size FROM made WHERE length(word) >= 6 GROUP BY ALL HAVING sum(c) >= 5),
gaps AS (SELECT word, n, size, unnest([{'k': k, 'rest': substring(word, 1, k - 1) || substring(word, k + 1)} FOR k IN range(1, size + 1)], recursive := true) FROM w),
near AS (
  SELECT a.word, b.word AS other, b.n FROM gaps a JOIN gaps b ON a.size = b.size AND a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION
  SELECT g.word, w.word, w.n FROM gaps g JOIN w ON g.rest = w.word
  UNION
  SELECT w.word, g.word, g.n FROM gaps g JOIN w ON g.rest = w.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top, min(other) FILTER (WHERE n = t) AS other FROM (SELECT *, max(n) OVER (PARTITION BY word) AS t FROM near) GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * w.n THEN other END AS form, CASE WHEN top >= 5 * w.n THEN top END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS here, 0 AS depth FROM forms UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN forms f ON f.word = c.here WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(here, depth) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""


@query("op11_spelling", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))
