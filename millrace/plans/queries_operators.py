"""Registered queries of single operators: sampling, vectors, time, functions, ingest, runs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import udfs
from millrace.functions.expressions import each_token, joined_values, matrix_rows, normalise_department, planar_distance, tokens
from millrace.operators import factorisation, neighbours, quantiles, sampling
from millrace.plans import runs
from millrace.plans import surrogates as S
from millrace.plans.registry import query
from millrace.session import shared_folder
from millrace.sources import checks, delimited, numbering
from millrace.streaming import buckets

# ---------------------------------------------------------------- sampling


@query(
    "stratified_sample",
    """WITH r AS (SELECT o_orderkey, o_orderpriority,
           row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-42'), o_orderkey) k,
           count(*) OVER (PARTITION BY o_orderpriority) n FROM orders)
       SELECT o_orderkey, o_orderpriority FROM r WHERE k <= ceil(0.3::DOUBLE * n)""",
)
def stratified_sample(src: S.Source) -> DataFrame:
    orders = src["orders"].select("o_orderkey", "o_orderpriority")
    return sampling.stratified_sample(orders, 0.3, "o_orderkey", "o_orderpriority")


@query(
    "balance_sample",
    """WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END failure FROM events),
       r AS (SELECT *, row_number() OVER (PARTITION BY failure ORDER BY md5(CAST(event_id AS VARCHAR) || '-42'), event_id) k,
                    count(*) OVER (PARTITION BY failure) n, count(*) OVER () total FROM e),
       g AS (SELECT *, CAST(ceil(total / 2.0) AS BIGINT) goal FROM r),
       c AS (SELECT event_id, failure, CASE WHEN goal <= n THEN CASE WHEN k <= goal THEN 1 ELSE 0 END
                    ELSE goal // n + CASE WHEN k <= goal % n THEN 1 ELSE 0 END END copies FROM g)
       SELECT event_id, failure, CAST(i AS BIGINT) AS copy_no FROM c, unnest(range(1, copies + 1)) t(i)""",
)
def balance_sample(src: S.Source) -> DataFrame:
    events = src["events"].select("event_id", (F.col("event_type") == "error").cast("int").alias("failure"))
    return sampling.balance_sample(events, "event_id", "failure")


_DIMENSIONS = 64


def _draw(seed: int) -> str:
    text = f"CAST(w.q AS VARCHAR) || '-' || CAST(no AS VARCHAR) || '-{seed}'"
    return f"CAST(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"


_ADASYN_COLUMNS = ", ".join(f"round(v[{i + 1}], 5) AS e{i}" for i in range(_DIMENSIONS))


@query(
    "adasyn",
    f"""WITH e AS (SELECT vec_id id, CASE WHEN label = 0 THEN 1 ELSE 0 END lab, CAST(embedding AS DOUBLE[]) v FROM embeddings),
    d AS (SELECT m.id q, e.id i, e.lab,
                 sqrt(list_sum(list_transform(list_zip(m.v, e.v), lambda z: pow(z[1] - z[2], 2)))) dist
          FROM e m JOIN e ON m.id <> e.id WHERE m.lab = 1),
    near AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, i) k FROM d),
    hard AS (SELECT q, count(*) hits FROM near WHERE k <= 5 AND lab = 0 GROUP BY 1),
    gap AS (SELECT count(*) FILTER (WHERE lab = 0) - count(*) FILTER (WHERE lab = 1) g FROM e),
    w AS (SELECT q, CAST(round_even(hits * g / (SELECT sum(hits) FROM hard), 0) AS BIGINT) g FROM hard, gap),
    same AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, i) k FROM d WHERE lab = 1),
    partners AS (SELECT q, list(i ORDER BY k) ids FROM same WHERE k <= 5 GROUP BY 1),
    chosen AS (SELECT w.q, ids[1 + CAST(floor({_draw(42)} * len(ids)) AS BIGINT)] partner, {_draw(43)} step
               FROM w JOIN partners ON w.q = partners.q, unnest(range(1, w.g + 1)) t(no)),
    made AS (SELECT list_transform(list_zip(a.v, b.v), lambda z: z[1] + (z[2] - z[1]) * step) v
             FROM chosen JOIN e a ON a.id = q JOIN e b ON b.id = partner)
    SELECT {_ADASYN_COLUMNS}, lab AS label, false AS synthetic FROM e
    UNION ALL SELECT {_ADASYN_COLUMNS}, 1, true FROM made""",
)
def adasyn(src: S.Source) -> DataFrame:
    """Oversample embedding label 0, on all dimensions."""
    names = [f"e{i}" for i in range(_DIMENSIONS)]
    rows = src["embeddings"].select(
        "vec_id", (F.col("label") == 0).cast("int").alias("label"), *[F.col("embedding")[i].alias(n) for i, n in enumerate(names)]
    )
    made = neighbours.adasyn(rows, "vec_id", names, "label")
    return made.withColumns({n: F.round(n, 5) for n in names})


# ---------------------------------------------------------------- vectors, matrices, points

_MEANS = """
parts AS (SELECT label, unnest(embedding) x, generate_subscripts(embedding, 1) i FROM embeddings),
cells AS (SELECT label, i, avg(CAST(x AS DOUBLE)) x FROM parts GROUP BY 1, 2),
means AS (SELECT label, list(x ORDER BY i) vec FROM cells GROUP BY 1)
"""


@query(
    "knn_l2",
    f"""WITH {_MEANS}, d AS (SELECT CAST(m.label AS BIGINT) query_id, vec_id item_id,
            sqrt(list_sum(list_transform(list_zip(vec, embedding), lambda z: pow(z[1] - CAST(z[2] AS DOUBLE), 2)))) distance
            FROM means m, embeddings),
       r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) rank FROM d)
       SELECT query_id, item_id, round(distance, 5) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""",
)
def knn_l2(src: S.Source) -> DataFrame:
    items = src["embeddings"].select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    found = neighbours.knn(items, S.label_means(src), 5)
    return found.withColumn("distance", F.round("distance", 5))


@query(
    "top_k_l2",
    """SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding, lambda z: pow(CAST(z AS DOUBLE) - 0.05, 2)))), 5)
       AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 5""",
)
def top_k_l2(src: S.Source) -> DataFrame:
    found = neighbours.nearest(src["embeddings"], "vec_id", "embedding", [0.05] * 64, 5)
    return found.select("vec_id", "label", F.round("distance", 5).alias("distance"))


@query(
    "matrix_multiply",
    f"""WITH {_MEANS} SELECT vec_id AS row_id, CAST(m.label AS BIGINT) AS col_id,
        round(list_sum(list_transform(list_zip(vec, embedding), lambda z: z[1] * CAST(z[2] AS DOUBLE))), 6) AS value
        FROM embeddings, means m""",
)
def matrix_multiply(src: S.Source) -> DataFrame:
    rows = src["embeddings"].select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vals"))
    columns = S.label_means(src).select(F.col("id").alias("row_id"), F.col("vec").alias("vals"))
    return factorisation.matrix_multiply(rows, columns).withColumn("value", F.round("value", 6))


@query(
    "matrix_unnest",
    """WITH c AS (SELECT vec_id, unnest(embedding) x, generate_subscripts(embedding, 1) - 1 i FROM embeddings)
       SELECT vec_id, CAST(i // 8 + 1 AS INTEGER) AS row_no, CAST(i % 8 + 1 AS INTEGER) AS col_no, CAST(x AS DOUBLE) AS value FROM c""",
)
def matrix_unnest(src: S.Source) -> DataFrame:
    rows = src["embeddings"].select("vec_id", F.posexplode(matrix_rows(F.col("embedding"), 8)).alias("r", "vals"))
    cells = rows.select("vec_id", "r", F.posexplode("vals").alias("c", "x"))
    return cells.select(
        "vec_id", (F.col("r") + 1).alias("row_no"), (F.col("c") + 1).alias("col_no"), F.col("x").cast("double").alias("value")
    )


@query(
    "geo_pair_distance",
    """WITH pairs AS (SELECT DISTINCT o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
       SELECT c_name AS point_a, s_name AS point_b,
              round(sqrt(pow(c_nationkey - s_nationkey, 2) + pow(c_acctbal / 1000 - s_acctbal / 1000, 2)), 6) AS distance
       FROM pairs JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey""",
)
def geo_pair_distance(src: S.Source) -> DataFrame:
    """Named pairs of points, looked up by key: who buys from whom, and how far apart."""
    pairs = (
        src["lineitem"].join(src["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
        .select("o_custkey", "l_suppkey").distinct()
    )
    a = src["customer"].select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("point_a"),
        F.col("c_nationkey").alias("ax"), (F.col("c_acctbal") / 1000).alias("ay"),
    )
    b = src["supplier"].select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("point_b"),
        F.col("s_nationkey").alias("bx"), (F.col("s_acctbal") / 1000).alias("by"),
    )
    distance = planar_distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return pairs.join(a, "o_custkey").join(b, "l_suppkey").select("point_a", "point_b", F.round(distance, 6).alias("distance"))


# ---------------------------------------------------------------- grouped medians and time buckets

_MEDIAN = "SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY 1"


@query("median_by_group", _MEDIAN)
def median_by_group(src: S.Source) -> DataFrame:
    return quantiles.grouped_median(src["events"], ["event_type"], "value").withColumn("median", F.round("median", 6))


@query("udaf_median", _MEDIAN)
def udaf_median(src: S.Source) -> DataFrame:
    found = quantiles.median_by_user_aggregate(src["events"], ["event_type"], "value")
    return found.withColumn("median", F.round("median", 6))


_LOCAL = "timezone('Europe/Berlin', timezone('UTC', ts))"
_BUCKETS = f"""
e AS (SELECT *, {_LOCAL} lts FROM events),
b AS (SELECT date_trunc('day', lts)::TIMESTAMP d, event_type,
             round_even((arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id))) * 100.0, 0) / 100.0 AS value
      FROM e GROUP BY 1, 2)
"""
_BUCKET_COLUMNS = "timezone('UTC', timezone('Europe/Berlin', d)) AS time, event_type, value"


@query("time_bucket_delta", f"WITH {_BUCKETS} SELECT {_BUCKET_COLUMNS} FROM b")
def time_bucket_delta(src: S.Source) -> DataFrame:
    return buckets.daily_change(src["events"], ["event_type"], "ts", "value", "event_id")


@query(
    "time_bucket_stream",
    f"WITH {_BUCKETS} SELECT {_BUCKET_COLUMNS} FROM b WHERE d + INTERVAL 1 DAY <= (SELECT max(lts) - INTERVAL 1 HOUR FROM e)",
)
def time_bucket_stream(src: S.Source) -> DataFrame:
    """The bucket aggregate run as a stream to the end of the data; open days stay out."""
    spark = src.spark
    buckets.use_disk_state(spark)
    events = spark.readStream.schema(src["events"].schema).parquet(f"{src.folder}/event[s].parquet")  # a stream opens single files by pattern only
    days = buckets.daily_change_stream(events, ["event_type"], "ts", "value", "event_id")
    base = f"{shared_folder(spark)}/time_bucket_stream-{uuid.uuid4().hex}"
    buckets.drain(days, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema(days.schema).parquet(f"{base}/out")


# ---------------------------------------------------------------- functions


@query(
    "udf_pymax",
    "SELECT l_orderkey, l_linenumber, l_suppkey, CAST(greatest(l_linenumber, l_suppkey) AS INTEGER) AS larger FROM lineitem",
)
def udf_pymax(src: S.Source) -> DataFrame:
    udfs.register(src.spark)
    larger = F.expr("pymax(l_linenumber, CAST(l_suppkey AS INT))")
    return src["lineitem"].select("l_orderkey", "l_linenumber", "l_suppkey", larger.alias("larger"))


@query(
    "udtf_tokens",
    """WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) token,
                         generate_subscripts(string_split(text, ' '), 1) ix FROM documents)
       SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ix) AS INTEGER) AS position, token
       FROM w WHERE token <> ''""",
)
def udtf_tokens(src: S.Source) -> DataFrame:
    documents = src["documents"].select("doc_id", "text")
    return documents.lateralJoin(udfs.SplitTokens(F.col("text").outer())).select("doc_id", "position", "token")


@query(
    "dept_normalise",
    "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9_]+', '_', 'g') AS department FROM part",
)
def dept_normalise(src: S.Source) -> DataFrame:
    return src["part"].select("p_partkey", normalise_department(F.col("p_name")).alias("department"))


@query(
    "token_vocabulary",
    r"""WITH w AS (SELECT unnest(string_split(lower(regexp_replace(text, '[^a-zA-Z0-9\s]', '', 'g')), ' ')) token FROM documents)
        SELECT token, count(*) AS n FROM w WHERE token <> '' AND NOT regexp_full_match(token, '\d+') GROUP BY 1""",
)
def token_vocabulary(src: S.Source) -> DataFrame:
    words = each_token(src["documents"], [], tokens(F.col("text"), drop_numeric=True))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "joined_types",
    """WITH j AS (SELECT p_brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) types FROM part GROUP BY 1),
       s AS (SELECT p_brand, unnest(string_split(types, '|')) p_type, generate_subscripts(string_split(types, '|'), 1) ix FROM j)
       SELECT p_brand, CAST(ix AS INTEGER) AS position, p_type FROM s""",
)
def joined_types(src: S.Source) -> DataFrame:
    """The types of a brand joined to one text, and cut again."""
    joined = src["part"].groupBy("p_brand").agg(joined_values("p_type").alias("types"))
    parts = joined.select("p_brand", F.posexplode(F.split("types", r"\|")).alias("at", "p_type"))
    return parts.select("p_brand", (F.col("at") + 1).alias("position"), "p_type")


@query(
    "all_positive",
    "SELECT event_type, bool_and(value > 0) AS all_positive, bool_and(user_id IS NOT NULL) AS all_known FROM events GROUP BY 1",
)
def all_positive(src: S.Source) -> DataFrame:
    return src["events"].groupBy("event_type").agg(
        F.bool_and(F.col("value") > 0).alias("all_positive"), F.bool_and(F.col("user_id").isNotNull()).alias("all_known")
    )


# ---------------------------------------------------------------- ingest


@query(
    "series_avg",
    """SELECT l_returnflag, count(i) AS n, avg(i) AS mean
       FROM lineitem, unnest(range(1, CAST(l_quantity AS BIGINT) + 1)) t(i) GROUP BY 1""",
)
def series_avg(src: S.Source) -> DataFrame:
    """A generated series 1..quantity per line, averaged."""
    series = F.explode(F.sequence(F.lit(1), F.col("l_quantity").cast("int")))
    numbers = src["lineitem"].select("l_returnflag", series.alias("i"))
    return numbers.groupBy("l_returnflag").agg(F.count("i").alias("n"), F.avg("i").alias("mean"))


@query(
    "row_ids",
    "SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_id, o_orderkey, o_orderdate FROM orders",
)
def row_ids(src: S.Source) -> DataFrame:
    return numbering.row_ids(src["orders"].select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])


@query(
    "dedup_keep_first",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey
                  ORDER BY l_linenumber, l_suppkey, l_shipdate, l_extendedprice) k FROM lineitem)
       SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_shipdate, l_extendedprice FROM r WHERE k = 1""",
)
def dedup_keep_first(src: S.Source) -> DataFrame:
    first_by = ["l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice"]
    lines = src["lineitem"].select("l_orderkey", "l_partkey", *first_by).withColumn("at", F.struct(*first_by))
    return delimited.keep_first(lines, ["l_orderkey", "l_partkey"], "at").drop("at")


@query("dq_primary_key", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dq_primary_key(src: S.Source) -> DataFrame:
    return checks.duplicate_keys(src["lineitem"], ["l_orderkey", "l_partkey"])


@query(
    "dq_foreign_key",
    "SELECT doc_id AS value, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1",
)
def dq_foreign_key(src: S.Source) -> DataFrame:
    return checks.orphans(src["documents"], "doc_id", src["labels"], "doc_id")


@query(
    "dq_not_null",
    """WITH j AS (SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
       SELECT 'quality' AS column_name, count(*) - count(quality) AS nulls FROM j
       UNION ALL SELECT 'toxic', count(*) - count(toxic) FROM j""",
)
def dq_not_null(src: S.Source) -> DataFrame:
    joined = src["documents"].select("doc_id").join(src["labels"], "doc_id", "left")
    return checks.null_counts(joined, ["doc_id", "quality", "toxic"])


@query(
    "ingest_csv",
    """SELECT CAST(o_orderkey AS INTEGER) AS o_order_id, CAST(o_custkey AS INTEGER) AS o_customer_sk,
              o_orderpriority AS weekday, CAST(o_orderdate AS DATE) AS date, CAST(NULL AS INTEGER) AS store,
              CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS trip_type FROM orders""",
)
def ingest_csv(src: S.Source) -> DataFrame:
    """Orders written twice over as a delimited file, read back as the declared order table."""
    rows = S.orders(src).join(src["orders"].select(F.col("o_orderkey").alias("o_order_id"), "o_orderpriority"), "o_order_id")
    out = rows.select(
        F.col("o_order_id").alias("O_ORDER_ID"), F.col("o_customer_sk").alias("O_Customer_SK"),
        F.col("o_orderpriority").alias("Weekday"), F.col("date").alias("Date"), F.col("trip_type").alias("Trip_Type"),
    )
    path = f"{shared_folder(src.spark)}/ingest_csv-{uuid.uuid4().hex}"
    out.unionByName(out).write.csv(path, sep=";", header=True)
    text = delimited.read_text_columns(src.spark, path)
    unique = delimited.keep_first(text, ["o_order_id"], "_order")
    return delimited.conform(unique, delimited.declared("order", "train"))


def _write_headed(lines: DataFrame, header: str, path: str) -> None:
    """Lines as text files, as many as there are partitions, each with its header."""

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"line": [header]})
        for batch in batches:  # named anew, as a column without nulls has another schema than the header
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["line"])

    alone = lines.sparkSession.createDataFrame([(header,)], "line string")  # for a table without rows
    alone.unionByName(lines.mapInArrow(headed, "line string")).write.text(path)


@query(
    "ingest_csv_quoted_breaks",
    """SELECT doc_id, replace(replace(text, chr(10), chr(10) || '"'), 'e', 'e;') || chr(10) AS text, source FROM documents WHERE text <> ''""",
)
def ingest_csv_quoted_breaks(src: S.Source) -> DataFrame:
    """Documents with quotes, delimiters and line breaks in their text, written as delimited lines and read back by many splits."""
    text = F.concat(F.replace(F.replace("text", F.lit("\n"), F.lit('\n"')), F.lit("e"), F.lit("e;")), F.lit("\n"))
    docs = src["documents"].where("text <> ''").select("doc_id", text.alias("text"), "source")
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    lines = docs.select(F.concat_ws(";", F.col("doc_id").cast("string"), quoted, F.coalesce("source", F.lit(""))).alias("line"))
    path = f"{shared_folder(src.spark)}/ingest_csv-{uuid.uuid4().hex}"
    _write_headed(lines, "DOC_ID;Text;SOURCE", path)
    read = delimited.read_text_columns(src.spark, path, keep_bad_bytes=True)
    return read.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")


_RAGGED = ["c_customer_sk", "c_customer_id", "c_current_addr_sk", "c_first_name", "c_last_name", "c_preferred_cust_flag",
           "c_birth_day", "c_birth_month", "c_birth_year", "c_birth_country", "c_login", "c_email_address"]


@query(
    "ingest_csv_ragged",
    """SELECT CAST(c_custkey AS INTEGER) AS c_customer_sk, c_name AS c_customer_id, CAST(c_nationkey AS INTEGER) AS c_current_addr_sk,
              CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || ', ' || c_custkey ELSE c_mktsegment END AS c_login,
              'm' || c_custkey AS c_email_address FROM customer""",
)
def ingest_csv_ragged(src: S.Source) -> DataFrame:
    """Customers as lines of which a third has a field cut at a delimiter: the halves are joined again."""
    key = F.col("c_custkey").cast("string")
    login = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_mktsegment", F.lit(","), key)).otherwise(F.col("c_mktsegment"))
    fields = [key, F.col("c_name"), F.col("c_nationkey").cast("string"), *[F.lit(x) for x in ("A", "B", "Y", "1", "2", "1990", "PERU")], login, F.concat(F.lit("m"), key)]
    path = f"{shared_folder(src.spark)}/ingest_csv-{uuid.uuid4().hex}"
    header = src.spark.createDataFrame([(",".join(_RAGGED).upper(),)], "line string")
    header.unionByName(src["customer"].select(F.concat_ws(",", *fields).alias("line"))).coalesce(1).write.text(path)
    read = delimited.conform(delimited.read_text_columns(src.spark, path, repair=True), delimited.declared("customer", "score"))
    return read.select("c_customer_sk", "c_customer_id", "c_current_addr_sk", "c_login", "c_email_address")


# ---------------------------------------------------------------- run statistics

_STATS = """
stats AS (SELECT event_type query, count(value) n, avg(value) mean, stddev_samp(value) stdev,
                 quantile_cont(value, 0.25) q1, quantile_cont(value, 0.5) median, quantile_cont(value, 0.75) q3,
                 min(value) lo, max(value) hi FROM events GROUP BY 1)
"""


@query(
    "run_stats",
    f"""WITH {_STATS} SELECT query, n, round(mean, 6) AS mean, round(stdev, 6) AS stdev, round(stdev / mean * 100, 6) AS cv_pct,
        round((q3 - q1) / (q3 + q1) * 100, 6) AS qcod_pct, round(q3 - q1, 6) AS iqr, round(median, 6) AS median,
        round(lo, 6) AS min, round(hi, 6) AS max FROM stats""",
)
def run_stats(src: S.Source) -> DataFrame:
    stats = runs.statistics(S.timings(src))
    return stats.withColumns({c: F.round(c, 6) for c in stats.columns if c not in ("query", "n")})


@query("run_geomean", f"WITH {_STATS} SELECT round(exp(avg(ln(median))), 6) AS geo_mean FROM stats")
def run_geomean(src: S.Source) -> DataFrame:
    medians = quantiles.grouped_median(S.timings(src), ["query"], "seconds")
    return runs.geometric_mean(medians).withColumn("geo_mean", F.round("geo_mean", 6))


@query(
    "artefact_list",
    r"""WITH a AS (SELECT 'uc01_orders' item_name, count(*) n_rows FROM orders UNION ALL SELECT 'uc01_parts', count(*) FROM part
                   UNION ALL SELECT 'uc01xnations', count(*) FROM nation)
        SELECT item_name, n_rows FROM a WHERE item_name LIKE 'uc01\_%' ESCAPE '\' AND item_name NOT LIKE '%xnations'""",
)
def artefact_list(src: S.Source) -> DataFrame:
    """Stored results with their sizes, picked by name; an escaped underscore is no wildcard."""
    base = f"{shared_folder(src.spark)}/artefact_list-{uuid.uuid4().hex}"
    log = runs.RunLog(src.spark, f"{base}/log")
    for name, table in (("uc01_orders", "orders"), ("uc01_parts", "part"), ("uc01xnations", "nation")):
        src[table].write.parquet(f"{base}/{name}")
        log.artefact(name, f"{base}/{name}")
    return log.artefacts(like=r"uc01\_%", not_like="%xnations").select("item_name", "n_rows")


@query(
    "run_qph",
    """WITH m AS (SELECT user_id, event_type, max(value) v FROM events GROUP BY 1, 2),
       s AS (SELECT user_id, count(*) n, sum(v) t FROM m GROUP BY 1)
       SELECT count(*) AS streams, round(sum(t), 4) AS sum_of_maxima, round(sum(n * 3600.0::DOUBLE / t), 4) AS queries_per_hour FROM s""",
)
def run_qph(src: S.Source) -> DataFrame:
    found = runs.throughput(S.timings(src))
    return found.withColumns({c: F.round(c, 4) for c in ("sum_of_maxima", "queries_per_hour")})


@query(
    "run_qph_span",
    "SELECT round(count(*) * 3600.0 / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1000000, 6) AS queries_per_hour FROM events",
)
def run_qph_span(src: S.Source) -> DataFrame:
    times = S.timings(src).select(F.col("ts").cast("timestamp").alias("ts"))
    return runs.throughput_by_span(times, "ts", "ts").select(F.round("queries_per_hour", 6).alias("queries_per_hour"))


@query(
    "run_total",
    """SELECT round(sum(value), 2) AS seconds FROM events""",
)
def run_total(src: S.Source) -> DataFrame:
    """Each event runs from ``ts`` for ``value`` seconds."""
    start = F.col("ts").cast("timestamp")
    micros = (F.col("seconds").cast("decimal(12,2)") * 1_000_000).cast("long")
    times = S.timings(src).select(
        start.alias("start_time"), F.timestamp_micros(F.unix_micros(start) + micros).alias("end_time")
    )
    return runs.total_time(times).select(F.round("seconds", 2).alias("seconds"))


_RUNS = """
r AS (SELECT CAST(floor((day(ts) - 1) / 8) AS INTEGER) run, event_type use_case, CAST(hour(ts) AS INTEGER) step,
             CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS secs FROM events GROUP BY 1, 2, 3),
j AS (SELECT a.use_case, a.step, a.secs s1, b.secs s5, c.secs s10, d.secs s15
      FROM r a JOIN r b ON a.use_case = b.use_case AND a.step = b.step JOIN r c ON a.use_case = c.use_case AND a.step = c.step
      JOIN r d ON a.use_case = d.use_case AND a.step = d.step
      WHERE a.run = 0 AND b.run = 1 AND c.run = 2 AND d.run = 3)
"""


def _clock_sql(c: str) -> str:
    micros = f"CAST(round({c} * 1000000) AS BIGINT)"
    return f"printf('%02d:%02d:%02d.%06d', {micros} // 3600000000, {micros} // 60000000 % 60, {micros} // 1000000 % 60, {micros} % 1000000)"


_RATIOS = ", ".join(
    f"round(s{k} / s1, 6) AS sf{k}_sf1_ratio, round((s{k} - s1) / s1 * 100, 4) AS sf{k}_sf1_percentage_change" for k in (5, 10, 15)
)
_CLOCKS = ", ".join(f"{_clock_sql(f's{k}')} AS sf{k}_duration" for k in (1, 5, 10, 15))


def _runs(src: S.Source) -> dict[str, DataFrame]:
    steps = S.run_steps(src)
    return {n: steps.filter(F.col("run") == i).drop("run") for i, n in enumerate(("sf1", "sf5", "sf10", "sf15"))}


@query("run_compare", f"WITH {_RUNS} SELECT use_case, step, {_RATIOS}, {_CLOCKS} FROM j")
def run_compare(src: S.Source) -> DataFrame:
    compared = runs.compare_durations(_runs(src))
    ratios = {c: F.round(c, 6) for c in compared.columns if c.endswith("_ratio")}
    changes = {c: F.round(c, 4) for c in compared.columns if c.endswith("_change")}
    return compared.withColumns({**ratios, **changes}).select(
        "use_case", "step", *ratios, *changes, *[c for c in compared.columns if c.endswith("_duration")]
    )


_SCORES = """
s AS (SELECT CAST(floor((day(ts) - 1) / 8) AS INTEGER) run, CAST(hour(ts) AS INTEGER) usecase,
             CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) v FROM events GROUP BY 1, 2)
"""


@query(
    "run_compare_scores",
    f"""WITH {_SCORES} SELECT a.usecase, a.v AS sf1_score, b.v AS sf5_score, c.v AS sf10_score, d.v AS sf15_score,
        printf('%.2f%%', (b.v - a.v) / a.v * 100) AS sf5_to_sf1_percentage,
        printf('%.2f%%', (c.v - a.v) / a.v * 100) AS sf10_to_sf1_percentage,
        printf('%.2f%%', (d.v - a.v) / a.v * 100) AS sf15_to_sf1_percentage
        FROM s a JOIN s b ON a.usecase = b.usecase JOIN s c ON a.usecase = c.usecase JOIN s d ON a.usecase = d.usecase
        WHERE a.run = 0 AND b.run = 1 AND c.run = 2 AND d.run = 3""",
)
def run_compare_scores(src: S.Source) -> DataFrame:
    scores = src["events"].groupBy(
        F.floor((F.dayofmonth("ts") - 1) / 8).cast("int").alias("run"), F.hour("ts").alias("usecase")
    ).agg(F.sum(F.col("value").cast("decimal(12,2)")).cast("double").alias("evaluation_score"))
    names = ("sf1", "sf5", "sf10", "sf15")
    return runs.compare_scores({n: scores.filter(F.col("run") == i).drop("run") for i, n in enumerate(names)})
