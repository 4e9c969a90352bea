"""Delimited files with every known defect, and all-or-nothing loading."""

from __future__ import annotations

import datetime as dt

import pytest

from millrace.sources import delimited, loader, tables
from millrace.sources.schemas import TABLES

HEADER = "C_CUSTOMER_SK,c_customer_id,c_current_addr_sk,c_first_name,c_last_name,c_preferred_cust_flag,c_birth_day," \
    "c_birth_month,c_birth_year,c_birth_country,c_login,c_email_address"


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_delimiter_detection():
    assert [delimited.detect_delimiter(h) for h in ("a,b;c", "a;b", "a\tb", "a|b", "a")] == [",", ";", "\t", "|", ","]


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_header_binds_by_name(spark, tmp_path, sep):
    rows = [["Department", "P_PRODUCT_ID"], ["Toys", "3"], ['"A""B"', "1"], ["", "2"]]
    write(tmp_path / "product.csv", "\n".join(sep.join(r) for r in rows))
    got = loader.read_table(spark, str(tmp_path / "product.csv"), "product", "train")
    assert got.dtypes == [("p_product_id", "int"), ("name", "string"), ("department", "string")]
    assert sorted(map(tuple, got.collect())) == [(1, None, 'A"B'), (2, None, None), (3, None, "Toys")]


@pytest.mark.parametrize("split, header, tail", [("score", HEADER, ""), ("train", HEADER + ",c_cluster_id", ",4")])
def test_ragged_customer_rows(spark, tmp_path, split, header, tail):
    base = "id{0},7,Ann,Lee,Y,1,2,1990,PERU"
    lines = [
        header,
        f"1,{base.format(1)},login1,a@x{tail}",
        f"2,{base.format(2)},log,in2,b@x{tail}",
        f"1,{base.format('dup')},login3,c@x{tail}",
    ]
    bad = f"3,{base.format(3)},lo\xff4,d@x{tail}".encode("latin-1")
    write(tmp_path / "customer.csv", "\n".join(lines).encode() + b"\n" + bad + b"\n")
    got = {r.c_customer_sk: r for r in loader.read_table(spark, str(tmp_path / "customer.csv"), "customer", split).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].c_customer_id, got[1].c_login) == ("id1", "login1")  # the first copy stays
    assert (got[2].c_login, got[2].c_email_address) == ("log, in2", "b@x")
    assert got[3].c_login == "lo�4"
    if split == "train":
        assert {r.c_cluster_id for r in got.values()} == {4}


def test_bad_bytes_vanish_elsewhere(spark, tmp_path):
    write(tmp_path / "review.psv", b"ID|spam|text\n1|0|caf\xe9 ok\n")
    row = loader.read_table(spark, str(tmp_path / "review.psv"), "review", "train").first()
    assert tuple(row) == (1, "caf ok", 0)


def test_file_lookup_ignores_case(spark, tmp_path):
    write(tmp_path / "Order_Returns.CSV", "a\n")
    assert delimited.find_file(spark, str(tmp_path), "order_returns.csv").endswith("Order_Returns.CSV")
    assert delimited.find_file(spark, str(tmp_path), "order.csv") is None
    assert delimited.find_file(spark, str(tmp_path / "none"), "order.csv") is None


def test_serial_ids_follow_the_file_over_many_splits(spark, tmp_path):
    n = 3000
    lines = ["date,serial_number,model,failure"] + [f"2024-01-01,d{i:05d},m,{i % 2}" for i in range(n)]
    write(tmp_path / "failures_labels.csv", "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = loader.read_table(spark, str(tmp_path / "failures_labels.csv"), "failures_labels", "score").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.id, r.serial_number) for r in got) == [(i + 1, f"d{i:05d}") for i in range(n)]


def shop(root, orphan=False):
    for folder in ("training", "serving", "scoring"):
        write(root / folder / "customer.csv", HEADER + "\n1" + ",x" * 0 + ",id,7,A,B,Y,1,2,1990,PERU,l,e\n")
        write(root / folder / "Order.csv", "o_order_id,o_customer_sk,weekday,date,store\n10,1,Mon,2024-01-01,3\n10,1,Tue,2024-01-02,3\n")
        write(root / folder / "product.csv", "p_product_id,name,department\n5,n,d\n")
        product = 6 if orphan and folder == "serving" else 5
        write(root / folder / "lineitem.csv", f"li_order_id,li_product_id,quantity,price\n10,{product},2,1.50\n")
        write(root / folder / "financial_transactions.csv",
              "transactionID,amount,IBAN,senderID,receiverID,isFraud,time\n9,1.5,DE,1,r,True,2024-01-01 10:00:00\n")


def test_load_publishes_all_or_nothing(spark, tmp_path):
    target = str(tmp_path / "lake")
    shop(tmp_path / "v1")
    first = loader.load(spark, str(tmp_path / "v1"), target)
    train, serve = loader.tables(spark, target, "train"), loader.tables(spark, target, "serve")
    assert set(train) == {"customer", "order", "product", "lineitem", "financial_transactions"}
    assert train["order"].first().date == dt.date(2024, 1, 1)  # keep-first
    assert train["financial_transactions"].first().isfraud is True
    assert "isfraud" not in serve["financial_transactions"].columns
    shop(tmp_path / "v2", orphan=True)
    with pytest.raises(ValueError, match="lineitem.li_product_id: no such product"):
        loader.load(spark, str(tmp_path / "v2"), target)
    assert spark.read.parquet(f"{target}/published").count() == 1
    assert first in loader.tables(spark, target, "serve")["lineitem"].inputFiles()[0]
    with pytest.raises(ValueError):
        loader.tables(spark, target, "test")


def test_every_declared_table_parses():
    for spec in TABLES.values():
        for split in spec.splits:
            names = spec.schema(split).names
            assert set(spec.required) <= set(names)


def test_day_partitions_are_pruned(spark, tmp_path):
    path = str(tmp_path / "metrics")
    df = spark.range(96).selectExpr("id", "timestamp'2024-03-01 00:00:00' + make_interval(0, 0, 0, 0, id) AS created")
    tables.write_by_day(df, "created", path)
    days = tables.read_days(spark, path, "2024-03-02", "2024-03-03")
    assert days.count() == 48
    assert "PartitionFilters: [isnotnull(day" in days._jdf.queryExecution().executedPlan().toString()


def test_replace_and_append(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.range(5).toDF("id"), path)
    assert tables.replace_table(spark.range(3).toDF("id"), path).count() == 3
    tables.append_rows(spark.range(2).toDF("id"), path)
    assert spark.read.parquet(path).count() == 5


def _file(tmp_path, text):
    path = tmp_path / "marketplace.csv"
    path.write_text(text)
    return str(path)


def test_quoted_line_breaks_stay_in_their_field(spark, tmp_path):
    rows = delimited.read_text_columns(spark, _file(tmp_path, 'a,b\n"x\ny",1\nz,2\n'))
    assert sorted((r.a, r.b) for r in rows.collect()) == [("x\ny", "1"), ("z", "2")]


@pytest.mark.parametrize("row", ["1,2,3", "1"])
def test_a_row_of_another_width_stops_the_load(spark, tmp_path, row):
    rows = delimited.read_text_columns(spark, _file(tmp_path, f"a,b\n1,2\n{row}\n"))
    with pytest.raises(Exception, match="has not 2 fields"):
        rows.collect()


def test_booleans_are_true_or_false_or_an_error(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("flag", T.BooleanType())])
    words = spark.createDataFrame([("True",), ("off",), (None,)], "flag string")
    assert [r.flag for r in delimited.conform(words, schema).collect()] == [True, False, None]
    with pytest.raises(Exception, match="no boolean"):
        delimited.conform(spark.createDataFrame([("maybe",)], "flag string"), schema).collect()


@pytest.mark.parametrize("split_bytes", [24, 61, 4096])
def test_records_over_many_splits(spark, tmp_path, split_bytes):
    import random

    rng = random.Random(split_bytes)
    fields = ["x", "", "two words", 'q"uo"te', "a\nb", "\n\n", "é,\n", "c\r\nd", "long " * 30 + "\n" * 5, '"']
    want = [[str(k), rng.choice(fields), rng.choice(fields)] for k in range(120)]
    quoted = lambda x: '"' + x.replace('"', '""') + '"' if any(c in x for c in '",\n\r') or rng.random() < 0.2 else x
    for name, part in (("a.csv", want[:80]), ("b.csv", want[80:])):
        lines = ["id,p,q"] + [",".join(map(quoted, row)) for row in part]
        write(tmp_path / "in" / name, "\ufeff" * (name == "a.csv") + rng.choice(["\n", "\r\n"]).join(lines))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = delimited.read_text_columns(spark, str(tmp_path / "in")).select("id", "p", "q", "_order.*").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(([r.id, r.p or "", r.q or ""] for r in rows), key=lambda r: int(r[0])) == [[x.replace("\r\n", "\n") for x in row] for row in want]
    in_file = [int(r.id) for r in sorted(rows, key=lambda r: (r.file, r.block, r.at))]
    assert in_file == sorted(in_file)
    assert split_bytes > 1000 or len({(r.file, r.block) for r in rows}) > 20


def test_quotes_inside_a_field_open_nothing(spark, tmp_path):
    rows = delimited.read_text_columns(spark, _file(tmp_path, 'a,b\n5" pipe,1\n\nx,"2"\n'))
    assert sorted((r.a, r.b) for r in rows.collect()) == [('5" pipe', "1"), ("x", "2")]


def test_lines_are_written_by_every_partition(spark, tmp_path):
    """One task that writes the whole table would read all of it."""
    from pyspark.sql import functions as F

    from millrace.plans import queries_operators

    docs = spark.range(40).repartition(4).select("id", F.concat(F.lit('"a;\n""'), F.col("id").cast("string"), F.lit('\n"')).alias("text"))
    lines = docs.select(F.concat_ws(";", F.col("id").cast("string"), "text").alias("line"))
    queries_operators._write_headed(lines, "ID;Text", str(tmp_path / "many"))
    assert len(list((tmp_path / "many").glob("part-*"))) > 4
    found = delimited.read_text_columns(spark, str(tmp_path / "many")).collect()
    assert sorted((int(r.id), r.text) for r in found) == [(k, f'a;\n"{k}\n') for k in range(40)]
    queries_operators._write_headed(lines.where("false"), "ID;Text", str(tmp_path / "none"))
    assert delimited.read_text_columns(spark, str(tmp_path / "none")).columns == ["id", "text", "_order"]
