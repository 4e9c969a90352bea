"""Day buckets across the changes of summer time, in batch and as a stream."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.streaming import buckets, serving

SCHEMA = "id long, created timestamp_ntz, type_id int, value double"


def readings(spark):
    """A reading every 30 minutes around both changes of 2024, rising by 1 each."""
    rows, value = [], 0.0
    for start in (dt.datetime(2024, 3, 30, 12), dt.datetime(2024, 10, 26, 12)):
        for i in range(96):
            rows.append((len(rows), start + dt.timedelta(minutes=30 * i), 5, value))
            value += 1.0
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(params=["UTC", "America/New_York"])
def session_zone(spark, request):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield
    spark.conf.set("spark.sql.session.timeZone", old)


def test_days_have_23_and_25_hours(spark, session_zone):
    got = buckets.daily_change(readings(spark), ["type_id"], "created", "value", "id").collect()
    by_day = {r.time: r.value for r in got}
    assert by_day[dt.datetime(2024, 3, 30, 23)] == 23 * 2 - 1  # 31 March starts at 23:00 UTC
    assert by_day[dt.datetime(2024, 10, 26, 22)] == 25 * 2 - 1  # 27 October starts at 22:00 UTC
    assert dt.datetime(2024, 3, 31, 22) in by_day and dt.datetime(2024, 10, 27, 23) in by_day


def test_rounding_is_half_to_even(spark):
    day = dt.datetime(2024, 5, 1, 10)
    rows = [(1, day, 1, 0.0), (2, day + dt.timedelta(hours=1), 1, 0.125), (3, day, 2, 0.0), (4, day + dt.timedelta(hours=1), 2, 0.375)]
    got = buckets.daily_change(spark.createDataFrame(rows, SCHEMA), ["type_id"], "created", "value", "id").collect()
    assert {r.type_id: r.value for r in got} == {1: 0.12, 2: 0.38}


def test_stream_equals_batch_on_closed_days(spark, tmp_path, session_zone):
    buckets.use_disk_state(spark)
    source = str(tmp_path / "in")
    readings(spark).repartition(3).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 3).parquet(source)
    days = buckets.daily_change_stream(stream, ["type_id"], "created", "value", "id")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    buckets.drain(days, out, state).awaitTermination()
    got = {(r.time, r.value) for r in spark.read.schema(days.schema).parquet(out).collect()}
    batch = buckets.daily_change(readings(spark), ["type_id"], "created", "value", "id")
    want = {(r.time, r.value) for r in batch.filter("time < timestamp_ntz'2024-10-27 23:00:00'").collect()}
    assert got == want and len(got) == 5
    # a restart finds nothing new and repeats nothing
    buckets.drain(days, out, state).awaitTermination()
    assert spark.read.schema(days.schema).parquet(out).count() == 5


def test_concurrent_serving_keeps_outputs_apart(spark, tmp_path):
    paths = serving.serve_concurrently(spark, "answers", lambda: spark.range(10).agg(F.sum("id").alias("s")), str(tmp_path), 3)
    assert len(set(paths)) == 3
    assert [spark.read.parquet(p).first().s for p in paths] == [45, 45, 45]
