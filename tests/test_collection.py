"""Collection and publication: what a stop between batches, a replay and late rows change (nothing)."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from verdure.operators import records, store
from verdure.streaming import collect

SCENES = "field_id int, scene_id string, sensed_on date, value double"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def drop(spark, folder, name, rows, schema=SCENES):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / name))


def analyse(batch):
    return batch.select("field_id", "scene_id", F.col("sensed_on").alias("pass_date"), "value", F.col("cursor"), F.trunc("sensed_on", "MM").alias("month"))


def run(spark, tmp, analyse=analyse):
    stream = spark.readStream.schema(SCENES).option("maxFilesPerTrigger", 1).parquet(str(tmp / "in"))
    q = collect.collect(stream, analyse, str(tmp / "facts"), ["field_id", "scene_id", "month"], [], str(tmp / "ck"))
    q.awaitTermination()
    return {(r.field_id, r.scene_id): (r.pass_date, r.value) for r in spark.read.parquet(str(tmp / "facts")).collect()}


def test_collection_survives_stops_and_late_rows(spark, tmp_path):
    first = [(1, "a", day(0), 1.0), (1, "a", day(0), 1.0), (1, "b", day(40), 2.0), (2, "a", day(3), 3.0), (3, None, day(1), 9.0), (3, "x", None, 9.0)]
    drop(spark, tmp_path, "in", first)
    want = {(1, "a"): (day(0), 1.0), (1, "b"): (day(40), 2.0), (2, "a"): (day(3), 3.0)}
    assert run(spark, tmp_path) == want
    # a late scene, one seen before with another value, and a new field; the sink fails once in between
    drop(spark, tmp_path, "in", [(1, "late", day(5), 4.0), (1, "b", day(40), 99.0), (4, "q", day(70), 5.0)])
    calls = []

    def fails(batch):
        calls.append(1)
        raise RuntimeError("no")

    with pytest.raises(Exception, match="no"):
        run(spark, tmp_path, fails)
    got = run(spark, tmp_path)
    assert calls and got == want | {(1, "late"): (day(5), 4.0), (4, "q"): (day(70), 5.0)}
    assert run(spark, tmp_path) == got
    cursors = {r.field_id: r.c for r in spark.read.parquet(str(tmp_path / "facts")).groupBy("field_id").agg(F.max("cursor").alias("c")).collect()}
    assert cursors == {1: day(40), 2: day(3), 4: day(70)}


def files(folder):
    return {p: os.stat(os.path.join(folder, p)).st_mtime_ns for p in os.listdir(folder)}


def test_merge_touches_its_months_only(spark, tmp_path):
    path = str(tmp_path / "facts")
    schema = "k int, v double, made string, at int, month date"
    old = [(1, 1.0, "a", 0, day(0)), (2, 2.0, "a", 0, day(0)), (3, 3.0, "a", 0, day(31)), (4, 4.0, "a", 0, day(60))]
    assert sorted(map(tuple, store.merge(path, spark.createDataFrame(old, schema), ["k", "month"], ["made"], "month").collect())) == [(day(0), 2, 2), (day(31), 1, 1), (day(60), 1, 1)]
    before = {m: files(os.path.join(path, m)) for m in os.listdir(path) if m.startswith("month")}
    new = [(2, None, "b", 1, day(0)), (5, 5.0, "b", 1, day(0)), (5, 6.0, "b", 2, day(0))]
    for _ in range(2):  # again changes nothing
        store.merge(path, spark.createDataFrame(new, schema), ["k", "month"], ["made"], "month", order="at")
        got = sorted(((r.k, r.v, r.made) for r in spark.read.parquet(path).collect()), key=str)
        assert got == [(1, 1.0, "a"), (2, None, "a"), (3, 3.0, "a"), (4, 4.0, "a"), (5, 6.0, "b")]
    after = {m: files(os.path.join(path, m)) for m in os.listdir(path) if m.startswith("month")}
    assert {m for m in before if before[m] != after[m]} == {"month=2024-01-01"}
    plan = spark.read.schema(schema).parquet(path).where(F.col("month").isin([day(0)]))._jdf.queryExecution().executedPlan().toString()
    assert "(month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert store.merge(path, spark.createDataFrame([], schema), ["k", "month"], ["made"], "month").count() == 0


PAYLOADS = "key string, farm_id string, results bigint, at timestamp"


def test_publication_is_idempotent(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    drop(spark, tmp_path, "out", [("k1", "f", 3, at), ("k1", "f", 3, at), ("bad", "g", 1, at)], PAYLOADS)
    sent = []

    def deliver(todo):
        sent.append(sorted(r.key for r in todo.collect()))
        return todo.select("key", (F.col("key") != "bad").alias("ok"), F.when(F.col("key") == "bad", "refused").alias("detail"))

    def go(deliver=deliver):
        stream = spark.readStream.schema(PAYLOADS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "out"))
        collect.publish(stream, deliver, str(tmp_path / "outbox"), str(tmp_path / "pk")).awaitTermination()

    go()
    drop(spark, tmp_path, "out", [("k1", "f", 3, at), ("bad", "g", 1, at), ("k2", "f", 4, at)], PAYLOADS)

    def dies(todo):
        raise RuntimeError("gateway")

    with pytest.raises(Exception, match="gateway"):
        go(dies)
    go()
    go()
    assert sent == [["bad", "k1"], ["bad", "k2"]]
    log = collect.attempts(spark, str(tmp_path / "outbox"))
    none = spark.createDataFrame([], "key string, farm_id string, results bigint, status string, attempts bigint, detail string, last_at timestamp")
    got = {r.key: (r.status, r.attempts, r.detail) for r in store.settle(none, log).collect()}
    assert got == {"k1": ("published", 1, None), "k2": ("published", 1, None), "bad": ("dead_letter", 2, "refused")}


def test_settle(spark):
    at = lambda n: dt.datetime(2024, 1, n)
    log = spark.createDataFrame([("a", "f", 1, "published", 1, None, at(1)), ("b", "f", 2, "dead_letter", 2, "x", at(1)), ("c", "g", 3, "pending", 0, None, None)], "key string, farm_id string, results bigint, status string, attempts bigint, detail string, last_at timestamp")
    outcomes = spark.createDataFrame([("a", "f", 1, False, "late", at(2)), ("b", "f", 2, True, None, at(2)), ("d", "g", 4, False, "y", at(3)), ("d", "g", 4, False, "z", at(4))], "key string, farm_id string, results bigint, ok boolean, detail string, at timestamp")
    got = {r.key: (r.status, r.attempts, r.detail, r.last_at) for r in store.settle(log, outcomes).collect()}
    assert got == {"a": ("published", 2, None, at(2)), "b": ("published", 3, None, at(2)), "c": ("pending", 0, None, None), "d": ("dead_letter", 2, "z", at(4))}


def test_pushable(spark):
    half = "struct<pass_date:date,scene_id:string,provider:string,clear_fraction:double>"
    rows = [
        ("ok", "ndvi", None, day(1), "s1", "p", "live", 0.9, 0.5, None, None),
        ("interpolated", "ndvi", day(5), None, None, None, None, 0.1, 0.6, (day(2), "a", "p", 0.5), (day(8), "b", "q", 0.7)),
        ("interpolated", "evi2", None, None, None, None, None, 0.1, 0.6, (day(2), None, None, None), (day(8), "b", "q", 0.7)),
        ("interpolated", "savi", day(6), None, None, None, None, None, 0.6, None, None),
        ("no_scene", "ndvi", day(9), day(9), "z", "p", "live", 1.0, 0.1, None, None),
        ("ok", "ndmi", None, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, f"status string, index_name string, requested_date date, pass_date date, scene_id string, provider string, processing_mode string, clear_fraction double, mean double, before {half}, after {half}")
    got = sorted((r.index_name, r.pass_date, r.scene_id, r.provider, r.clear_fraction, r.processing_mode) for r in records.pushable(df).collect())
    assert got == [("evi2", day(2), "avg:+b", "q", 0.1, "interpolated"), ("ndvi", day(1), "s1", "p", 0.9, "live"), ("ndvi", day(5), "avg:a+b", "p", pytest.approx(0.6), "interpolated"), ("savi", day(6), "interpolated", "interpolated", 0.0, "interpolated")]
