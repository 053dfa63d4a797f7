"""Reviews, notes, exports, targets and groups by small cases; numbers against Python's own text."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from verdure.operators import desk, overlay, records


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(n)


def test_number_text(spark):
    rng = random.Random(4)
    values = [0.0, -0.0, 1.0, -2.5, 1e-3, 9.99e-4, 1e-4, 1.5e-4, 1e-5, 1.25e-7, 1e7, 12345678.0, 123456789.125, 1e15, 1.5e15, 1e16, 1.25e22, 1e100, -3e-300, 100.0, 0.1 + 0.2, float("inf"), float("-inf"), float("nan")]
    values += [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-9, 20) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = [r[0] for r in df.select(records.number_text(F.col("v"))).collect()]
    assert got == [repr(v) for v in values] + [None]


def test_reviews(spark):
    notes = spark.createDataFrame([(1, 7, "draft", False, True, None, None), (2, 7, "draft", True, True, None, None)], "note_id int, field_id int, narrative string, published boolean, needs_review boolean, reviewed_by string, reviewed_at timestamp")
    reviews = spark.createDataFrame([(1, 7, "a", True, "better", at(1)), (1, 7, "b", False, None, at(2)), (2, 8, "c", False, "other field", at(3)), (9, 7, "d", True, None, at(1))], "note_id int, field_id int, reviewer string, publish boolean, narrative string, at timestamp")
    got = sorted(map(tuple, desk.reviewed(notes, reviews).collect()))
    assert got == [(1, 7, "better", False, False, "b", at(2)), (2, 7, "draft", True, True, None, None)]


def test_notes(spark):
    notes = spark.createDataFrame([(1, 7, 1, "x")], "id int, field_id int, geometry_version int, body string")
    fields = spark.createDataFrame([(7, 3)], "field_id int, geometry_version int")
    more = desk.annotate(notes, spark.createDataFrame([(2, 7, "y"), (3, 99, "z")], "id int, field_id int, body string"), fields)
    assert sorted(map(tuple, more.collect())) == [(1, 7, 1, "x"), (2, 7, 3, "y")]
    left, removed = desk.erased(more, spark.createDataFrame([(1, 8), (2, 7), (2, 7)], "id int, field_id int"))
    assert [r.id for r in left.collect()] == [1] and sorted(map(tuple, removed.collect())) == [(1, 8, False), (2, 7, True)]


def test_states_and_context(spark):
    state = spark.createDataFrame([(1, 1, False, at(0)), (2, 1, False, None)], "field_id int, geometry_version int, backfill_complete boolean, last_poll_at timestamp")
    done = spark.createDataFrame([(1, 1, at(5)), (1, 1, at(4)), (3, 2, at(6))], "field_id int, geometry_version int, at timestamp")
    got = desk.backfilled(state, done)
    assert sorted(map(tuple, got.collect())) == [(1, 1, True, at(5)), (2, 1, False, None), (3, 2, True, at(6))]
    now = desk.present_states(spark.createDataFrame([(1, 1), (3, 1)], "field_id int, geometry_version int"), got)
    assert sorted((r.field_id, r.backfill_complete) for r in now.collect()) == [(1, True), (3, None)]
    passes = spark.createDataFrame([(1, day(40)), (2, day(40))], "field_id int, pass_date date")
    acts = spark.createDataFrame([(1, day(10), "spray"), (1, day(9), "planting"), (1, day(40), "irrigation"), (1, day(41), "spray"), (1, day(20), "weeding")], "field_id int, day date, activity string")
    assert sorted(map(tuple, desk.context_activities(passes, acts).collect())) == [(1, day(40), 2, "irrigation,spray", day(40)), (2, day(40), 0, "", None)]


def test_series_and_targets(spark):
    rows = spark.createDataFrame([("a", "ndvi", "2024-01-02", "ok"), ("a", "ndvi", "2024-01-01", "interpolated"), ("a", "ndvi", "2024-01-03", "error"), ("a", "evi2", "2024-01-03", "no_scene")], "k string, index_name string, pass_date string, status string")
    assert sorted(map(tuple, desk.envelope(rows, ["k"]).collect())) == [("a", "evi2", 1, 0, 0, ""), ("a", "ndvi", 3, 2, 1, "2024-01-01,2024-01-02")]
    stats = spark.createDataFrame([("tiles", 177.7, 0.5), ("none", None, 1.0)], "scenario string, p95 double, rate double")
    got = desk.judged(stats, [("tiles", "p95", 177.7, True), ("tiles", "rate", 1.0, False), ("none", "p95", 1.0, True), ("absent", "p95", 1.0, True)])
    assert sorted((r.scenario, r.metric, r.passed) for r in got.collect()) == [("none", "p95", False), ("tiles", "p95", True), ("tiles", "rate", False)]
    one = desk.isolated(spark.createDataFrame([(1.0,), (0.0,)], "q double"), 5 / F.when(F.col("q") != 0, F.col("q")), F.when(F.col("q") == 0, "no"))
    assert sorted(((r.status, r.detail, r.value) for r in one.collect()), key=str) == [("error", "no", None), ("ok", None, 5.0)]


def test_lines_pages_layers(spark):
    p = spark.createDataFrame([(day(1), "ok", 0.5, 10, None, "s1"), (None, "no_scene", 2.0, None, None, None)], "pass_date date, status string, mean double, resolution_m int, pixels int, scene_id string")
    assert [r.line for r in desk.client_lines(p).collect()] == [",2024-01-02,,,ok,0.5,,,,,,,10,,s1", ",,,,no_scene,2,,,,,,,,,"]
    rows = spark.createDataFrame([("a", i) for i in range(5)], "k string, v int")
    assert sorted((r.v, r.n) for r in desk.page(rows, ["k"], [F.desc("v")], 2, 1).collect()) == [(1, 4), (2, 3)]
    layers = spark.createDataFrame([(1, True, at(1)), (3, True, at(2)), (2, True, at(2)), (4, False, at(9))], "layer_id int, read_only boolean, created_at timestamp")
    assert [r.layer_id for r in desk.newest_layer(layers).collect()] == [2] and desk.newest_layer(layers.where("not read_only")).count() == 0
    g = spark.createDataFrame([(5, 1, 'b "q"', "drawn", None, [[[(30.0, -18.0), (30.5, -18.0), (30.0, -17.5)]]]), (6, 1, "a", "drawn", "II", None)], f"region_id int, layer_id int, name string, source string, dominant string, geometry {overlay.MULTI}")
    got = [json.loads(r.feature) for r in desk.features(g, F.coalesce(overlay.to_geojson(F.col("geometry")), F.lit("null"))).orderBy("n").collect()]
    assert [f["properties"].get("dominant") for f in got] == ["II", None] and got[1]["geometry"]["coordinates"] == [[[[30.0, -18.0], [30.5, -18.0], [30.0, -17.5]]]] and got[1]["properties"]["name"] == 'b "q"'


def test_local_times(spark):
    df = spark.createDataFrame([(at(0),)], "t timestamp").select(desk.local_time(F.col("t")).alias("a"), desk.utc_time(F.col("t")).alias("b"), desk.iso_utc(F.col("t")).alias("c"))
    r = df.first()
    assert (r.a, r.b, r.c) == (at(0) + dt.timedelta(hours=2), at(0) - dt.timedelta(hours=2), "2024-01-01T00:00:00Z")


def test_groups(spark):
    members = spark.createDataFrame([("g", i) for i in range(4)] + [("h", 9), ("h", 8), ("h", 7)], "group_id string, field_id int")
    reads = spark.createDataFrame([(0, day(0), 0.1), (1, day(10), 0.2), (1, day(14), 0.3), (2, day(40), 0.4), (9, day(3), 0.5)], "field_id int, pass_date date, mean double")
    ref = desk.reference_pass(members, reads)
    assert sorted(map(tuple, ref.collect())) == [("g", day(14))]
    near = sorted(map(tuple, desk.nearest_reads(members, reads, ref).collect()))
    assert near == [("g", 0, 0.1), ("g", 1, 0.3)]
    crops = spark.createDataFrame([("g", "maize", 1, 0.2), ("g", "maize", 2, 0.6), ("g", "maize", 3, 0.9), ("g", "tobacco", 4, 0.1)], "group_id string, crop string, field_id int, mean double")
    assert {r.field_id: r.percentile for r in desk.standing(crops).collect()} == {1: 0.0, 2: 0.5, 3: 1.0, 4: None}


def test_movement(spark):
    def label(deltas):
        df = spark.createDataFrame([("g", i, d) for i, d in enumerate(deltas)], "group_id string, field_id int, delta double")
        return [r.movement for r in desk.movement(df, -0.05).orderBy("field_id").collect()]

    assert label([-0.1] * 5) == ["systemic"] * 5
    assert label([-0.3, 0.0, 0.01, -0.01, 0.0]) == ["idiosyncratic"] + ["nominal"] * 4
    assert label([-0.1, -0.12, -0.09, -0.11, 0.0]) == ["systemic"] * 4 + ["resilient"]
    assert label([-0.3, 0.0, 0.0, 0.0, 0.0])[0] == "idiosyncratic" and label([-0.1] * 4) == [None] * 4


def test_boundary_versions(spark):
    def box(w):
        return [[[(31.0, -18.0), (31.0 + w, -18.0), (31.0 + w, -17.99), (31.0, -17.99)]]]

    rows = [(1, i, box(0.01 * (1 + 0.0004 * i))) for i in range(7)] + [(1, 7, None), (2, 0, box(0.01)), (2, 1, box(0.01)), (2, 2, box(0.02)), (2, 3, box(0.01))]
    got = sorted((r.field_id, r.version, r.valid_from, r.valid_to) for r in overlay.boundary_versions(spark.createDataFrame(rows, f"field_id int, at int, geometry {overlay.MULTI}")).collect())
    assert got == [(1, 1, 0, 3), (1, 2, 3, 6), (1, 3, 6, None), (2, 1, 0, 2), (2, 2, 2, 3), (2, 3, 3, None)]
