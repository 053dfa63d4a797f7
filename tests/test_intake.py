"""Requests, keys, ingest and drawn regions by small cases."""

import datetime as dt
import json

from pyspark.sql import functions as F

from verdure.functions import columns as X
from verdure.operators import intake, overlay


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]


def polygon(*rings):
    return json.dumps({"type": "Polygon", "coordinates": [list(map(list, r)) for r in rings]})


def multi(ring):
    return [[[(float(x), float(y)) for x, y in ring]]]


def test_requests(spark):
    area = multi(square(31, -18, 0.5))
    base = {"mode": "dates", "index": "NDVI ", "indices": None, "dates": [day(0)], "months": None, "geometry": area}
    cases = [
        ({}, None),
        ({"indices": ["ndvi"]}, "provide exactly one of `index` or `indices`"),
        ({"index": None}, "provide exactly one of `index` or `indices`"),
        ({"index": None, "indices": []}, "`indices` must be non-empty"),
        ({"index": None, "indices": ["evi2", "x"]}, "unknown index 'x'"),
        ({"dates": None}, "provide between 1 and 24 dates"),
        ({"dates": [day(-i) for i in range(25)]}, "provide between 1 and 24 dates"),
        ({"dates": [day(1)]}, "dates cannot be in the future"),
        ({"mode": "backfill", "months": 19}, "months must be between 1 and 18"),
        ({"mode": "backfill", "months": 0}, None),
        ({"mode": "other"}, "unknown AOI series mode 'other'"),
        ({"geometry": None}, "geometry has no coordinates"),
        ({"geometry": multi(square(31, -18, 2.1))}, "AOI is too large for a preview (over 2.0 degrees across); draw a field-sized area."),
    ]
    schema = f"mode string, index string, indices array<string>, dates array<date>, months int, geometry {overlay.MULTI}, want string"
    df = spark.createDataFrame([(*(base | c).values(), w) for c, w in cases], schema)
    assert [(r.want, r.got) for r in df.withColumn("got", intake.refused(F.lit(day(0)), X.index_names())).collect()] == [(w, w) for _, w in cases]


def test_keys(spark):
    df = spark.createDataFrame([(multi(square(31, -18, 0.5)), multi(square(31, -18, 0.5)[2:] + square(31, -18, 0.5)[1:3]))], f"a {overlay.MULTI}, b {overlay.MULTI}")
    r = df.select(intake.result_key(F.col("a"), F.lit("ndvi"), F.lit("s")).alias("a"), intake.result_key(F.col("b"), F.lit("ndvi"), F.lit("s")).alias("b"), intake.scene_unit(F.lit(4), F.lit("s"), F.lit(2)).alias("u"), intake.field_unit(F.lit(4), F.lit(2)).alias("f")).first()
    assert r.a == r.b and r.a.endswith(":ndvi:1:s") and (r.u, r.f) == ("collect:4:s:v2", "collect:field:4:v2")
    asked = spark.createDataFrame([("k", 1), ("k", 2), ("l", 3)], "key string, n int")
    assert [r.key for r in intake.uncomputed(asked, spark.createDataFrame([("l",)], "key string")).collect()] == ["k"]


def test_ingest(spark):
    farms = [("declared", polygon(square(31, -18, 0.02)), 4326, 100), ("union", None, 4326, 101), ("loose", polygon(square(31, -18, 0.02)), 4326, 102), ("bad", "{", 4326, 103), ("none", None, 4326, 104), ("alone", polygon(square(32, -18, 0.02)), 4326, 105), ("point", '{"type": "Point", "coordinates": [1, 2]}', 4326, 106)]
    fields = [(1, "declared", "a", polygon(square(31.001, -17.999, 0.005)), 4326), (2, "declared", None, polygon(square(31.01, -17.99, 0.005)), 4326), (3, "union", "c", polygon(square(31, -18, 0.01)), 4326), (4, "loose", None, polygon(square(31.015, -18, 0.01)), 4326), (5, "loose", "z", polygon(square(40, -18, 0.01)), 4326), (6, "bad", "q", polygon(square(31, -18, 1e-8)), 4326), (7, "bad", "r", polygon(square(31, -18, 0.01)), 4326), (8, "declared", "b", polygon([(31.012, -18), (31.013, -17.999), (31.013, -18), (31.012, -17.999), (31.012, -18)]), 4326)]
    stored = [(50, "declared", "a", multi(square(31.001, -17.999, 0.005)), False), (51, "alone", None, multi(square(32, -18, 0.02)), True), (52, "union", "c", multi(square(31, -18, 0.02)), False)]
    got = intake.ingest(spark.createDataFrame(farms, "farm_id string, boundary string, epsg int, own_id bigint"), spark.createDataFrame(fields, "id bigint, farm_id string, canonical_id string, boundary string, epsg int"), spark.createDataFrame(stored, f"field_id bigint, farm_id string, canonical_id string, geometry {overlay.MULTI}, derived boolean")).collect()
    assert {(r.farm_id, r.id, r.field_id, r.action, r.repaired) for r in got if r.reason is None} == {("declared", 1, 50, "unchanged", False), ("declared", 2, None, "created", False), ("declared", 8, None, "created", True), ("union", 3, 52, "updated_geometry", False), ("alone", 105, 51, "unchanged", False)}
    assert {r.farm_id: r.reason for r in got if r.reason} == {
        "loose": "field '<unnamed>' is not nested within the farm boundary (50.0% of its area lies outside the tolerance)",
        "bad": "field (q): geometry area below 1.0 m² (degenerate)",
        "none": "farm has neither a boundary nor any fields - nothing to analyse",
        "point": "farm boundary: geometry must be polygonal, got 'Point'",
    }


def test_drawn_regions(spark):
    zones = spark.createDataFrame([("I", multi(square(31, -18, 0.01))), ("II", multi(square(31.01, -18, 0.01)))], f"zone string, geometry {overlay.MULTI}")
    farms = spark.createDataFrame([(1, 31.005, -17.995), (2, 31.012, -17.995), (3, 35.0, -17.0)], "id int, lon double, lat double")
    drawn = spark.createDataFrame([(1, "both", polygon(square(31.006, -18, 0.008))), (2, "far", polygon(square(40, -18, 0.01))), (3, "empty", '{"type": "Polygon", "coordinates": []}')], "region_id int, name string, boundary string")
    got = {r.region_id: (r.reason, r.composition, r.dominant, r.captured) for r in intake.drawn_regions(drawn, zones, farms).collect()}
    assert got == {1: (None, "I=0.5000,II=0.5000", "I", 1), 2: (None, None, None, 0), 3: ("geometry is empty", None, None, None)}
