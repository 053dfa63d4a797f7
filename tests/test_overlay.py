"""Polygon overlay, repair, unions and matching: against dense sampling, published values and small cases by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdure.operators import geo, overlay, planar

RNG = np.random.default_rng(7)
RULES = {"and": lambda s: s[0] & s[1], "or": lambda s: s.any(axis=0), "sub": lambda s: s[0] & ~s[1], "xor": lambda s: s[0] ^ s[1]}


def star(cx, cy, r):
    n = int(RNG.integers(6, 25))
    t, size = (np.arange(n) + RNG.uniform(0, 0.8, n)) * 2 * np.pi / n, RNG.uniform(0.4, 1, n) * r
    return np.stack([cx + size * np.cos(t), cy + size * np.sin(t)], 1)


def inside(g, x, y):
    n = np.zeros(len(x), int)
    for x0, y0, x1, y1 in planar.edges(g):
        with np.errstate(all="ignore"):
            n += ((y0 > y) != (y1 > y)) & (x0 + (y - y0) * (x1 - x0) / (y1 - y0) > x)
    return n % 2 == 1


def square(x, y, s):
    return [np.array([[x, y], [x + s, y], [x + s, y + s], [x, y + s]], float)]


def pairs():
    for i in range(60):
        a, b = [[star(0, 0, 1)]], [[star(*RNG.uniform(-1, 1, 2), 1)]]
        if i % 3 == 0:
            a[0].append(a[0][0][::-1] * 0.3)
            b.append([star(4, 0, 0.8)])
        if i % 5 == 0:
            b = [[a[0][0].copy()]]
        yield a, b
    yield [square(0, 0, 1)], [square(1, 0, 1)]
    yield [square(0, 0, 1)], [square(0.25, 0, 0.5)]
    yield [square(0, 0, 1)], []


def test_overlay_against_sampling():
    x, y = RNG.uniform(-2, 5, 4000), RNG.uniform(-2, 2, 4000)
    for a, b in pairs():
        areas = planar.area_where([a, b], *RULES.values())
        assert areas[0] + areas[2] == pytest.approx(planar.area(a), abs=1e-9)
        assert areas[0] + areas[1] == pytest.approx(planar.area(a) + planar.area(b), abs=1e-9)
        truth = [inside(a, x, y), inside(b, x, y)]
        for (name, rule), m2 in zip(RULES.items(), areas, strict=True):
            g = planar.shape_where([a, b], rule)
            assert planar.area(g) == pytest.approx(m2, abs=1e-9), name
            assert (inside(g, x, y) != rule(np.array(truth))).sum() <= 1
            assert all(planar.signed_area(r) * (-1 if i else 1) > 0 for p in g for i, r in enumerate(p))


def test_union_has_holes_and_no_seams():
    ring = planar.shape_where([[square(i, j, 1)] for i in range(3) for j in range(3) if (i, j) != (1, 1)], RULES["or"])
    assert [[len(r) for r in p] for p in ring] == [[4, 4]] and planar.area(ring) == 8
    assert [len(p) for p in planar.shape_where([[square(0, 0, 1)], [square(1, 1, 1)]], RULES["or"])] == [1, 1]


@pytest.mark.parametrize(
    ("g", "why"),
    [
        ([square(0, 0, 1)], None),
        ([[np.array([[0, 0], [1, 1], [1, 0], [0, 1.0]])]], "Self-intersection"),
        ([[np.array([[0, 0], [2, 0], [2, 2], [3, 2], [2, 2], [0, 2.0]])]], "Self-intersection"),
        ([[np.array([[0, 0], [3, 0], [1, 1], [2, 3], [0, 2], [1, 1.0]])]], "Ring Self-intersection"),
        ([square(0, 0, 3) + square(1, 1, 1)], None),
        ([square(0, 0, 3) + square(5, 1, 1)], "Hole lies outside shell"),
        ([square(0, 0, 3), square(1, 1, 1)], "Nested shells"),
        ([square(0, 0, 3), square(3, 3, 1)], None),
        ([square(0, 0, 3), square(3, 0, 3)], "Self-intersection"),
    ],
)
def test_flaws(g, why):
    assert planar.flaw(g) == why


def multi(*polygons):
    return [[[(float(x), float(y)) for x, y in [*r, r[0]]] for r in p] for p in polygons]


def frame(spark, rows, names):
    return spark.createDataFrame(rows, names)


def test_validation(spark):
    at = lambda s, d: f'{{"type": "Polygon", "coordinates": [[[{30 + d}, -18], [{30 + d + s}, -18], [{30 + d + s}, {-18 + s}], [{30 + d}, {-18 + s}], [{30 + d}, -18]]]}}'
    cases = {
        "good": (at(0.01, 0), 4326),
        "tiny": (at(1e-7, 0), 4326),
        "bow": ('{"type": "Polygon", "coordinates": [[[30, -18], [30.01, -17.99], [30.01, -18], [30, -17.99], [30, -18]]]}', 4326),
        "point": ('{"type": "Point", "coordinates": [30, -18]}', 4326),
        "empty": ('{"type": "Polygon", "coordinates": []}', 4326),
        "short": ('{"type": "Polygon", "coordinates": [[[30, -18], [31, -18], [30, -18]]]}', 4326),
        "broken": ('{"type": "Polygon", "coordinates": "no"}', 4326),
        "utm": ('{"type": "MultiPolygon", "coordinates": [[[[300000, 8030000], [300500, 8030000], [300500, 8030500], [300000, 8030500], [300000, 8030000]]]]}', 32736),
        "null": (None, 4326),
    }
    df = frame(spark, [(k, *v) for k, v in cases.items()], "name string, json string, epsg int")
    kind, g = overlay.from_geojson(F.col("json"))
    got = {r.name: r.v for r in df.select("name", overlay.validated(kind, g, F.col("epsg")).alias("v")).collect()}
    assert {k for k, v in got.items() if v.ok} == {"good", "bow", "utm"}
    assert [got[k].reason for k in ("tiny", "point", "empty", "short", "broken", "null")] == ["geometry area below 1.0 m² (degenerate)", "geometry must be polygonal, got 'Point'", "geometry is empty", "unparseable geometry", "unparseable geometry", "geometry must be polygonal, got None"]
    assert got["bow"].repaired and "Self-intersection" in got["bow"].warning and not got["good"].repaired
    assert got["bow"].area_m2 == pytest.approx(got["good"].area_m2 / 2, rel=1e-4)
    xy = [p for poly in got["utm"].geometry for r in poly for p in r]
    assert all(28 < p.x < 34 and -20 < p.y < -16 for p in xy)
    # 250,000 m2 of the grid
    assert got["utm"].area_m2 == pytest.approx(250_000, rel=1e-9)
    back = df.where("name = 'good'").select(overlay.to_geojson(g).alias("j")).select(overlay.from_geojson(F.col("j"))[1].alias("g")).first().g
    assert [tuple(p) for p in back[0][0]] == [tuple(p) for p in got["good"].geometry[0][0]]


def test_utm_goes_both_ways():
    lon, lat = np.linspace(26, 34, 50), np.linspace(-22, -15, 50)
    for zone in (32735, 32736):
        assert np.allclose(planar.from_utm(*planar.to_utm(lon, lat, zone), zone), (lon, lat), atol=1e-9)


def test_columns_agree_with_geo(spark):
    df = frame(spark, [(31.2, -17.8), (28.1, -19.0)], "lon double, lat double")
    for zone in (32735, 32736):
        for r in df.select("*", *(c.alias(n) for c, n in zip(geo.to_utm(F.col("lon"), F.col("lat"), F.lit(zone)), "en", strict=True))).collect():
            assert planar.to_utm(np.float64(r.lon), np.float64(r.lat), zone) == pytest.approx((r.e, r.n), abs=1e-6)


def test_union_by(spark):
    rows = [(None if i % 7 == 0 else f"k{i % 3}", multi(square(30 + 0.01 * (i // 3 % 6), -18 + 0.01 * (i // 18), 0.01))) for i in range(90)]
    rows += [("k0", None), ("none", None), ("none", []), ("k1", rows[1][1])]
    got = {r.k: r for r in overlay.union_by(frame(spark, rows, f"k string, geometry {overlay.MULTI}"), ["k"], branch=3).collect()}
    assert got["none"].geometry is None and got["none"].n_geometries == 0
    for k in (None, "k0", "k1", "k2"):
        own = {tuple(map(tuple, g[0][0])) for key, g in rows if key == k and g}
        total = sum(planar.area([[np.array(p[:-1])]]) for p in own)
        assert planar.area([[np.array(r)[:-1] for r in p] for p in got[k].geometry]) == pytest.approx(total, rel=1e-9)
        assert got[k].n_geometries == sum(1 for key, g in rows if key == k and g)


def test_nesting_equivalence_boundaries(spark):
    farm = multi(square(31, -18, 0.02))
    holed = multi([square(31, -18, 0.02)[0], square(31.005, -17.995, 0.005)[0]])
    rows = [(1, "f", multi(square(31.002, -17.998, 0.002))), (2, "f", multi(square(31.1, -18, 0.005))), (3, "f", None), (4, "h", multi(square(31.005, -17.995, 0.005))), (5, "h", multi(square(31.0025, -17.995, 0.005))), (6, "x", multi(square(31, -18, 0.01))), (7, "d", multi(square(31, -18, 0.01)))]
    fields = frame(spark, rows, f"id int, farm_id string, geometry {overlay.MULTI}")
    farms = frame(spark, [("f", farm), ("h", holed), ("d", None), ("bare", None)], f"farm_id string, boundary {overlay.MULTI}")
    bounds = overlay.farm_boundaries(farms, fields)
    assert {r.farm_id: (r.boundary is not None, r.derived) for r in bounds.collect()} == {"f": (True, False), "h": (True, False), "d": (True, True), "bare": (False, False)}
    got = {r.id: (r.outside if r.outside is None else round(r.outside, 4), r.nested) for r in overlay.nesting(fields, bounds).collect()}
    assert got == {1: (0.0, True), 2: (1.0, False), 3: (1.0, False), 4: (1.0, False), 5: (0.5, False), 6: (None, None), 7: (0.0, True)}
    a = multi(square(31, -18, 0.01))
    cases = [(a, multi(square(31 + 1e-7, -18, 0.01)), True), (a, multi(square(31, -18, 0.015)), False), (None, [], True), (a, None, False)]
    df = frame(spark, cases, f"a {overlay.MULTI}, b {overlay.MULTI}, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", overlay.equivalent(F.col("a"), F.col("b"))).collect())


def test_composition_adds_parts_of_a_name(spark):
    b = frame(spark, [(1, multi(square(31, -18, 0.1))), (2, multi(square(35, -18, 0.1))), (3, None), (4, multi(square(31, -18, 0.1), square(33, -18, 0.1)))], f"id int, geometry {overlay.MULTI}")
    strip = lambda x, w: multi([[(x, -18.02), (x + w, -18.02), (x + w, -17.88), (x, -17.88)]])
    zones = frame(spark, [("A", strip(31, 0.03)), ("B", strip(31.03, 0.03)), ("A", strip(31.06, 0.0395)), ("C", strip(31.0995, 0.0005)), ("D", multi(square(-40, -40, 60)))], f"zone string, geometry {overlay.MULTI}")
    got = {(r.id, r.zone): (r.share, r.dominant) for r in overlay.composition(b, zones).collect()}
    want = {(1, "A"): (0.695, True), (1, "B"): (0.3, False), (4, "A"): (0.3475, True), (4, "B"): (0.15, False)}
    assert got.keys() == want.keys(), got
    assert all(got[k][1] == v and got[k][0] == pytest.approx(s, abs=6e-4) for k, (s, v) in want.items())
    sliver = overlay.composition(b.where("id = 1"), zones.where("zone = 'C'")).collect()
    assert [(r.zone, r.share, r.dominant) for r in sliver] == [("C", pytest.approx(0.005, abs=2e-4), True)]
    big = multi(square(-40, -40, 60.5))
    far = overlay.composition(frame(spark, [(1, big)], f"id int, geometry {overlay.MULTI}"), zones).collect()
    assert [r.zone for r in far] == ["D"]


def test_assign(spark):
    regions = frame(spark, [("b", multi(square(31, -18, 1))), ("a", multi(square(30, -18, 1)))], f"region_id string, geometry {overlay.MULTI}")
    points = frame(spark, [(1, 31.0, -17.5), (2, 30.5, -17.5), (3, 31.002, -17.5), (4, 31.003, -17.5), (5, 40.0, 0.0), (6, None, 0.0)], "id int, lon double, lat double")
    got = {r.id: (r.region_id, r.boundary_adjacent) for r in overlay.assign(points, regions).collect()}
    # 0.002 degrees are 212 m there, 0.003 are 318 m
    assert got == {1: ("a", True), 2: ("a", False), 3: ("b", True), 4: ("b", False), 5: (None, None), 6: (None, None)}


def test_matching_is_one_to_one(spark):
    here, there = multi(square(31, -18, 0.01)), multi(square(31.2, -18, 0.01))
    shape = f"farm_id string, canonical_id string, geometry {overlay.MULTI}, derived boolean"
    new = [(1, "f", None, here, False), (2, "f", None, here, False), (3, "f", None, here, None), (4, "f", "x", there, False), (5, "f", "x", there, False), (6, "f", "unknown", here, False), (7, "g", None, here, True), (8, "h", None, here, True), (9, "f", "y", there, False)]
    old = [(10, "f", None, here, False), (11, "f", None, multi(square(31 + 1e-7, -18, 0.01)), False), (12, "f", "x", here, False), (13, "g", None, there, True), (14, "f", "y", there, False), (15, "e", None, here, False)]
    got = {r.id: (r.field_id, r.action) for r in overlay.match_fields(frame(spark, new, f"id int, {shape}"), frame(spark, old, f"field_id int, {shape}")).collect()}
    assert got == {1: (10, "unchanged"), 2: (11, "unchanged"), 3: (None, "created"), 4: (12, "updated_geometry"), 5: (None, "created"), 6: (None, "created"), 7: (13, "updated_geometry"), 8: (None, "derived_from_farm"), 9: (14, "unchanged")}
