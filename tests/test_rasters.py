"""Raster operators against pixel-by-pixel versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdure.functions import columns as X
from verdure.operators import geo, lineage, overlay, pixels, planar, rasters, zones

RNG = np.random.default_rng(3)


def star(cx, cy, r):
    n = int(RNG.integers(6, 20))
    t, size = (np.arange(n) + RNG.uniform(0, 0.8, n)) * 2 * np.pi / n, RNG.uniform(0.4, 1, n) * r
    return np.stack([cx + size * np.cos(t), cy + size * np.sin(t)], 1)


def multi(*polygons):
    return [[[(float(x), float(y)) for x, y in r] for r in p] for p in polygons]


def grids(spark, n, height=40, width=50):
    return spark.createDataFrame([(i, 300_000.0 + 700 * i, 8_030_000.0, 10.0, 32736, height, width) for i in range(n)], "k int, x0 double, y0 double, res double, epsg int, height int, width int")


def test_spans_equal_pixel_centres(spark):
    shapes, want = [], {}
    for k in range(6):
        lon, lat = planar.from_utm(np.array([300_250.0 + 700 * k]), np.array([8_029_800.0]), 32736)
        c = float(lon[0]), float(lat[0])
        shell = star(*c, 0.004)
        shape = [[shell, (shell[::-1] - c) * 0.4 + c], [star(c[0] + 0.006, c[1], 0.001)]]
        shapes.append((k, multi(*shape)))
        e = [planar.edges([[np.column_stack(planar.to_utm(r[:, 0], r[:, 1], 32736)) for r in p]]) for p in shape]
        rows, cols = np.mgrid[0:40, 0:50]
        x, y = 300_000 + 700 * k + (cols + 0.5) * 10, 8_030_000 - (rows + 0.5) * 10
        n = np.zeros(x.shape, int)
        for x0, y0, x1, y1 in np.concatenate(e):
            n += ((y0 > y) != (y1 > y)) & (x0 + (y - y0) * (x1 - x0) / ((y1 - y0) or 1) > x)
        want |= {(k, r, c): bool(n[r, c] % 2) for r in range(40) for c in range(50)}
    df = spark.createDataFrame([*shapes, (99, None)], f"k int, geometry {overlay.MULTI}").join(grids(spark, 6), "k", "left")
    px = spark.createDataFrame(list(want), "k int, px_row int, px_col int")
    got = {(r.k, r.px_row, r.px_col): r.inside for r in rasters.inside(px, df, ["k"]).collect()}
    assert got == want and 200 < sum(got.values()) < 11_000


def test_from_utm_inverts(spark):
    df = spark.createDataFrame([(31.3, -17.2), (28.2, -20.5)], "lon double, lat double")
    e, n = geo.to_utm(F.col("lon"), F.col("lat"), F.lit(32736))
    back = geo.from_utm(F.col("e"), F.col("n"), F.lit(32736))
    for r in df.select("*", e.alias("e"), n.alias("n")).select("*", *(c.alias(k) for c, k in zip(back, ("x", "y"), strict=True))).collect():
        assert (r.x, r.y) == pytest.approx((r.lon, r.lat), abs=1e-9)


def test_grid_size(spark):
    size = lambda w, s, e, n: spark.range(1).select(*rasters.grid_size(*map(F.lit, (w, s, e, n)), F.lit(10.0))).first()
    assert tuple(size(31.0, -18.0, 31.01, -17.99)) == (111, 106) and tuple(size(31.0, -18.0, 33.0, -16.0)) == (2500, 2500) and tuple(size(31.0, -18.0, 31.0, -18.0)) == (1, 1)


def areas_of(label):
    """Connected areas of equal cells, by flood."""
    seen, out = set(), []
    for start in label:
        if start in seen:
            continue
        todo, own = [start], {start}
        while todo:
            r, c = todo.pop()
            for p in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if p not in own and label.get(p) == label[start]:
                    own.add(p)
                    todo.append(p)
        seen |= own
        out.append((label[start], frozenset(own)))
    return out


@pytest.mark.parametrize("band", [64, 3])
def test_zone_polygons(spark, monkeypatch, band):
    monkeypatch.setattr(zones, "BAND_ROWS", band)
    rows, want = [], set()
    for k in range(4):
        label = {(r, c): int(z) for (r, c), z in np.ndenumerate(RNG.integers(0, 2 + k, (20, 23))) if RNG.random() < 0.9}
        rows += [(k, r, c, z) for (r, c), z in label.items()] + [(k, 30, 30, None)]
        want |= {(k, *a) for a in areas_of(label)}
    got = set()
    for r in zones.zone_polygons(spark.createDataFrame(rows, "k int, px_row int, px_col int, zone int"), ["k"]).collect():
        g = [[np.array(q)[:-1] for q in p] for p in r.geometry]
        assert planar.area(g) == r.pixels
        cells = frozenset((i, j) for i in range(20) for j in range(23) if planar.covers_point([q for p in g for q in p], j + 0.5, -i - 0.5))
        got.add((r.k, r.zone, cells))
    assert got == want


def test_components(spark):
    edges = [(f"{i:03}", f"{i + 1:03}") for i in range(50)] + [("b", "a"), ("c", "b"), ("x", "x"), ("b", "a")]
    got = {r.id: r.comp for r in lineage.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"{i:03}": "000" for i in range(51)} | dict.fromkeys("abc", "a")
    assert lineage.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_tiles_look_up_the_raster(spark):
    px = spark.createDataFrame([(0, r, c, float(r * 50 + c)) for r in range(40) for c in range(50)], "k int, px_row int, px_col int, value double")
    got = rasters.tiles(px, grids(spark, 1), ["k"], [15, 12]).collect()
    want = {}
    for z, factor in ((15, 1), (12, 2)):
        n = 256 * 2**z
        lon, lat = planar.from_utm(np.array([300_000.0, 300_500.0]), np.array([8_030_000.0, 8_029_600.0]), 32736)
        xs = [int((v + 180) / 360 * n) for v in lon]
        ys = [int((1 - np.arcsinh(np.tan(np.radians(v))) / np.pi) / 2 * n) for v in lat]
        for gx in range(xs[0] - 3, xs[1] + 4):
            for gy in range(ys[0] - 3, ys[1] + 4):
                e, north = planar.to_utm(np.float64((gx + 0.5) / n * 360 - 180), np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * (gy + 0.5) / n)))), 32736)
                r, c = int((8_030_000 - north) // 10), int((e - 300_000) // 10)
                if 0 <= r < 40 and 0 <= c < 50:
                    r, c = r // factor, c // factor
                    want[z, gx // 256, gy // 256, gy % 256, gx % 256] = float(np.mean([(i * 50 + j) for i in range(r * factor, r * factor + factor) for j in range(c * factor, c * factor + factor)]))
    assert {(r.z, r.x, r.y, r.row, r.col): r.value for r in got} == pytest.approx(want) and len(got) == len(want)


def test_colours(spark):
    df = spark.createDataFrame([(-0.2,), (0.9,), (None,), (5.0,), (-0.2 + 1.1 * 0.5 / 9,)], "value double")
    got = [tuple(r.rgba) for r in rasters.painted(df, "NDVI").collect()]
    assert got == [(165, 0, 38, 255), (0, 104, 55, 255), (0, 0, 0, 0), (0, 104, 55, 255), (190, 24, 39, 255)]
    assert X.display_range("ndvi", True) == (-0.9, 0.9) and X.display_range("ndmi", True) == (-0.5, 0.5)
    assert rasters.painted(df.limit(1).select(F.lit(0.0).alias("value")), "ndvi", True).first().rgba == [255, 255, 191, 255]
    bands = {b: F.lit(v) for b, v in (("B04", 0.3), ("B03", 0.15), ("B02", -1.0))}
    rows = rasters.pictured(df.limit(1), "rgb", bands, F.lit(True)).select("rgba").first().rgba
    assert rows == [255, 128, 0, 255] and rasters.pictured(df.limit(1), "rgb", bands, F.lit(False)).first().rgba == [0, 0, 0, 0]
    with pytest.raises(ValueError, match="fcc needs B08"):
        X.composite("fcc", bands)


def test_native_resolutions(spark):
    assert rasters.by_resolution() == {10: ["ndvi", "evi2", "savi"], 20: ["ndre", "ndmi"]}
    assert rasters.band_union(["ndmi", "ndvi"]) == ["B04", "B08", "B11"] and rasters.band_union(["ndvi"], True) == ["B02", "B03", "B04", "B08"]
    fine = spark.createDataFrame([("f", r, c, True, 3000 + 100 * r, 1500 + 100 * c) for r in range(4) for c in range(4)], "k string, px_row int, px_col int, inside boolean, b08 int, b04 int")
    coarse = spark.createDataFrame([("f", r, c, True, 4 if r == 0 else 9, 2500, 2000) for r in range(2) for c in range(2)], "k string, px_row int, px_col int, inside boolean, scl int, b05 int, b11 int")
    got = {r.index_name: r for r in rasters.analyse_native(fine, coarse, ["k"], F.lit(-1000.0), F.lit(10000.0)).collect()}
    assert {n: (r.resolution_m, r["count"], r.clear_fraction) for n, r in got.items()} == {"ndvi": (10, 8, 0.5), "evi2": (10, 8, 0.5), "savi": (10, 8, 0.5), "ndre": (20, 2, 0.5), "ndmi": (20, 2, 0.5)}
    ndvi = [((0.2 + 0.01 * r) - (0.05 + 0.01 * c)) / (0.25 + 0.01 * r + 0.01 * c) for r in range(2) for c in range(4)]
    assert got["ndvi"].mean == pytest.approx(np.mean(ndvi)) and got["ndre"].mean == pytest.approx((0.205 - 0.15) / (0.205 + 0.15))


def test_preview(spark):
    px = spark.createDataFrame([(0, r, c, float(r)) for r in range(40) for c in range(50)], "k int, px_row int, px_col int, value double")
    got = rasters.preview(px, grids(spark, 1), ["k"], longest=20).collect()
    assert len(got) == 14 * 17 and {r.value for r in got if r.row == 0} == {1.0} and {r.value for r in got if r.row == 13} == {39.0}
    assert rasters.preview(px, grids(spark, 1), ["k"]).count() == 2000


def test_one_aggregate_gives_what_two_did(spark):
    rows = spark.createDataFrame([("f", i % 9, i % 3 > 0, 1000 + i * 37 % 3000, 1000 + i * 17 % 900, 1200, 1300 + i) for i in range(200)] + [("g", 9, True, 2000, 1500, 1200, 1300), ("h", 4, False, 2000, 1500, 1200, 1300)], "k string, scl int, inside boolean, b08 int, b04 int, b05 int, b11 int")
    bands = {b: F.col(b.lower()) for b in ("B08", "B04", "B05", "B11")}
    got = {(r.k, r.index_name): r for r in pixels.analyse(rows, ["k"], bands, F.lit(-1000.0), F.lit(10000.0), F.col("scl"), F.col("inside")).collect()}
    v = X.index_value("ndvi", {b: X.reflectance(c.cast("double"), F.lit(-1000.0), F.lit(10000.0)) for b, c in bands.items()})
    want = {r.k: r for r in pixels.zonal_stats(rows.withColumn("value", v), ["k"], include=F.col("inside") & X.clear(F.col("scl"))).collect()}
    for k, r in want.items():
        assert [got[k, "ndvi"][c] for c in ("count", "mean", "min", "max", "std", "p5", "p10", "p90", "p95")] == pytest.approx([r[c] for c in ("count", "mean", "min", "max", "std", "p5", "p10", "p90", "p95")])
    assert (got["g", "ndvi"].clear_fraction, got["h", "ndvi"].clear_fraction) == (0.0, 0.0)
    free = pixels.analyse(rows, ["k"], bands, F.lit(-1000.0), F.lit(10000.0), None, F.col("inside"), override=F.lit(0.25)).where("k = 'f'").first()
    assert free.clear_fraction == 0.25
