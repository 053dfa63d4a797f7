"""Hand-computed results of the domain operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from verdure.functions import columns as X
from verdure.operators import geo, pixels, records, series, store, zones
from verdure.sources import catalogue


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


@pytest.mark.parametrize(
    ("dn", "expected"),
    [
        ((5000, 2000, 3000, 4000), {"ndvi": 0.6, "evi2": 0.75 / 1.64, "savi": 0.45, "ndre": 0.2 / 0.6, "ndmi": 0.1 / 0.7}),
        ((3000, 2500, 2800, 3200), {"ndvi": 0.05 / 0.35, "evi2": 0.125 / 1.56, "savi": 0.075 / 0.85, "ndre": 0.02 / 0.38, "ndmi": -0.02 / 0.42}),
    ],
)
def test_validation_matrix(spark, dn, expected):
    rows = spark.createDataFrame([("f", *map(float, dn), 4, True)] * 4 + [("g", 0.0, 0.0, 0.0, 0.0, 4, True)], "field string, b08 double, b04 double, b05 double, b11 double, scl int, inside boolean")
    got = pixels.analyse(rows, ["field"], {b: F.col(b.lower()) for b in ("B08", "B04", "B05", "B11")}, F.lit(-1000.0), F.lit(10000.0), F.col("scl"), F.col("inside")).collect()
    for r in got:
        if r.field == "f":
            assert r.mean == pytest.approx(expected[r.index_name], abs=1e-6) and r["count"] == 4 and r.clear_fraction == 1.0 and r.confidence == "high"
        else:
            assert r["count"] == 0 and r.mean is None and r.p95 is None


def test_zonal_statistics(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 5)] + [("b", None)], "k string, value double")
    got = {r.k: r for r in pixels.zonal_stats(rows, ["k"]).collect()}
    a = got["a"]
    assert (a["count"], a["mean"], a["min"], a["max"]) == (5, 3, 1, 5) and a["std"] == pytest.approx(2**0.5) and a["p10"] == pytest.approx(1.4) and a["p90"] == pytest.approx(4.6)
    assert got["b"]["count"] == 0 and got["b"]["mean"] is None
    with pytest.raises(ValueError, match="20 m index"):
        pixels.check_resolution("ndre", 10)


def test_classification(spark):
    c = lambda i, v, crop=None: X.classify(F.lit(i), F.lit(v), F.lit(crop).cast("string"))
    got = one(spark, a=c("ndvi", 0.1), b=c("ndvi", 0.5), c=c("ndvi", 0.85), d=c("ndre", 0.05), e=c("ndmi", -0.1), f=c("ndvi", 0.58, "Maize"), g=c("ndvi", 0.58), h=c("ndvi", 0.2), i=X.clamp01(F.lit(None).cast("double")))
    assert tuple(got) == ("bare", "developing", "dense", "low", "dry", "vigorous", "developing", "bare", None)


def test_as_of_and_snap(spark):
    passes = spark.createDataFrame([(1, dt.date(2025, 1, 15), 0.9), (1, dt.date(2025, 1, 25), 0.2), (1, dt.date(2025, 2, 4), 0.8)], "field_id int, pass_date date, clear_fraction double")
    asked = spark.createDataFrame([(1, dt.date(2025, 1, 26)), (1, dt.date(2025, 1, 15)), (1, dt.date(2024, 12, 1))], "field_id int, day date")
    got = {r.day: (r.before, r.before_gap, r.after, r.resolved) for r in series.as_of(asked, passes).collect()}
    d15, d4 = dt.date(2025, 1, 15), dt.date(2025, 2, 4)
    assert got == {dt.date(2025, 1, 26): (d15, -11, d4, d4), d15: (d15, 0, d4, d15), dt.date(2024, 12, 1): (None, None, d15, d15)}
    assert {r.resolved for r in series.as_of(asked, passes, 0.99).collect()} == {None}
    scenes = spark.createDataFrame([(dt.date(2025, 3, d), f"s{d}") for d in (1, 8, 20)], "scene_date date, scene_id string")
    asked = spark.createDataFrame([(dt.date(2025, 3, 5),), (dt.date(2025, 3, 30),), (dt.date(2025, 3, 14),)], "day date")
    assert {r.day.day: (r.scene_id, r.gap) for r in series.snap(asked, scenes).collect()} == {5: ("s8", 3), 14: ("s8", -6)}


@pytest.mark.parametrize(
    ("index", "values", "expected"),
    [
        ("ndvi", (0.70, 0.52), {("ndvi_drop_vs_prior", "warning")}),
        ("ndvi", (0.80, 0.40), {("ndvi_drop_vs_prior", "critical")}),
        ("ndvi", (0.70, 0.62), set()),
        ("ndvi", (0.70, 0.72, 0.69, 0.71, 0.50), {("ndvi_drop_vs_prior", "warning"), ("ndvi_below_baseline", "warning")}),
        ("ndmi", (-0.05,), {("ndmi_water_stress", "warning")}),
        ("ndmi", (0.25,), set()),
        ("ndre", (0.40, 0.42, 0.38, 0.40, 0.40, 0.10), {("anomaly", "warning")}),
        ("ndre", (0.4, 0.4, 0.4), set()),
        ("ndre", (0.40, 0.42, 0.38, 0.40, 0.10), {("anomaly", "warning")}),
        ("ndvi", (0.40, 0.42, 0.38, 0.40, 0.41, 0.60), set()),
        ("ndvi", (0.90, 0.80, 0.50), {("ndvi_drop_vs_prior", "critical"), ("ndvi_below_baseline", "warning")}),
    ],
)
def test_alerts(spark, index, values, expected):
    rows = spark.createDataFrame([(1, index, day(5 * i), v, 0.9) for i, v in enumerate(values)], "field_id int, index_name string, pass_date date, mean double, clear_fraction double")
    assert {(r.code, r.level) for r in series.alerts(rows).collect()} == expected


def test_phenology(spark):
    rows = [(1, day(7 * i), v) for i, v in enumerate((0.20, 0.35, 0.55, 0.80, 0.55, 0.35, 0.20))] + [(2, day(7 * i), v) for i, v in enumerate((0.2, 0.4, 0.6, 0.8))] + [(3, day(0), 0.3), (3, day(7), 0.6)]
    got = {r.field_id: r for r in series.phenology(spark.createDataFrame(rows, "field_id int, pass_date date, mean double")).collect()}
    assert (got[1].peak_date, got[1].start_date, got[1].end_date, got[1].season_days, got[1].amplitude) == (day(21), day(14), day(35), 21, 0.6)
    assert got[2].start_date and got[2].end_date is None and 3 not in got
    assert got[1].integral == pytest.approx(7 * sum(v - 0.2 for v in (0.35, 0.55, 0.80, 0.55, 0.35)))


def test_water_deficit(spark):
    rows = spark.createDataFrame([(1, 10.0, 40.0), (2, 30.0, 40.0), (3, 0.0, 0.0)], "field_id int, precip_mm double, et0_mm double")
    assert [(r.field_id, r.code, r.level) for r in series.water_deficit(rows).collect()] == [(1, "water_deficit", "warning")]


def test_correlation(spark):
    passes = spark.createDataFrame([(1, day(10 * i), v) for i, v in enumerate((0.30, 0.32, 0.45, 0.55, 0.60))], "field_id int, pass_date date, mean double")
    acts = spark.createDataFrame([(1, day(12), "fertiliser"), (1, day(-5), "early")], "field_id int, day date, activity string")
    got = {r.activity: r for r in series.correlate(acts, passes).collect()}
    f = got["fertiliser"]
    assert (f.baseline, f.passes, f.baseline_date) == (0.32, 3, day(10)) and f.response == pytest.approx(1.6 / 3)
    assert got["early"].baseline is None and got["early"].delta is None


def test_agro(spark):
    g = lambda a, b, **k: X.growing_degree_days(F.lit(float(a)), F.lit(float(b)), **k)
    r = lambda lat, d: X.extraterrestrial_radiation(F.lit(float(lat)), F.lit(d))
    e = lambda a, b: X.evapotranspiration(F.lit(float(a)), F.lit(float(b)), F.lit(-18.0), F.lit(15))
    got = one(spark, a=g(10, 20), b=g(5, 8), c=g(20, 40), d=g(20, 40, upper=30), e=r(0, 80), f=r(-18, 15), g=r(-18, 196), h=e(20, 20), i=e(16, 30))
    assert tuple(got)[:4] == (5, 0, 20, 15) and 36 < got.e < 39 and got.f > got.g and got.h == 0 and 2 < got.i < 12


def test_geometry(spark):
    square = lambda x0, x1: F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((x0, -18.0), (x1, -18.0), (x1, -16.0), (x0, -16.0))))
    got = one(spark, a=geo.area(square(29.0, 31.0)), z=X.utm_zone(F.lit(29.999)), e=X.epsg(F.lit("epsg:32736")), f=X.epsg(F.lit("none")))
    assert tuple(got) == (4.0, 32735, 32736, None)
    east, north = geo.to_utm(F.lit(33.0), F.lit(0.0), F.lit(32736))
    got = one(spark, e=east, n=north)
    assert got.e == pytest.approx(500_000, abs=1e-6) and got.n == pytest.approx(10_000_000, abs=1e-6)


def test_zones():
    label, centres = zones.kmeans(__import__("numpy").array([0.2] * 4 + [0.8] * 4), 2)
    assert label.tolist() == [0] * 4 + [1] * 4 and centres.tolist() == pytest.approx([0.2, 0.8])


def test_upsert_and_sources(spark):
    old = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "a")], "k int, v double, made string")
    new = spark.createDataFrame([(2, None, "b"), (3, 3.0, "b")], "k int, v double, made string")
    assert sorted(map(tuple, store.upsert(old, new, ["k"], ["made"]).collect())) == [(1, 1.0, "a", False), (2, None, "a", False), (3, 3.0, "b", True)]
    xml = "<a:P xmlns:a='x'><BOA_QUANTIFICATION_VALUE>10000</BOA_QUANTIFICATION_VALUE><BOA_ADD_OFFSET band_id='3'>-1000</BOA_ADD_OFFSET></a:P>"
    got = catalogue.product_metadata(spark.createDataFrame([("s", xml)], "scene_id string, xml string")).first()
    assert got.quantification == 10000 and got.offsets == {"3": -1000.0} and got.baseline is None
    body = '{"latitude":1,"longitude":2,"daily":{"time":["2024-01-01"],"temperature_2m_min":[null],"temperature_2m_max":[20],"temperature_2m_mean":[null],"precipitation_sum":[1]}}'
    w = catalogue.daily_weather(spark.createDataFrame([(body,)], "json string")).first()
    assert (w.tmin_c, w.tmax_c, w.tmean_c, w.precip_mm) == (0.0, 20.0, None, 1.0)


def test_boundary_keys(spark):
    ring = lambda *points: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))
    a, kind = geo.boundary_key(ring((0, 0), (2, 0), (2, 1), (0, 1))), "array<struct<x:double,y:double>>"
    same = (ring((2, 1), (0, 1), (0, 0), (2, 0), (2, 1)), ring((0, 1), (2, 1), (2, 0), (0, 0)), ring((1e-8, -1e-8), (2, 0), (2, 1), (0, 1)))
    got = one(spark, other=a == geo.boundary_key(ring((0, 0), (2, 0), (2, 1.001), (0, 1))), none=geo.boundary_key(F.lit(None).cast(kind)), empty=geo.boundary_key(F.array().cast(kind)), **{f"s{i}": a == geo.boundary_key(r) for i, r in enumerate(same)})
    assert (got.other, got.none, got.empty) == (False, None, None) and got.s0 and got.s1 and got.s2
    shell, left, right = ring((0, 0), (9, 0), (9, 9), (0, 9)), ring((1, 1), (2, 1), (2, 2)), ring((5, 5), (6, 5), (6, 6), (5, 6))
    far = F.array(ring((20, 0), (29, 0), (29, 9)))
    keys = [geo.geometry_key(g) for g in (F.array(F.array(shell, left, right), far), F.array(far, F.array(F.reverse(shell), right, left)), F.array(F.array(shell, left), far), F.array().cast(f"array<array<{kind}>>"))]
    got = one(spark, same=keys[0] == keys[1], other=keys[0] == keys[2], none=keys[3])
    assert tuple(got) == (True, False, None)


def test_csv_lines(spark):
    rows = spark.createDataFrame([('a,"b', 0.5, None), (None, 2.0, 3)], "name string, v double, n int")
    assert [r.line for r in records.csv_lines(rows, ["name", "v", "n"]).collect()] == ['"a,""b",0.5,', ",2.0,3"]
