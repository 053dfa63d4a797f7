"""Named queries over rasters, with SQL: every field has a grid of 64 by 64 pixels of 10 m on a UTM zone, filled from lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.functions import columns as X
from verdure.functions.constants import MOISTURE_RAMP, VEGETATION_RAMP
from verdure.operators import overlay, rasters, zones
from verdure.plans.geometry import shape, slanted, utm
from verdure.plans.queries import _RHO, query
from verdure.plans.views import view

BY = ["field_id"]
#: Zone 36S; a field's grid starts at its own place.
_EAST, _NORTH = "300000.0 + field_id % 300 * 1000", "8030000.0 - floor(field_id / 300) % 600 * 1000"
GRIDS = f"SELECT DISTINCT field_id, {_EAST} AS x0, {_NORTH} AS y0 FROM pixel"


def grids(px: DataFrame) -> DataFrame:
    """field_id with the columns of a grid."""
    g = px.select("field_id").distinct().selectExpr("field_id", f"CAST({_EAST} AS DOUBLE) AS x0", f"CAST({_NORTH} AS DOUBLE) AS y0")
    return g.select("*", F.lit(10.0).alias("res"), F.lit(32736).alias("epsg"), F.lit(64).alias("height"), F.lit(64).alias("width"))


def _lonlat(sql: str) -> str:
    """SQL of rows (e, nn) on zone 36S with lon and lat."""
    f = 1 / 298.257223563
    n, ecc = f / (2 - f), (f * (2 - f)) ** 0.5
    a = 6378137 / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * 0.9996
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    v = " + ".join(f"{k!r}::DOUBLE * sin({2 * j} * yy) * cosh({2 * j} * xx)" for j, k in enumerate(beta, 1))
    u = " + ".join(f"{k!r}::DOUBLE * cos({2 * j} * yy) * sinh({2 * j} * xx)" for j, k in enumerate(beta, 1))
    sql = f"SELECT *, (nn - 10000000) / {a!r} AS yy, (e - 500000) / {a!r} AS xx FROM ({sql}) i0"
    sql = f"SELECT *, yy - ({v}) AS v, xx - ({u}) AS u FROM ({sql}) i1"
    sql = f"SELECT *, sin(v) / sqrt(pow(sinh(u), 2) + pow(cos(v), 2)) AS tt FROM ({sql}) i2"
    sql = f"SELECT *, tt / sqrt(1 + tt * tt) AS s0 FROM ({sql}) i3"
    for i in range(5):
        sql = f"SELECT * EXCLUDE (s{i}), tanh(asinh(tt) + {ecc!r} * atanh({ecc!r} * s{i})) AS s{i + 1} FROM ({sql}) j{i}"
    return f"SELECT * EXCLUDE (yy, xx, v, u, tt, s5), degrees(atan2(sinh(u), cos(v))) + 33 AS lon, degrees(asin(s5)) AS lat FROM ({sql}) i4"


#: The area of interest of a field: a slanted plot over its grid, with a hole, in degrees around the grid's middle.
_MIDDLE = _lonlat("SELECT field_id, x0 + 320 AS e, y0 - 320 AS nn FROM grids")
_IN = "du BETWEEN -0.002 AND 0.0022 AND dv BETWEEN -0.0023 AND 0.0021 AND NOT (du BETWEEN -0.0005 AND 0.0007 AND dv BETWEEN -0.0006 AND 0.0004)"


def _areas(px: DataFrame) -> DataFrame:
    """The grids with geometry, the areas of interest."""
    from verdure.operators.geo import from_utm

    g = grids(px)
    lon, lat = from_utm(F.col("x0") + 320, F.col("y0") - 320, F.col("epsg"))
    g = g.withColumns({"v": lat}).withColumn("u", lon - 0.3 * (F.col("v") + 18))
    box = lambda a, b, c, d: slanted(F.col("u") + a, F.col("v") + b, F.col("u") + c, F.col("v") + d)
    return g.withColumn("geometry", shape(box(-0.002, -0.0023, 0.0022, 0.0021), box(-0.0005, -0.0006, 0.0007, 0.0004))).drop("u", "v")


@query(
    f"SELECT field_id, px_row, px_col, count(*) FILTER ({_IN}) AS covered, count(*) AS n FROM placed GROUP BY 1, 2, 3",
    grids=GRIDS,
    middle=_MIDDLE,
    centres=_lonlat("SELECT p.field_id, px_row, px_col, x0 + (px_col + 0.5) * 10 AS e, y0 - (px_row + 0.5) * 10 AS nn FROM pixel p JOIN grids g ON p.field_id = g.field_id"),
    placed="SELECT c.*, c.lon - 0.3 * (c.lat + 18) - (m.lon - 0.3 * (m.lat + 18)) AS du, c.lat - m.lat AS dv FROM centres c JOIN middle m ON c.field_id = m.field_id",
)
def area_mask(spark, sf_dir):
    """How many of each pixel's readings lie in the field's area, a slanted plot with a hole, by its centre."""
    px = view(spark, sf_dir, "pixel")
    hit = rasters.inside(px.drop("inside"), _areas(px), BY)
    return hit.groupBy("field_id", "px_row", "px_col").agg(F.count_if("inside").alias("covered"), F.count("*").alias("n"))


_FINE = "SELECT field_id, px_row, px_col, bool_or(inside) AS inside, CAST(max(b08) AS INT) AS b08, CAST(min(b04) AS INT) AS b04 FROM pixel GROUP BY 1, 2, 3"
_COARSE = "SELECT field_id, CAST(floor(px_row / 2) AS INT) AS px_row, CAST(floor(px_col / 2) AS INT) AS px_col, bool_or(inside) AS inside, min(scl) AS scl, CAST(max(b05) AS INT) AS b05, CAST(min(b11) AS INT) AS b11 FROM pixel WHERE px_row < 60 GROUP BY 1, 2, 3"
_STATS = "SELECT field_id, '{name}' AS index_name, {res} AS resolution_m, count(v) FILTER (ok) AS count, round(avg(v) FILTER (ok), 6) AS mean, round(quantile_cont(v, 0.1) FILTER (ok), 6) AS p10, round(coalesce(CAST(count(*) FILTER (ok) AS DOUBLE) / nullif(count(*) FILTER (inside), 0), 0), 6) AS clear_fraction FROM (SELECT field_id, inside, inside AND coalesce(scl IN (4, 5, 6, 7), FALSE) AS ok, greatest({lo}, least({hi}, {formula})) AS v FROM {rows}) x GROUP BY 1"
_NATIVE = {"ndvi": "(n - r) / nullif(n + r, 0)", "evi2": "2.5 * (n - r) / nullif(n + 2.4 * r + 1, 0)", "savi": "1.5 * (n - r) / nullif(n + r + 0.5, 0)", "ndre": "(n - e) / nullif(n + e, 0)", "ndmi": "(n - s) / nullif(n + s, 0)"}


@query(
    " UNION ALL ".join(_STATS.format(name=k, res=20 if k in ("ndre", "ndmi") else 10, lo=-1.5 if k == "savi" else -1.0, hi=1.5 if k == "savi" else 1.0, formula=f, rows="c" if k in ("ndre", "ndmi") else "f") for k, f in _NATIVE.items()),
    fine=_FINE,
    coarse=_COARSE,
    f=f"SELECT a.field_id, a.inside, scl, {_RHO['B08']} AS n, {_RHO['B04']} AS r FROM fine a LEFT JOIN coarse b ON a.field_id = b.field_id AND floor(a.px_row / 2) = b.px_row AND floor(a.px_col / 2) = b.px_col",
    means="SELECT field_id, floor(px_row / 2) AS px_row, floor(px_col / 2) AS px_col, avg(b08) AS b08 FROM fine GROUP BY 1, 2, 3",
    c=f"SELECT b.field_id, inside, scl, {_RHO['B08']} AS n, {_RHO['B05']} AS e, {_RHO['B11']} AS s FROM coarse b LEFT JOIN means m ON b.field_id = m.field_id AND b.px_row = m.px_row AND b.px_col = m.px_col",
)
def native_statistics(spark, sf_dir):
    """Indices on their own grids, from 10 m bands and 20 m bands with scene classes."""
    px = view(spark, sf_dir, "pixel")
    fine, coarse = (spark.sql(q.replace("FROM pixel", "FROM {px}"), px=px) for q in (_FINE, _COARSE))
    out = rasters.analyse_native(fine, coarse, BY, F.lit(-1000.0), F.lit(10000.0))
    return out.select("field_id", "index_name", "resolution_m", "count", *(F.round(c, 6).alias(c) for c in ("mean", "p10", "clear_fraction")))


_LABELS = "SELECT field_id, px_row, px_col, CAST(floor(avg(b08) / 2000) AS BIGINT) AS zone FROM pixel GROUP BY 1, 2, 3"


@query(
    "SELECT field_id, zone, count(*) AS areas, CAST(sum(pixels) AS BIGINT) AS pixels, max(pixels) AS largest, CAST(sum(pixels) * 100 AS DOUBLE) AS m2 FROM (SELECT field_id, zone, comp, count(*) AS pixels FROM (SELECT id, any_value(field_id) AS field_id, any_value(zone) AS zone, min(other) AS comp FROM reach GROUP BY id) a GROUP BY 1, 2, 3) b GROUP BY 1, 2",
    cells=f"SELECT *, field_id * 10000 + px_row * 100 + px_col AS id FROM ({_LABELS}) x",
    links="SELECT a.id, b.id AS other FROM cells a JOIN cells b ON a.field_id = b.field_id AND a.zone = b.zone AND abs(a.px_row - b.px_row) + abs(a.px_col - b.px_col) = 1",
    walk="WITH RECURSIVE w(id, other) AS (SELECT id, id FROM cells UNION SELECT w.id, l.other FROM w JOIN links l ON w.other = l.id) SELECT * FROM w",
    reach="SELECT c.id, field_id, zone, other FROM cells c JOIN walk w ON c.id = w.id",
)
def zone_polygons(spark, sf_dir):
    """M5: the connected areas of each zone of a field as polygons on its grid: how many, and their size."""
    px = view(spark, sf_dir, "pixel")
    labels = spark.sql(_LABELS.replace("FROM pixel", "FROM {px}"), px=px)
    found = zones.zone_polygons(labels, BY, grids(px))
    flat = F.aggregate(F.flatten("geometry"), F.lit(0.0), lambda s, r: s + _signed(r))
    return found.groupBy("field_id", "zone").agg(F.count("*").alias("areas"), F.sum("pixels").alias("pixels"), F.max("pixels").alias("largest"), F.round(F.sum(flat), 3).alias("m2"))


def _signed(ring):
    """Area of a closed ring, negative if it runs clockwise."""
    a, b = F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1)
    o = ring[0]
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p["x"] - o["x"]) * (q["y"] - o["y"]) - (q["x"] - o["x"]) * (p["y"] - o["y"])), F.lit(0.0), lambda s, v: s + v) / 2


def _paint(value: str, lo: float, hi: float, ramp: tuple[str, ...], i: int) -> str:
    """SQL of a channel of the ramp's colour."""
    stops = "[" + ", ".join(str(int(c[1 + 2 * i : 3 + 2 * i], 16)) for c in ramp) + "]"
    at = f"greatest(0.0, least(1.0, ({value} - {lo}) / ({hi - lo!r}))) * {len(ramp) - 1}"
    left = f"CAST(least(floor({at}), {len(ramp) - 2}) AS INT)"
    return f"CAST(round({stops}[{left} + 1] + ({stops}[{left} + 2] - {stops}[{left} + 1]) * ({at} - {left})) AS INT)"


_INDEX_RASTER = f"SELECT field_id, px_row, px_col, avg(({_RHO['B08']} - {_RHO['B04']}) / nullif({_RHO['B08']} + {_RHO['B04']}, 0)) AS value FROM pixel GROUP BY 1, 2, 3"
ZOOMS = (12, 14)


def _index_raster(spark, px: DataFrame, name: str = "ndvi") -> DataFrame:
    rho = {b: X.reflectance(F.col(b.lower()).cast("double"), F.lit(-1000.0), F.lit(10000.0)) for b in ("B08", "B04", "B05", "B11")}
    return px.groupBy("field_id", "px_row", "px_col").agg(X.steady_mean(X.index_value(name, rho)).alias("value"))


_TILE = "2 * pi() * 6378137.0::DOUBLE"


@query(
    f"SELECT field_id, z, gx // 256 AS x, gy // 256 AS y, CAST(gy % 256 AS INT) AS row, CAST(gx % 256 AS INT) AS col, round(value, 6) AS value, {_paint('value', -0.2, 0.9, VEGETATION_RAMP, 0)} AS r, {_paint('value', -0.2, 0.9, VEGETATION_RAMP, 1)} AS g, {_paint('value', -0.2, 0.9, VEGETATION_RAMP, 2)} AS b FROM looked JOIN source USING (field_id, z, px_row, px_col)",
    grids=GRIDS,
    raster=_INDEX_RASTER,
    ends=_lonlat("SELECT field_id, x0, y0, x0 + i * 640 AS e, y0 - j * 640 AS nn FROM grids, range(2) s(i), range(2) t(j)"),
    bounds=f"SELECT *, 256 * pow(2, z) AS n, CAST(pow(2, greatest(floor(log2({_TILE} * cos(radians(s)) / (256 * pow(2, z)) / 10)), 0)) AS BIGINT) AS factor FROM (SELECT field_id, x0, y0, min(lon) AS w, max(lon) AS o, min(lat) AS s, max(lat) AS t FROM ends GROUP BY 1, 2, 3) k, (VALUES (12), (14)) q(z)",
    px="SELECT field_id, x0, y0, z, n, factor, gx, gy, (gx + 0.5) / n * 360 - 180 AS lon, degrees(atan(sinh(3.141592653589793 * (1 - 2 * (gy + 0.5) / n)))) AS lat, 32736 AS zone FROM (SELECT *, unnest(range(CAST(floor((1 - asinh(tan(radians(t))) / 3.141592653589793) / 2 * n) - 2 AS BIGINT), CAST(floor((1 - asinh(tan(radians(s))) / 3.141592653589793) / 2 * n) + 3 AS BIGINT))) AS gy FROM (SELECT *, unnest(range(CAST(floor((w + 180) / 360 * n) - 2 AS BIGINT), CAST(floor((o + 180) / 360 * n) + 3 AS BIGINT))) AS gx FROM bounds) a) b",
    placed=utm("SELECT * FROM px"),
    looked="SELECT *, CAST(floor((y0 - nn) / 10) AS BIGINT) // factor AS px_row, CAST(floor((e - x0) / 10) AS BIGINT) // factor AS px_col FROM placed WHERE e >= x0 AND e < x0 + 640 AND nn <= y0 AND nn > y0 - 640",
    source="SELECT r.field_id, z, px_row // factor AS px_row, px_col // factor AS px_col, avg(value) AS value FROM raster r JOIN bounds b ON r.field_id = b.field_id GROUP BY ALL HAVING avg(value) IS NOT NULL",
)
def map_tile_pixels(spark, sf_dir):
    """The pixels of map tiles at two zooms, one of them from an overview, with their colours."""
    px = view(spark, sf_dir, "pixel")
    out = rasters.painted(rasters.tiles(_index_raster(spark, px), grids(px), BY, list(ZOOMS)), "ndvi")
    return out.select("field_id", "z", "x", "y", "row", "col", F.round("value", 6).alias("value"), *(F.get("rgba", F.lit(i)).alias(c) for i, c in enumerate("rgb")))


@query(
    f"SELECT field_id, px_row, px_col, round(value, 6) AS value, {_paint('value', -0.9, 0.9, ('#a50026', '#d73027', '#f46d43', '#fdae61', '#fee08b', '#ffffbf', '#d9ef8b', '#a6d96a', '#66bd63', '#1a9850', '#006837'), 0)} AS r FROM (SELECT x.field_id, x.px_row, x.px_col, y.value - x.value AS value FROM a x JOIN b y ON x.field_id = y.field_id AND x.px_row = y.px_row AND x.px_col = y.px_col) d WHERE value IS NOT NULL",
    a=_INDEX_RASTER.replace("FROM pixel", "FROM pixel WHERE scl < 7"),
    b=_INDEX_RASTER.replace("FROM pixel", "FROM pixel WHERE scl >= 7"),
)
def difference_picture(spark, sf_dir):
    """The change of an index between two passes on the symmetric range of differences."""
    from verdure.operators.pixels import difference

    px = view(spark, sf_dir, "pixel")
    a, b = (_index_raster(spark, px.where(c)) for c in ("scl < 7", "scl >= 7"))
    out = rasters.painted(difference(a, b, BY).where("value IS NOT NULL"), "ndvi", difference=True)
    return out.select("field_id", "px_row", "px_col", F.round("value", 6).alias("value"), F.get("rgba", F.lit(0)).alias("r"))


def _shade(b: str, top: float) -> str:
    return f"CASE WHEN ok THEN CAST(round(greatest(0.0, least(1.0, {_RHO[b]} / {top})) * 255) AS INT) ELSE 0 END"


@query(
    f"SELECT field_id, px_row, px_col, {_shade('B08', 0.45)} AS r, {_shade('B04', 0.3)} AS g, {_shade('B05', 0.3)} AS b, CASE WHEN ok THEN 255 ELSE 0 END AS a FROM (SELECT *, inside AND b08 <> 0 AND b04 <> 0 AND b05 <> 0 AS ok FROM bands) x",
    bands="SELECT field_id, px_row, px_col, bool_or(inside) AS inside, max(b08) AS b08, min(b04) AS b04, CASE WHEN min(px_col) % 10 = 0 THEN 0 ELSE min(b05) END AS b05 FROM pixel GROUP BY 1, 2, 3",
)
def false_colour(spark, sf_dir):
    """The false colour picture of each field, clipped to its area; the green band is taken from the table's third."""
    px = view(spark, sf_dir, "pixel").groupBy("field_id", "px_row", "px_col").agg(F.bool_or("inside").alias("inside"), F.max("b08").alias("b08"), F.min("b04").alias("b04"), F.when(F.min("px_col") % 10 == 0, 0).otherwise(F.min("b05")).alias("b03"))
    bands = {b: X.reflectance(F.col(b.lower()).cast("double"), F.lit(-1000.0), F.lit(10000.0)) for b in ("B08", "B04", "B03")}
    out = rasters.pictured(px, "fcc", bands, F.col("inside"))
    return out.select("field_id", "px_row", "px_col", *(F.get("rgba", F.lit(i)).alias(c) for i, c in enumerate("rgba")))


@query(
    f"SELECT field_id, px_row // 4 AS row, px_col // 4 AS col, round(avg(value), 6) AS value, {_paint('avg(value)', -0.3, 0.5, MOISTURE_RAMP, 1)} AS g FROM (SELECT field_id, px_row, px_col, avg(({_RHO['B08']} - {_RHO['B11']}) / nullif({_RHO['B08']} + {_RHO['B11']}, 0)) AS value FROM pixel GROUP BY 1, 2, 3) r GROUP BY 1, 2, 3"
)
def raster_preview(spark, sf_dir):
    """M8, H6: a preview of each field's moisture, its longer side of no more than 16 pixels."""
    px = view(spark, sf_dir, "pixel")
    out = rasters.painted(rasters.preview(_index_raster(spark, px, "ndmi"), grids(px), BY, longest=16), "ndmi")
    return out.select("field_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.round("value", 6).alias("value"), F.get("rgba", F.lit(1)).alias("g"))


@query(
    f"SELECT field_id DIV_40 AS farm_id, count(*) FILTER (ok) AS clear, count(*) FILTER (covered) AS covered, round(avg(ndvi) FILTER (ok), 6) AS mean FROM (SELECT *, covered AND scl IN (4, 5, 6, 7) AS ok FROM met) x GROUP BY 1".replace("field_id DIV_40", "field_id // 40"),
    grids=GRIDS,
    middle=_MIDDLE,
    centres=_lonlat("SELECT p.field_id, scl, (n - r) / nullif(n + r, 0) AS ndvi, x0 + (px_col + 0.5) * 10 AS e, y0 - (px_row + 0.5) * 10 AS nn FROM (SELECT *, " + f"{_RHO['B08']} AS n, {_RHO['B04']} AS r" + " FROM pixel) p JOIN grids g ON p.field_id = g.field_id"),
    met=f"SELECT *, {_IN} AS covered FROM (SELECT c.*, c.lon - 0.3 * (c.lat + 18) - (m.lon - 0.3 * (m.lat + 18)) AS du, c.lat - m.lat AS dv FROM centres c JOIN middle m ON c.field_id = m.field_id) y",
)
def farm_union_series(spark, sf_dir):
    """Q-09, H2 to H4: an index over the union of each farm's fields: the union is rasterised on each grid that it meets and the pixels below it are averaged."""
    px = view(spark, sf_dir, "pixel")
    area = _areas(px).withColumn("farm_id", F.floor(F.col("field_id") / 40))
    union = overlay.union_by(area.select("farm_id", "geometry"), ["farm_id"])
    shapes = area.drop("geometry").join(union, "farm_id")
    hit = rasters.inside(px.drop("inside"), shapes, BY).withColumn("farm_id", F.floor(F.col("field_id") / 40))
    rho = {b: X.reflectance(F.col(b.lower()).cast("double"), F.lit(-1000.0), F.lit(10000.0)) for b in ("B08", "B04", "B05", "B11")}
    ok = F.col("inside") & X.clear(F.col("scl"))
    return hit.groupBy("farm_id").agg(F.count_if(ok).alias("clear"), F.count_if("inside").alias("covered"), F.round(F.avg(F.when(ok, X.index_value("ndvi", rho))), 6).alias("mean"))


@query(f"SELECT field_id, px_row, px_col, round(avg({_RHO['B08']}), 6) AS mean FROM pixel GROUP BY 1, 2, 3 HAVING count({_RHO['B08']}) >= 2")
def temporal_means(spark, sf_dir):
    """M1: the mean over time of each pixel with at least two valid observations."""
    px = view(spark, sf_dir, "pixel")
    v = X.reflectance(F.col("b08").cast("double"), F.lit(-1000.0), F.lit(10000.0))
    return zones.temporal_means(px.select("field_id", "px_row", "px_col", v.alias("value")), 2).withColumn("mean", F.round("mean", 6))
