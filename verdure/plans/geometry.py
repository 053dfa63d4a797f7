"""Named queries over polygons, with SQL: lots are slanted fields on a lattice across the border of two UTM zones, laid over customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdure.functions import columns as X
from verdure.operators import geo, overlay
from verdure.plans.queries import query

#: Degrees east for one north: how far all shapes slant.
SLANT = 0.3
_U, _V = "29.9 + c_custkey % 50 * 0.005", "-18 + floor(c_custkey / 50) % 500 * 0.004"
LOTS = f"SELECT c_custkey AS id, CAST(floor(c_custkey / 40) AS BIGINT) AS farm_id, {_U} AS u, {_V} AS v, 0.004 + c_custkey % 3 * 0.001 AS w FROM customer"


def lots(spark, sf_dir: str) -> DataFrame:
    """id, farm_id, u, v, w of every lot."""
    return spark.sql(LOTS.replace("FROM customer", "FROM {customer}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


def slanted(u0, v0, u1, v1) -> Column:
    """The ring of a rectangle in slanted coordinates."""
    at = lambda u, v: F.struct((u + SLANT * (v + 18)).cast("double").alias("x"), v.cast("double").alias("y"))
    u0, v0, u1, v1 = (x if isinstance(x, Column) else F.lit(x) for x in (u0, v0, u1, v1))
    return F.array(at(u0, v0), at(u1, v0), at(u1, v1), at(u0, v1))


def shape(*rings: Column) -> Column:
    return F.array(F.array(*rings)).cast(overlay.MULTI)


def lot_shape(grow: float | Column = 0.0) -> Column:
    return shape(slanted(F.col("u"), F.col("v"), F.col("u") + F.col("w") + grow, F.col("v") + 0.003))


def corners(sql: str) -> str:
    """SQL of the four corners (n from 0) of rectangles (id, u0, v0, u1, v1) in degrees."""
    return f"SELECT *, CASE WHEN n IN (0, 3) THEN u0 ELSE u1 END + {SLANT} * (CASE WHEN n < 2 THEN v0 ELSE v1 END + 18) AS lon, CASE WHEN n < 2 THEN v0 ELSE v1 END AS lat FROM ({sql}) r, range(4) t(n)"


def utm(sql: str) -> str:
    """SQL of rows (lon, lat, zone) with easting e and northing nn."""
    f = 1 / 298.257223563
    n, ecc = f / (2 - f), (f * (2 - f)) ** 0.5
    a = 6378137 / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * 0.9996
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    east = " + ".join(f"{k!r}::DOUBLE * cos({2 * j} * ty) * sinh({2 * j} * tx)" for j, k in enumerate(alpha, 1))
    north = " + ".join(f"{k!r}::DOUBLE * sin({2 * j} * ty) * cosh({2 * j} * tx)" for j, k in enumerate(alpha, 1))
    return f"""SELECT *, 500000 + {a!r} * (tx + {east}) AS e, 10000000 + {a!r} * (ty + {north}) AS nn FROM
      (SELECT *, atanh(sin(d) / sqrt(1 + tt * tt)) AS tx, atan2(tt, cos(d)) AS ty FROM
       (SELECT *, radians(lon - ((zone % 100) * 6 - 183)) AS d, sinh(atanh(sin(radians(lat))) - {ecc!r} * atanh({ecc!r} * sin(radians(lat)))) AS tt FROM ({sql}) a) b) c"""


def areas(sql: str, keys: str) -> str:
    """SQL of the area, by the shoelace formula, of corners (keys, n, e, nn)."""
    ring = f"PARTITION BY {keys} ORDER BY n"
    return f"SELECT {keys}, abs(sum(cross2)) / 2 AS m2 FROM (SELECT {keys}, e * coalesce(lead(nn) OVER ({ring}), 0) - nn * coalesce(lead(e) OVER ({ring}), 0) AS cross2 FROM (SELECT {keys}, n, e - first_value(e) OVER ({ring}) AS e, nn - first_value(nn) OVER ({ring}) AS nn FROM ({sql}) w) x) y GROUP BY {keys}"


_ISLANDS = """SELECT farm_id, v, island, min(u) AS u0, v AS v0, max(u1) AS u1, v + 0.003 AS v1 FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY farm_id, v ORDER BY u, id) AS island FROM (
   SELECT *, u + w AS u1, CASE WHEN u <= max(u + w) OVER (PARTITION BY farm_id, v ORDER BY u, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-9 THEN 0 ELSE 1 END AS fresh FROM lots) a) b GROUP BY farm_id, v, island"""
_FARM_ZONE = f"SELECT farm_id, CASE WHEN sum((u1 - u0) * ((u0 + u1) / 2 + {SLANT} * ((v0 + v1) / 2 + 18))) / sum(u1 - u0) >= 30 THEN 32736 ELSE 32735 END AS zone FROM islands GROUP BY farm_id"


@query(
    "SELECT l.farm_id, n_geometries, parts, round(m2)::DOUBLE AS area_m2 FROM (SELECT farm_id, count(*) AS n_geometries FROM lots GROUP BY 1) l JOIN (SELECT farm_id, count(*) AS parts, sum(m2) AS m2 FROM m GROUP BY 1) k ON l.farm_id = k.farm_id",
    lots=LOTS,
    islands=_ISLANDS,
    zones=_FARM_ZONE,
    placed=utm(corners("SELECT i.*, zone FROM islands i JOIN zones z ON i.farm_id = z.farm_id")),
    m=areas("SELECT * FROM placed", "farm_id, v, island"),
)
def farm_union(spark, sf_dir):
    """The union of each farm's fields, which touch, overlap or stand apart: its parts and area."""
    u = overlay.union_by(lots(spark, sf_dir).withColumn("geometry", lot_shape()), ["farm_id"])
    return u.select("farm_id", "n_geometries", F.size("geometry").cast("long").alias("parts"), F.round(overlay.area_m2(F.col("geometry"))).alias("area_m2"))


_OVER = "greatest(0.0, least(u + w, {u1}) - greatest(u, {u0})) * greatest(0.0, least(v + 0.003, {v1}) - greatest(v, {v0}))"
_FARM = "SELECT farm_id, 29.9 AS u0, min(v) AS v0, 29.9 + 37 * 0.005 + 0.002 AS u1, max(v) + 0.003 AS v1, 29.9 + 0.051 AS h0, min(v) + 0.001 AS g0, 29.9 + 0.062 AS h1, min(v) + 0.002 AS g1 FROM lots GROUP BY farm_id"


@query(
    f"""SELECT id, farm_id, outside, outside <= 0.02 AS nested FROM (SELECT id, l.farm_id, CASE WHEN l.farm_id % 3 = 0 THEN 0.0 WHEN l.farm_id % 7 > 0 THEN
      round(1 - ({_OVER.format(u0="u0", u1="u1", v0="v0", v1="v1")} - {_OVER.format(u0="h0", u1="h1", v0="g0", v1="g1")}) / (w * 0.003), 4) + 0.0 END AS outside FROM lots l JOIN f ON l.farm_id = f.farm_id) x""",
    lots=LOTS,
    f=_FARM,
)
def field_nesting(spark, sf_dir):
    """The share of each field outside its farm, which has a hole, and whether that is tolerated; each third farm is the union of its fields, one in seven is unknown."""
    rows = lots(spark, sf_dir).withColumn("geometry", lot_shape())
    f = spark.sql(_FARM.replace("FROM lots", "FROM {lots}"), lots=rows)
    declared = shape(slanted(*map(F.col, ("u0", "v0", "u1", "v1"))), slanted(*map(F.col, ("h0", "g0", "h1", "g1"))))
    f = f.where("farm_id % 3 = 0 OR farm_id % 7 > 0").select("farm_id", F.when(F.col("farm_id") % 3 > 0, declared).alias("boundary"))
    out = overlay.nesting(rows.select("id", "farm_id", "geometry"), overlay.farm_boundaries(f, rows))
    return out.withColumn("outside", F.round("outside", 4) + 0.0)


_ZONES = "SELECT CASE (i + 2 * j) % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'II' ELSE 'III' END AS zone, 29.9 + 0.00002 + i * 0.007 AS u0, -18.0 + j * 0.01 AS v0, 29.9 + 0.00002 + (i + 1) * 0.007 AS u1, -18.0 + (j + 1) * 0.01 AS v1 FROM (SELECT n % 37 AS i, CAST(floor(n / 37) AS BIGINT) AS j FROM range({n}) t({id})) a WHERE i % 5 > 0"
_N_ZONES = 37 * 201


@query(
    "SELECT id, zone, share, row_number() OVER (PARTITION BY id ORDER BY share DESC, zone) = 1 AS dominant FROM (SELECT id, zone, round(part, 4) AS share FROM (SELECT id, zone, sum(part) AS part FROM met GROUP BY id, zone) s QUALIFY part >= 0.01 OR part < 0.01 AND row_number() OVER (PARTITION BY id ORDER BY part DESC, zone) = 1) x",
    lots=LOTS,
    zn=_ZONES.format(n=_N_ZONES, id="n"),
    met=f"SELECT id, zone, {_OVER.format(u0='u0', u1='u1', v0='v0', v1='v1')} / (w * 0.003) AS part FROM lots JOIN zn ON u < u1 AND u0 < u + w AND v < v1 AND v0 < v + 0.003",
)
def region_composition(spark, sf_dir):
    """J11, Q-18: shares of the zones, each of many parts, in each boundary, without slivers, and the dominant one."""
    z = spark.sql(_ZONES.replace("t({id})", "AS t(n)").format(n=_N_ZONES)).select("zone", shape(slanted(*map(F.col, ("u0", "v0", "u1", "v1")))).alias("geometry"))
    return overlay.composition(lots(spark, sf_dir).select("id", lot_shape().alias("geometry")), z)


_POINTS = "SELECT c_custkey AS id, 29 + (c_custkey * 37 % 5000) / 1000.0 AS lon, -20 + (c_custkey * 91 % 6000) / 1000.0 AS lat FROM customer"
_BOXES = {"A": (29.0, -19.0, 31.0, -15.0), "B": (31.0, -19.0, 33.0, -15.0)}
_SIDES = " UNION ALL ".join(f"SELECT '{k}' AS region_id, zone, {i} AS n, {(x0, x1, x1, x0, x0)[i]} AS lon, {(y0, y0, y1, y1, y0)[i]} AS lat FROM (VALUES (32735), (32736)) z(zone)" for k, (x0, y0, x1, y1) in _BOXES.items() for i in range(5))


@query(
    "SELECT p.id, p.lon, p.lat, r.region_id, gap <= 250 AS boundary_adjacent FROM p LEFT JOIN r ON p.id = r.id LEFT JOIN gaps g ON g.id = p.id AND g.region_id = r.region_id",
    p=f"SELECT id, CAST(lon AS DOUBLE) AS lon, CAST(lat AS DOUBLE) AS lat, CASE WHEN lon >= 30 THEN 32736 ELSE 32735 END AS zone FROM ({_POINTS}) q",
    r="SELECT id, CASE WHEN lon <= 31 THEN 'A' ELSE 'B' END AS region_id FROM p WHERE lat BETWEEN -19 AND -15 AND lon <= 33",
    spots=utm("SELECT * FROM p"),
    ends=utm(_SIDES),
    sides="SELECT region_id, zone, e AS x0, nn AS y0, lead(e) OVER o AS x1, lead(nn) OVER o AS y1 FROM ends WINDOW o AS (PARTITION BY region_id, zone ORDER BY n)",
    gaps="SELECT id, region_id, min(sqrt(pow(x0 + t * (x1 - x0) - e, 2) + pow(y0 + t * (y1 - y0) - nn, 2))) AS gap FROM (SELECT *, greatest(0.0, least(1.0, ((e - x0) * (x1 - x0) + (nn - y0) * (y1 - y0)) / (pow(x1 - x0, 2) + pow(y1 - y0, 2)))) AS t FROM spots JOIN sides USING (zone) WHERE x1 IS NOT NULL) s GROUP BY 1, 2",
)
def region_assignment(spark, sf_dir):
    """The region that covers each point, on a shared edge the first by id, and whether its border is near."""
    points = spark.sql(_POINTS.replace("FROM customer", "FROM {customer}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    boxes = [(k, [[[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]]]) for k, (x0, y0, x1, y1) in _BOXES.items()]
    regions = spark.createDataFrame(boxes, f"region_id string, geometry {overlay.MULTI}")
    return overlay.assign(points.select("id", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")), regions)


@query(
    "SELECT id, zone AS epsg, round(e, 3) AS easting, round(nn, 3) AS northing FROM placed",
    placed=utm(f"SELECT id, CAST(lon AS DOUBLE) AS lon, CAST(lat AS DOUBLE) AS lat, CAST(CASE WHEN lon >= 30 THEN 32736 ELSE 32735 END AS INT) AS zone FROM ({_POINTS}) q"),
)
def utm_positions(spark, sf_dir):
    """Projected positions; tests hold them against published values."""
    p = spark.sql(_POINTS.replace("FROM customer", "FROM {customer}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    e, n = geo.to_utm(F.col("lon"), F.col("lat"), X.utm_zone(F.col("lon")))
    return p.select("id", X.utm_zone(F.col("lon")).cast("int").alias("epsg"), F.round(e, 3).alias("easting"), F.round(n, 3).alias("northing"))


_NEW = "SELECT id, farm_id, u, v, w, CASE WHEN id % 2 = 0 THEN concat('c', CAST(id AS STRING)) END AS canonical_id FROM ({lots}) a UNION ALL SELECT id + 1000000000, farm_id, u, v, w, CASE WHEN id % 2 = 0 THEN concat('c', CAST(id AS STRING)) END FROM ({lots}) b WHERE id % 9 = 0"
_OLD = "SELECT id * 10 AS field_id, farm_id, u, v, CASE WHEN id % 3 = 0 THEN w + 0.001 ELSE w END AS w, CASE WHEN id % 2 = 0 THEN concat('c', CAST(id AS STRING)) END AS canonical_id FROM ({lots}) a WHERE id % 7 > 0 UNION ALL SELECT id * 10 + 1, farm_id, u, v, w, CAST(NULL AS STRING) FROM ({lots}) b WHERE id % 27 = 9 UNION ALL SELECT id * 10 + 2, farm_id, u, v, w, CAST(NULL AS STRING) FROM ({lots}) c WHERE id % 27 = 9"


@query(
    """SELECT n.id, n.farm_id, o.field_id, CASE WHEN o.field_id IS NULL THEN 'created' WHEN n.w = o.w THEN 'unchanged' ELSE 'updated_geometry' END AS action FROM
      (SELECT *, row_number() OVER (PARTITION BY farm_id, canonical_id, CASE WHEN canonical_id IS NULL THEN id % 1000000000 END ORDER BY id) AS turn FROM new) n LEFT JOIN
      (SELECT *, row_number() OVER (PARTITION BY farm_id, canonical_id, u, v, w ORDER BY field_id) AS turn FROM old) o
      ON n.farm_id = o.farm_id AND n.turn = o.turn AND CASE WHEN n.canonical_id IS NULL THEN o.canonical_id IS NULL AND n.u = o.u AND n.v = o.v AND n.w = o.w ELSE n.canonical_id = o.canonical_id END
      UNION ALL SELECT -n_nationkey, -n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN -n_nationkey END, CASE WHEN n_nationkey % 2 > 0 THEN 'derived_from_farm' WHEN n_nationkey % 4 > 0 THEN 'updated_geometry' ELSE 'unchanged' END FROM nation WHERE n_nationkey > 0""",
    lots=LOTS,
    new=_NEW.replace("({lots})", "lots").replace("STRING", "VARCHAR"),
    old=_OLD.replace("({lots})", "lots").replace("STRING", "VARCHAR"),
)
def ingest_match(spark, sf_dir):
    """F9, F12, Q-13: incoming fields against the stored ones, one to one.

    Even ids have canonical ids; each ninth field comes twice; a seventh is not
    stored; of each third the boundary changed; some without id are stored again twice.
    Farms of negative id have no fields: their own boundary is one.
    """
    base, nation = lots(spark, sf_dir), spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey > 0")
    keep = lambda df, key: df.select(key, "farm_id", "canonical_id", lot_shape().alias("geometry"), F.lit(False).alias("derived"))
    new, old = (spark.sql(q.replace("({lots})", "{lots}"), lots=base) for q in (_NEW, _OLD))
    k = F.col("n_nationkey").cast("bigint")
    whole = lambda size: shape(slanted(31.0, -19.0, F.lit(31.0) + size, -18.9))
    farms = nation.select((-k).alias("id"), (-k).alias("farm_id"), F.lit(None).cast("string").alias("canonical_id"), whole(F.lit(0.1)).alias("geometry"), F.lit(True).alias("derived"))
    was = nation.where("n_nationkey % 2 = 0").select((-k).alias("field_id"), (-k).alias("farm_id"), F.lit(None).cast("string").alias("canonical_id"), whole(F.when(k % 4 > 0, 0.2).otherwise(0.1)).alias("geometry"), F.lit(True).alias("derived"))
    return overlay.match_fields(keep(new, "id").unionByName(farms), keep(old, "field_id").unionByName(was))


_PIECES = f"""SELECT id, 0 AS piece, n, lon, lat FROM ({corners("SELECT id, u AS u0, v AS v0, u + w AS u1, v + 0.003 AS v1 FROM lots WHERE id % 6 = 0")}) a UNION ALL
  SELECT id, CASE WHEN n IN (0, 3) THEN 0 ELSE 1 END, n, lon, lat FROM ({corners("SELECT id, u AS u0, v AS v0, u + w AS u1, v + 0.003 AS v1 FROM lots WHERE id % 6 = 1")}) b UNION ALL
  SELECT id, p, 9, u + w / 2 + {SLANT} * (v + 0.0015 + 18), v + 0.0015 FROM lots, range(2) t(p) WHERE id % 6 = 1"""


@query(
    """SELECT l.id, l.id % 6 IN (0, 1, 5) AS ok, CASE l.id % 6 WHEN 2 THEN 'geometry must be polygonal, got ''Point''' WHEN 3 THEN 'geometry area below 1.0 m² (degenerate)' WHEN 4 THEN 'geometry is empty' END AS reason,
      l.id % 6 = 1 AS repaired, CASE WHEN l.id % 6 = 5 THEN 250000.0 ELSE round(m2) END AS area_m2 FROM lots l LEFT JOIN (SELECT id, sum(m2) AS m2 FROM m GROUP BY 1) k ON l.id = k.id""",
    lots=LOTS,
    pieces=_PIECES,
    zoned=f"SELECT p.*, CASE WHEN u + w / 2 + {SLANT} * (v + 0.0015 + 18) >= 30 THEN 32736 ELSE 32735 END AS zone FROM pieces p JOIN lots l ON p.id = l.id",
    placed=utm("SELECT * FROM zoned"),
    m=areas("SELECT * FROM placed", "id, piece"),
)
def geometry_checks(spark, sf_dir):
    """GeoJSON boundaries: sound, crossing themselves, no polygons, too small, empty, or in metres of a UTM grid."""
    rows = overlay.dealt(lots(spark, sf_dir), "id")
    k, ring = F.col("id") % 6, slanted(F.col("u"), F.col("v"), F.col("u") + F.col("w"), F.col("v") + 0.003)
    bow = F.array(ring[0], ring[2], ring[1], ring[3])
    tiny = slanted(F.col("u"), F.col("v"), F.col("u") + 1e-7, F.col("v") + 1e-7)
    east, side = F.lit(300_000.0) + F.col("id") % 1000, 500.0
    grid = F.array(*(F.struct((east + a).alias("x"), F.lit(8_030_000.0 + b).alias("y")) for a, b in ((0.0, 0.0), (side, 0.0), (side, side), (0.0, side))))
    made = F.when(k == 0, ring).when(k == 1, bow).when(k == 3, tiny).when(k == 5, grid)
    closed = F.transform(F.concat(made, F.slice(made, 1, 1)), lambda p: F.array(p["x"], p["y"]))
    polygon = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.when(made.isNotNull(), F.array(closed)).otherwise(F.array()).alias("coordinates")))
    point = F.lit('{"type": "Point", "coordinates": [30, -18]}')
    kind, g = overlay.from_geojson(F.when(k == 2, point).otherwise(polygon))
    out = rows.select("id", overlay.validated(kind, g, F.when(k == 5, 32736).otherwise(4326)).alias("c"))
    return out.select("id", "c.ok", "c.reason", "c.repaired", F.round("c.area_m2").alias("area_m2"))


@query(
    "SELECT id, sha256(printf('%s|%s', ring(lon, lat, 0.75, 0.5), ring(lon + 0.1, lat + 0.1, 0.25, 0.125))) AS boundary_key FROM p".replace("ring(lon, lat, 0.75, 0.5)", "printf('%.6f %.6f;%.6f %.6f;%.6f %.6f;%.6f %.6f', lon, lat, lon, lat + 0.5, lon + 0.75, lat + 0.5, lon + 0.75, lat)").replace("ring(lon + 0.1, lat + 0.1, 0.25, 0.125)", "printf('%.6f %.6f;%.6f %.6f;%.6f %.6f;%.6f %.6f', lon + 0.1, lat + 0.1, lon + 0.1, lat + 0.225, lon + 0.35, lat + 0.225, lon + 0.35, lat + 0.1)"),
    p=f"SELECT id, CAST(lon AS DOUBLE) AS lon, CAST(lat AS DOUBLE) AS lat FROM ({_POINTS}) q",
)
def geometry_keys(spark, sf_dir):
    """Keys of polygons with a hole, whichever way their rings run."""
    p = spark.sql(_POINTS.replace("FROM customer", "FROM {customer}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    at = lambda x, y: F.struct((F.col("lon") + x).cast("double").alias("x"), (F.col("lat") + y).cast("double").alias("y"))
    ring = lambda x, y, w, h: F.array(at(x, y), at(x + w, y), at(x + w, y + h), at(x, y + h))
    shell, hole = ring(0.0, 0.0, 0.75, 0.5), ring(0.1, 0.1, 0.25, 0.125)
    turned = F.when(F.col("id") % 2 == 0, F.reverse(hole)).otherwise(F.concat(F.slice(hole, 3, 2), F.slice(hole, 1, 2)))
    return p.select("id", geo.geometry_key(shape(shell, turned)).alias("boundary_key"))


@query(
    """SELECT concat('layer-', farm_id, '.geojson') AS file, CAST(CASE WHEN farm_id % 9 <> 2 THEN n - 1 END AS INT) AS position, CASE WHEN id % 13 > 0 AND farm_id % 9 <> 2 THEN concat('lot ', id) END AS name,
      CASE WHEN farm_id % 9 = 2 THEN 'name column ''NAME'' not in layer' WHEN id % 6 = 4 THEN 'empty or missing geometry' WHEN id % 13 = 0 THEN concat('missing name in column ''NAME', chr(39))
      WHEN id % 6 = 2 THEN 'geometry must be polygonal, got ''Point''' WHEN id % 6 = 3 THEN 'geometry area below 1.0 m² (degenerate)' END AS reason, farm_id % 9 <> 2 AND id % 13 > 0 AND id % 6 = 1 AS repaired
      FROM (SELECT *, row_number() OVER (PARTITION BY farm_id ORDER BY id) AS n FROM lots) x WHERE farm_id % 9 <> 2 OR n = 1""",
    lots=LOTS,
)
def uploaded_layers(spark, sf_dir):
    """S26, K27, Q-19, H13 to H15: uploaded GeoJSON layers, one a farm, feature by feature: names, repairs, and why one is skipped; some layers lack the name column."""
    from verdure.sources import layers

    rows = lots(spark, sf_dir)
    k, ring = F.col("id") % 6, slanted(F.col("u"), F.col("v"), F.col("u") + F.col("w"), F.col("v") + 0.003)
    tiny = slanted(F.col("u"), F.col("v"), F.col("u") + 1e-7, F.col("v") + 1e-7)
    made = F.when(k == 1, F.array(ring[0], ring[2], ring[1], ring[3])).when(k == 3, tiny).when(k.isin(0, 5), ring)
    closed = F.transform(F.concat(made, F.slice(made, 1, 1)), lambda p: F.array(p["x"], p["y"]))
    polygon = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates")))
    shape_text = F.when(k == 2, '{"type": "Point", "coordinates": [30, -18]}').when(k == 4, "null").otherwise(polygon)
    name = F.when(F.col("id") % 13 > 0, F.concat(F.lit('"lot '), F.col("id"), F.lit('"'))).otherwise("null")
    column = F.when(F.col("farm_id") % 9 == 2, "TITLE").otherwise("NAME")
    feature = F.concat(F.lit('{"type": "Feature", "properties": {"'), column, F.lit('": '), name, F.lit('}, "geometry": '), shape_text, F.lit("}"))
    # a farm has forty lots at most
    files = rows.groupBy("farm_id").agg(F.array_sort(F.collect_list(F.struct("id", feature.alias("f")))).alias("fs"))
    text = F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.transform("fs", lambda x: x["f"]), ", "), F.lit("]}"))
    raw = files.select(F.concat(F.lit("layer-"), F.col("farm_id"), F.lit(".geojson")).alias("path"), text.cast("binary").alias("content"))
    return layers.parse_layers(raw, "NAME").select("file", "position", "name", "reason", "repaired")
