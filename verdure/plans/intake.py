"""Named queries over requests, incoming farms and drawn regions, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdure.functions import columns as X
from verdure.operators import intake, overlay
from verdure.operators.geo import geometry_key
from verdure.plans.geometry import _N_ZONES, _OVER, _ZONES, LOTS, lot_shape, lots, shape, slanted
from verdure.plans.queries import query
from verdure.plans.views import view


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'provide exactly one of `index` or `indices`' WHEN o_orderkey % 11 = 1 THEN '`indices` must be non-empty' WHEN o_orderkey % 11 = 2 THEN 'unknown index ''gndvi'''
      WHEN o_orderkey % 2 = 0 AND (n = 0 OR n > 24) THEN 'provide between 1 and 24 dates' WHEN o_orderkey % 2 = 0 AND CAST(o_orderdate AS DATE) + n - 1 > DATE '1998-01-01' THEN 'dates cannot be in the future' WHEN o_orderkey % 2 > 0 AND n > 18 THEN 'months must be between 1 and 18'
      WHEN o_custkey % 9 = 0 THEN 'AOI is too large for a preview (over 2.0 degrees across); draw a field-sized area.' END AS reason FROM q""",
    q="SELECT o_orderkey, o_orderdate, o_custkey, CAST(o_custkey % 29 AS INT) AS n FROM orders",
)
def series_requests(spark, sf_dir):
    """Requests for series and why they are refused."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("d"), "o_custkey", (F.col("o_custkey") % 29).cast("int").alias("n"))
    k = F.col("o_orderkey") % 11
    dates = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.date_add(F.col("d"), i))).otherwise(F.array().cast("array<date>"))
    wide = F.when(F.col("o_custkey") % 9 == 0, 2.5).otherwise(0.5)
    r = o.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "dates").otherwise("backfill").alias("mode"), F.when((k == 0) | (k > 1), F.when(k == 2, "gndvi").otherwise("NDVI")).alias("index"),
        F.when(k == 0, F.array(F.lit("ndvi"))).when(k == 1, F.array().cast("array<string>")).alias("indices"), dates.alias("dates"), F.col("n").alias("months"), shape(slanted(30.0, -18.0, F.lit(30.0) + wide, -17.5)).alias("geometry"),
    )
    return r.select("id", intake.refused(F.lit("1998-01-01").cast("date"), X.index_names()).alias("reason"))


_FARM_OF = "farm_id % 7 = 1"


@query(
    f"""SELECT farm_id, id, CASE WHEN farm_id % 2 = 0 THEN id * 10 END AS field_id, CASE WHEN farm_id % 2 > 0 THEN 'created' WHEN id % 5 = 0 THEN 'updated_geometry' ELSE 'unchanged' END AS action, id % 8 = 3 AS repaired, NULL AS reason FROM lots WHERE farm_id % 7 > 2
      UNION ALL SELECT farm_id, NULL, NULL, NULL, NULL, concat('field (c', min(id), '): geometry area below 1.0 m² (degenerate)') FROM lots WHERE {_FARM_OF} GROUP BY 1
      UNION ALL SELECT farm_id, NULL, NULL, NULL, NULL, concat('field ''c', min(id), ''' is not nested within the farm boundary (50.0% of its area lies outside the tolerance)') FROM lots WHERE farm_id % 7 = 2 GROUP BY 1
      UNION ALL SELECT farm_id, id, NULL, 'created', id % 8 = 3, NULL FROM lots WHERE farm_id % 7 = 0 AND farm_id % 2 > 0 UNION ALL SELECT farm_id, id, id * 10, CASE WHEN id % 5 = 0 THEN 'updated_geometry' ELSE 'unchanged' END, id % 8 = 3, NULL FROM lots WHERE farm_id % 7 = 0 AND farm_id % 2 = 0
      UNION ALL SELECT -1 - n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN -1 - n_nationkey END, NULL, CASE WHEN n_nationkey % 2 = 0 THEN 'derived_from_farm' END, CASE WHEN n_nationkey % 2 = 0 THEN FALSE END, CASE WHEN n_nationkey % 2 > 0 THEN 'farm has neither a boundary nor any fields - nothing to analyse' END FROM nation""",
    lots=LOTS,
)
def farm_ingest(spark, sf_dir):
    """Q-13, F7, F10 to F12, H70, K25: incoming farms, refused or taken whole; their fields, repaired or not, against the stored ones.

    One farm in seven has a field that is too small, one a field half outside, one
    declares its boundary and holds all; farms of negative id have no fields, and half of them nothing at all.
    """
    rows = lots(spark, sf_dir).withColumn("first", F.min("id").over(_window()))
    k, ring = F.col("farm_id") % 7, slanted(F.col("u"), F.col("v"), F.col("u") + F.col("w"), F.col("v") + 0.003)
    bad, bow = slanted(F.col("u"), F.col("v"), F.col("u") + 1e-7, F.col("v") + 1e-7), F.array(ring[0], ring[1], ring[2], ring[1], ring[2], ring[3])
    made = F.when((k == 1) & (F.col("id") == F.col("first")), bad).when(F.col("id") % 8 == 3, bow).otherwise(ring)
    text = lambda r: F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(F.concat(r, F.slice(r, 1, 1)), lambda p: F.array(p["x"], p["y"]))).alias("coordinates")))
    name = F.concat(F.lit("c"), "id")
    fields = rows.select("id", "farm_id", name.alias("canonical_id"), text(made).alias("boundary"), F.lit(4326).alias("epsg"))
    # all of a farm, or all but half of its first field
    edge = F.min(F.struct("id", "u", "v", "w"))
    farms = rows.groupBy("farm_id").agg(F.min("u").alias("u0"), F.min("v").alias("v0"), F.max(F.col("u") + F.col("w")).alias("u1"), (F.max("v") + 0.003).alias("v1"), edge.alias("e"))
    whole = slanted(*map(F.col, ("u0", "v0", "u1", "v1")))
    # a notch over the upper half of the first field
    e = F.col("e")
    at = lambda u, v: slanted(u, v, u, v)[0]
    left, right, mid, top = e["u"], e["u"] + e["w"], e["v"] + 0.0015, e["v"] + 0.003
    notched = F.array(at(F.col("u0") - 0.01, F.col("v0")), at(F.col("u1") + 0.01, F.col("v0")), at(F.col("u1") + 0.01, F.col("v1")), at(F.col("u0") - 0.01, F.col("v1")))
    hole = F.array(at(left, mid), at(right, mid), at(right, top), at(left, top))
    closed = lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), lambda p: F.array(p["x"], p["y"]))
    cut = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(closed(notched), closed(hole)).alias("coordinates")))
    n = F.col("n_nationkey").cast("bigint")
    bare = spark.read.parquet(f"{sf_dir}/nation.parquet").select((-1 - n).alias("farm_id"), F.when(n % 2 == 0, text(slanted(31.0, -19.0, 31.1, -18.9))).alias("boundary"), F.lit(4326).alias("epsg"), (-1 - n).alias("own_id"))
    declared = F.when(k == 2, cut).when(k == 0, text(whole))
    farms = farms.select("farm_id", declared.alias("boundary"), F.lit(4326).alias("epsg"), F.lit(None).cast("bigint").alias("own_id")).unionByName(bare)
    old = rows.where("farm_id % 2 = 0").select((F.col("id") * 10).alias("field_id"), "farm_id", name.alias("canonical_id"), lot_shape(F.when(F.col("id") % 5 == 0, 0.001).otherwise(0.0)).alias("geometry"), F.lit(False).alias("derived"))
    return intake.ingest(farms, fields, old)


def _window():
    from pyspark.sql.window import Window as W

    return W.partitionBy("farm_id")


@query(
    """SELECT l.id AS region_id, concat('region ', l.id) AS name, CASE WHEN l.id % 6 = 5 THEN 'geometry is empty' END AS reason, composition, dominant, CAST(CASE WHEN l.id % 6 <> 5 THEN 1 END AS BIGINT) AS captured FROM lots l
      LEFT JOIN (SELECT id, string_agg(concat(zone, '=', printf('%.4f', share)), ',' ORDER BY share DESC, zone) AS composition, arg_min(zone, (1 - share) * 100 + CASE zone WHEN 'I' THEN 0 WHEN 'II' THEN 1e-6 ELSE 2e-6 END) AS dominant FROM shares GROUP BY 1) s ON s.id = l.id AND l.id % 6 <> 5""",
    lots=LOTS,
    zn=_ZONES.format(n=_N_ZONES, id="n"),
    met=f"SELECT id, zone, {_OVER.format(u0='u0', u1='u1', v0='v0', v1='v1')} / (w * 0.003) AS part FROM lots JOIN zn ON u < u1 AND u0 < u + w AND v < v1 AND v0 < v + 0.003",
    shares="SELECT id, zone, round(part, 4) AS share FROM (SELECT id, zone, sum(part) AS part FROM met GROUP BY id, zone) s QUALIFY part >= 0.01 OR part < 0.01 AND row_number() OVER (PARTITION BY id ORDER BY part DESC, zone) = 1",
)
def drawn_regions(spark, sf_dir):
    """K26, Q-18: regions that analysts draw, around a farm each: their composition and the farms that they capture."""
    rows = lots(spark, sf_dir)
    ring = slanted(F.col("u"), F.col("v"), F.col("u") + F.col("w"), F.col("v") + 0.003)
    text = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.when(F.col("id") % 6 != 5, F.array(F.transform(F.concat(ring, F.slice(ring, 1, 1)), lambda p: F.array(p["x"], p["y"])))).otherwise(F.array()).alias("coordinates")))
    z = spark.sql(_ZONES.replace("t({id})", "AS t(n)").format(n=_N_ZONES)).select("zone", shape(slanted(*map(F.col, ("u0", "v0", "u1", "v1")))).alias("geometry"))
    middle = slanted(F.col("u") + F.col("w") / 2, F.col("v") + 0.0015, F.col("u") + F.col("w"), F.col("v"))[0]
    farms = rows.select("id", middle["x"].alias("lon"), middle["y"].alias("lat"))
    return intake.drawn_regions(rows.select(F.col("id").alias("region_id"), F.concat(F.lit("region "), "id").alias("name"), text.alias("boundary")), z, farms)


@query("SELECT field_id, pass_date, index_name, 'collect:' || field_id || ':' || scene_id || ':v' || geometry_version AS unit, 'collect:field:' || field_id || ':v' || geometry_version AS field_unit FROM analysis")
def work_units(spark, sf_dir):
    """The units of work that collection goes by."""
    a = view(spark, sf_dir, "analysis")
    return a.select("field_id", "pass_date", "index_name", intake.scene_unit(F.col("field_id"), F.col("scene_id"), F.col("geometry_version")).alias("unit"), intake.field_unit(F.col("field_id"), F.col("geometry_version")).alias("field_unit"))


@query(
    "SELECT DISTINCT sha256(printf('%.6f %.6f;%.6f %.6f;%.6f %.6f;%.6f %.6f', x, v, x + 0.0009, v + 0.003, x + w + 0.0009, v + 0.003, x + w, v)) || ':' || index_name || ':1:' || scene_id AS key FROM a JOIN (SELECT *, u + 0.3 * (v + 18) AS x FROM lots) l ON l.id = a.field_id WHERE scene_id % 3 > 0",
    lots=LOTS,
    a="SELECT field_id, index_name, scene_id FROM analysis",
)
def uncomputed_passes(spark, sf_dir):
    """Passes over areas that are not among the results yet, by their keys."""
    # an area's digest is made once, before the join, and not for each of its passes; digests are larger than Spark reckons, so they aren't broadcast
    areas = overlay.dealt(lots(spark, sf_dir), "id").select("id", geometry_key(lot_shape()).alias("area")).hint("merge")
    rows = view(spark, sf_dir, "analysis").join(areas, F.col("field_id") == F.col("id"))
    keyed = rows.select(intake.area_result_key(F.col("area"), F.col("index_name"), F.col("scene_id").cast("string")).alias("key"), "scene_id")
    return intake.uncomputed(keyed, keyed.where("scene_id % 3 = 0")).select("key")
