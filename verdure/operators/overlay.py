"""Polygons over polygons.

A geometry is array<array<array<struct<x, y>>>>: polygons of rings (shell, then
holes), in degrees of longitude and latitude. Arrow functions work a batch at a
time on one row's or one pair's geometries; Spark finds the pairs by grid cells
and merges unions as a tree. Areas and distances are metric, on the UTM zone of
the geometry's centroid. Null or empty geometries have no area and overlap with
nothing; a geometry with crossing rings counts even-odd.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from verdure.functions.constants import EDGE_TOLERANCE_M, EQUAL_TOLERANCE, LEAST_AREA_M2, NESTING_TOLERANCE, SLIVER, UTM_EAST, UTM_SPLIT, UTM_WEST
from verdure.operators import planar
from verdure.operators.lineage import checkpointed
from verdure.operators.planar import Geometry

MULTI = "array<array<array<struct<x:double,y:double>>>>"
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
#: Geometries that are merged at once.
BRANCH = 16
CELL = 0.01
#: Cells of a geometry at most; larger ones use coarser cells.
MOST_CELLS = 256


def geometries(column: pa.Array) -> list[Geometry | None]:
    """The rows of an Arrow column; null points and rings are left out."""
    out: list[Geometry | None] = []
    rings = column.values
    points = rings.values
    outer, middle, inner = (a.offsets.to_numpy() for a in (column, rings, points))
    flat = points.values
    xy = np.column_stack([flat.field(i).to_numpy(zero_copy_only=False).astype(float) for i in (0, 1)]) if len(flat) else np.zeros((0, 2))
    for k, valid in enumerate(column.is_valid().to_pylist()):
        out.append([[planar.opened(r[~np.isnan(r).any(axis=1)]) for j in range(middle[i], middle[i + 1]) for r in [xy[inner[j] : inner[j + 1]]]] for i in range(outer[k], outer[k + 1])] if valid else None)
    return [None if g is None else [q for q in ([r for r in p if len(r)] for p in g) if q] for g in out]


def packed(rows: list[Geometry | None]) -> pa.Array:
    """The inverse of geometries; rings are closed."""
    closed = [[[np.vstack([r, r[:1]]) for r in p] for p in g] if g is not None else [] for g in rows]
    rings = [r for g in closed for p in g for r in p]
    xy = np.concatenate([np.zeros((0, 2)), *rings])
    ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32))
    flat = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], fields=list(_POINT))
    inner = pa.ListArray.from_arrays(ends([len(r) for r in rings]), flat)
    middle = pa.ListArray.from_arrays(ends([len(p) for g in closed for p in g]), inner)
    return pa.ListArray.from_arrays(ends([len(g) for g in closed]), middle, mask=pa.array([g is None for g in rows]))


def boxes(x: np.ndarray, y: np.ndarray) -> pa.Array:
    """Geometries of one ring each, whose points, closed, are the rows of x and y."""
    n, points = x.shape
    ends = lambda step: pa.array(np.arange(n + 1, dtype=np.int32) * step)
    flat = pa.StructArray.from_arrays([pa.array(x.ravel()), pa.array(y.ravel())], fields=list(_POINT))
    ring = pa.ListArray.from_arrays(ends(points), flat)
    return pa.ListArray.from_arrays(ends(1), pa.ListArray.from_arrays(ends(1), ring))


def zone_of(lon: float) -> int:
    return UTM_EAST if lon >= UTM_SPLIT else UTM_WEST


def projected(g: Geometry, zone: int) -> Geometry:
    return [[np.column_stack(planar.to_utm(r[:, 0], r[:, 1], zone)) for r in p] for p in g]


def metres2(g: Geometry | None) -> float:
    """Area on the zone of the centroid."""
    c = planar.centroid(g) if g else None
    return planar.area(projected(g, zone_of(c[0]))) if c else 0.0


def _both(s: np.ndarray) -> np.ndarray:
    return s[0] & s[1]


def _either(s: np.ndarray) -> np.ndarray:
    return s.any(axis=0)


def _first(s: np.ndarray) -> np.ndarray:
    return s[0] & ~s[1]


def _one(s: np.ndarray) -> np.ndarray:
    return s[0] ^ s[1]


def _shape(rule: Callable, *columns: Column) -> Column:
    def run(*arrays: pa.Array) -> pa.Array:
        return packed([planar.shape_where([g or [] for g in row], rule) for row in zip(*map(geometries, arrays), strict=True)])

    return F.arrow_udf(_annotated(run, len(columns)), MULTI)(*columns)


def _annotated(run: Callable, n: int) -> Callable:
    """run with n named Arrow parameters, by which Spark tells the kind of function."""
    if n == 1:

        def one(a: pa.Array) -> pa.Array:
            return run(a)

        return one

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return run(a, b)

    return two


def intersection(a: Column, b: Column) -> Column:
    return _shape(_both, a, b)


def union(a: Column, b: Column) -> Column:
    return _shape(_either, a, b)


def difference(a: Column, b: Column) -> Column:
    return _shape(_first, a, b)


def area_m2(g: Column) -> Column:
    """Square metres; 0 without any."""
    return F.arrow_udf(_annotated(lambda a: pa.array(list(map(metres2, geometries(a))), pa.float64()), 1), "double")(g)


def centroid(g: Column) -> Column:
    """struct(x, y), null without an area."""

    def run(a: pa.Array) -> pa.Array:
        found = [planar.centroid(x) if x else None for x in geometries(a)]
        return pa.array([None if c is None else {"x": c[0], "y": c[1]} for c in found], _POINT)

    return F.arrow_udf(_annotated(run, 1), "x double, y double")(g)


def _outside(field: Geometry | None, farm: Geometry | None) -> float:
    whole = metres2(field)
    return metres2(planar.shape_where([field, farm or []], _first)) / whole if whole > 0 else 1.0


def outside_share(field: Column, farm: Column) -> Column:
    """Share of a geometry's area outside another; 1 if it has no area."""
    return F.arrow_udf(_annotated(lambda a, b: pa.array([_outside(f, g) for f, g in zip(geometries(a), geometries(b), strict=True)], pa.float64()), 2), "double")(field, farm)


def _equal(a: Geometry | None, b: Geometry | None) -> bool:
    if not a or not b:
        return not a and not b
    larger = max(metres2(a), metres2(b))
    return larger <= 0 or metres2(planar.shape_where([a, b], _one)) / larger <= EQUAL_TOLERANCE


def equivalent(a: Column, b: Column) -> Column:
    """whether two geometries differ in no more than a small share of the larger; two empty ones are equal."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        found = _decided(x, y)
        left = [i for i, known in enumerate(found) if known is None]
        if left:
            at = pa.array(left, pa.int64())
            for i, a, b in zip(left, geometries(x.take(at)), geometries(y.take(at)), strict=True):
                found[i] = _equal(a, b)
        return pa.array(found, pa.bool_())

    return F.arrow_udf(_annotated(run, 2), "boolean")(a, b)


def from_geojson(text: Column) -> tuple[Column, Column]:
    """The type and the geometry of a GeoJSON geometry, a polygon as a multi-polygon of one; null where its coordinates can't be read."""
    kind = F.get_json_object(text, "$.type")
    at = F.get_json_object(text, "$.coordinates")
    ring = "array<array<double>>"
    point = lambda p: F.when(F.size(p) >= 2, F.struct(p[0].alias("x"), p[1].alias("y")))
    polygon = lambda rings: F.transform(rings, lambda r: F.transform(r, point))
    one, many = F.from_json(at, f"array<{ring}>"), F.from_json(at, f"array<array<{ring}>>")
    return kind, F.when((kind == "Polygon") & one.isNotNull(), F.when(F.size(one) > 0, F.array(polygon(one))).otherwise(F.array())).when(kind == "MultiPolygon", F.transform(many, polygon)).cast(MULTI)


def to_geojson(g: Column) -> Column:
    """A geometry as GeoJSON text, a MultiPolygon."""
    points = F.transform(g, lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.array(q["x"], q["y"]))))
    return F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), points.alias("coordinates")))


def _checked(g: Geometry | None, sizes_ok: bool, epsg: int, least_m2: float) -> dict:
    bad = lambda why: {"ok": False, "reason": why, "repaired": False, "warning": None, "geometry": None, "area_m2": None}
    if g is None or not sizes_ok:
        return bad("unparseable geometry")
    if not g:
        return bad("geometry is empty")
    why = planar.flaw(g)
    if why:
        healed = planar.shape_where([g], lambda s: s[0])
        if not healed:
            return bad(f"unrepairable geometry: {why}")
        g = healed
    if epsg in (UTM_EAST, UTM_WEST):
        g = [[np.column_stack(planar.from_utm(r[:, 0], r[:, 1], epsg)) for r in p] for p in g]
    m2 = metres2(g)
    if m2 < least_m2:
        return bad(f"geometry area below {least_m2} m² (degenerate)")
    return {"ok": True, "reason": None, "repaired": bool(why), "warning": f"geometry repaired (was invalid: {why})" if why else None, "geometry": g, "area_m2": m2}


_CHECKED = f"ok boolean, reason string, repaired boolean, warning string, geometry {MULTI}, area_m2 double"


def validated(kind: Column, g: Column, epsg: Column, least_m2: float = LEAST_AREA_M2) -> Column:
    """Struct of ok, reason, repaired, warning, geometry (in degrees) and area_m2.

    Only polygons and multi-polygons pass. Crossing, touching and overlapping
    rings are rebuilt even-odd and flagged; what stays empty or under least_m2
    is refused. epsg: 4326, or a UTM zone, from which it is reprojected.
    """
    closed = lambda r: F.size(r) + F.when(r[0] != F.element_at(r, -1), 1).otherwise(0)
    short = F.exists(g, lambda p: F.exists(p, lambda r: F.when(F.size(r) > 0, closed(r) < 4).otherwise(False)))

    def run(a: pa.Array, sizes: pa.Array, zones: pa.Array) -> pa.Array:
        rows = [_checked(x, not s, z, least_m2) for x, s, z in zip(geometries(a), sizes.to_pylist(), zones.to_pylist(), strict=True)]
        columns = [pa.array([r[c] for r in rows], t) for c, t in (("ok", pa.bool_()), ("reason", pa.string()), ("repaired", pa.bool_()), ("warning", pa.string()))]
        columns += [packed([r["geometry"] for r in rows]), pa.array([r["area_m2"] for r in rows], pa.float64())]
        return pa.StructArray.from_arrays(columns, names=["ok", "reason", "repaired", "warning", "geometry", "area_m2"])

    found = F.arrow_udf(run, _CHECKED)(g, F.coalesce(short, F.lit(False)), epsg.cast("int"))
    refused = F.concat(F.lit("geometry must be polygonal, got "), F.coalesce(F.concat(F.lit("'"), kind, F.lit("'")), F.lit("None")))
    other = F.struct(F.lit(False).alias("ok"), refused.alias("reason"), F.lit(False).alias("repaired"), F.lit(None).cast("string").alias("warning"), F.lit(None).cast(MULTI).alias("geometry"), F.lit(None).cast("double").alias("area_m2"))
    return F.when(F.coalesce(kind.isin("Polygon", "MultiPolygon"), F.lit(False)), found).otherwise(other)


def box(g: Column) -> Column:
    """Struct of the least and greatest coordinates."""
    points = F.flatten(F.flatten(g))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def union_by(rows: DataFrame, keys: list[str], geometry: str = "geometry", branch: int = BRANCH) -> DataFrame:
    """Keys, the union of a key's geometries, and how many it had; null and empty ones are skipped, keys without any stay, with null.

    A tree: a key's different geometries are dealt by hash to groups of about
    branch, each merged for itself, and their unions again, until each key has
    one. So a key with a third of all geometries is merged in many tasks.
    """
    kind = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys]
    base = rows.select(*keys, F.col(geometry).alias("g"))
    sizes = base.groupBy(*keys).agg(F.count_if(F.size("g") > 0).alias("n_geometries"))
    rest = -(-(sizes.agg(F.max("n_geometries")).first()[0] or 0) // branch)
    names = [f"_{k}" for k in keys]
    parts = sizes.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.ceil(F.col("n_geometries") / branch).alias("parts"))
    now = base.where(F.size("g") > 0).distinct()
    now = now.join(parts, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)])
    now = now.select(*keys, "g", F.pmod(F.xxhash64("g"), F.col("parts")).alias("at"))

    def merge(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        gs = [g for c in part.column("g").chunks for g in geometries(c)]
        out = packed([gs[0] if len(gs) == 1 and not planar.flaw(gs[0]) else planar.shape_where(gs, _either)])
        return pa.table({**{k: pa.array([v.as_py()], v.type) for k, v in zip(keys, key, strict=False)}, "at": pa.array([key[-1].as_py()], pa.int64()), "g": out})

    while True:
        now = now.groupBy(*keys, "at").applyInArrow(merge, ", ".join([*kind, "at bigint", f"g {MULTI}"]))
        if rest <= 1:
            break
        rest, now = -(-rest // branch), now.withColumn("at", F.floor(F.col("at") / branch))
    now = now.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col("g").alias(geometry))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    return sizes.join(now, same, "left").select(*keys, geometry, "n_geometries")


def farm_boundaries(farms: DataFrame, fields: DataFrame) -> DataFrame:
    """farm_id, boundary, derived of every farm: the declared boundary, else the union of its fields; a farm with neither has null."""
    bare = fields.join(farms.where("boundary IS NULL").select("farm_id"), "farm_id", "left_semi")
    built = union_by(bare, ["farm_id"], "geometry").select("farm_id", F.col("geometry").alias("_union"))
    out = farms.join(built, "farm_id", "left")
    return out.select("farm_id", F.coalesce("boundary", "_union").alias("boundary"), (F.col("boundary").isNull() & F.col("_union").isNotNull()).alias("derived"))


def nesting(fields: DataFrame, farms: DataFrame, tolerance: float = NESTING_TOLERANCE) -> DataFrame:
    """Each field (id, farm_id, geometry) with its share outside its farm (farm_id, boundary, derived) and whether that is tolerated.

    Against a boundary that was built from the fields nothing is checked; without a boundary both are null.
    """
    met = fields.join(farms.select("farm_id", "boundary", "derived"), "farm_id", "left")
    share = F.when(F.col("boundary").isNotNull() & ~F.col("derived"), outside_share(F.col("geometry"), F.col("boundary")))
    return met.select("id", "farm_id", F.when(F.col("derived"), 0.0).otherwise(share).alias("outside")).withColumn("nested", F.col("outside") <= tolerance)


def _cells(b: Column) -> Column:
    """Grid cells that a box touches, with their size: the least multiple by powers of four that keeps them to MOST_CELLS."""
    wide = F.greatest(b["x1"] - b["x0"], b["y1"] - b["y0"], F.lit(1e-9))
    level = F.greatest(F.ceil(F.log(wide / (CELL * (MOST_CELLS**0.5 - 1))) / F.log(F.lit(4.0))), F.lit(0)).cast("int")
    size = F.lit(CELL) * F.pow(F.lit(4.0), level)
    span = lambda lo, hi: F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))
    return F.flatten(F.transform(span(b["x0"], b["x1"]), lambda i: F.transform(span(b["y0"], b["y1"]), lambda j: F.struct(level.alias("level"), i.alias("i"), j.alias("j")))))


def _met(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Pairs of rows of a (with box abox) and b (bbox) whose boxes touch, each once.

    Rows stand in cells of their own size. For each size that either side has
    (few: they grow four-fold), both sides' cells are brought to the coarser one.
    """
    own, other = (df.withColumn("_cells", _cells(F.col(c))).withColumn("_own", F.get("_cells", F.lit(0))["level"]) for df, c in ((a, "abox"), (b, "bbox")))
    both = {0} | {r[0] for r in own.select("_own").union(other.select("_own")).distinct().collect()}
    levels = F.explode(F.filter(F.array(*map(F.lit, sorted(both))), lambda x: x >= F.col("_own"))).alias("_level")
    up = lambda v: F.floor(v / F.pow(F.lit(4.0), F.col("_level") - F.col("_own"))).cast("long")
    cells = F.explode(F.array_distinct(F.transform("_cells", lambda c: F.struct(F.col("_level").alias("_level"), up(c["i"]).alias("i"), up(c["j"]).alias("j"))))).alias("_cell")
    side = []
    for df, c in ((own, "_atl"), (other, "_btl")):
        rest = [x for x in df.columns if x not in ("_cells", "_own")]
        side.append(df.select(*rest, "_cells", "_own", levels).select(*rest, F.col("_own").alias(c), cells))
    met = side[0].join(side[1], [*(keys or []), "_cell"]).where(F.col("_cell._level") == F.greatest("_atl", "_btl"))
    first = lambda x: F.floor(F.greatest(F.col(f"abox.{x}0"), F.col(f"bbox.{x}0")) / (F.lit(CELL) * F.pow(F.lit(4.0), F.col("_cell._level")))).cast("long")
    touch = " AND ".join(f"abox.{x}0 <= bbox.{x}1 AND bbox.{x}0 <= abox.{x}1" for x in "xy")
    # of the cells that both touch, the one with the corner of what the boxes share keeps the pair
    return met.where(touch).where((F.col("_cell.i") == first("x")) & (F.col("_cell.j") == first("y"))).drop("_cell", "_atl", "_btl")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df, dealt out to all tasks: what follows is dear for each row, however few bytes that is."""
    return df.repartition(_tasks(df), *keys)


def _shape_key(g: Column) -> Column:
    """Digest of a geometry's points as they stand."""
    return F.sha2(F.to_json(g), 256)


def composition(boundaries: DataFrame, zones: DataFrame) -> DataFrame:
    """J11, Q-18: the zones that each boundary (id, geometry) overlaps, as shares of its area, and the dominant one.

    zones: (zone, geometry), any number of rows a zone, whose shares add up.
    Zones under SLIVER are dropped unless all are, then the largest stays.
    Shares are of UTM areas, the boundary's whole counting what lies outside all zones; dominant is the
    largest rounded share, ties to the first name. Boundaries without overlap have no row.
    Boundaries of one shape are laid over the zones once.
    """

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(geometries(a), geometries(b), strict=True):
            middle = planar.centroid(x) if x else None
            parts = [projected(g, zone_of(middle[0])) for g in (x, y or [])] if middle else None
            both, whole = planar.area_where(parts, _both, lambda s: s[0]) if parts else (0.0, 0.0)
            out.append(both / whole if whole > 0 else 0.0)
        return pa.array(out, pa.float64())

    share = F.arrow_udf(_annotated(run, 2), "double").asNondeterministic()  # else the filter on it would compute it again
    named = boundaries.select("id", _shape_key(F.col("geometry")).alias("shape"), F.col("geometry").alias("ga"))
    a = named.groupBy("shape").agg(F.first("ga").alias("ga")).withColumn("abox", box(F.col("ga"))).where("abox.x0 IS NOT NULL")
    b = zones.select("zone", F.col("geometry").alias("gb"), box(F.col("geometry")).alias("bbox")).where("bbox.x0 IS NOT NULL")
    # overlay is dear: its pairs are dealt out evenly, however few rows they are
    tasks = _tasks(boundaries)
    met = _met(a, b).repartition(tasks, "shape", "zone").select("shape", "zone", share("ga", "gb").alias("share")).where("share > 0").groupBy("shape", "zone").agg(F.sum("share").alias("share"))
    met = named.select("id", "shape").join(met, "shape").groupBy("id", "zone").agg(F.sum("share").alias("share"))
    met = met.withColumn("_top", F.row_number().over(W.partitionBy("id").orderBy(F.desc("share"), "zone")))
    kept = met.where((F.col("share") >= SLIVER) | (F.col("_top") == 1) & (F.col("share") < SLIVER)).withColumn("share", F.round("share", 4))
    best = F.row_number().over(W.partitionBy("id").orderBy(F.desc("share"), "zone")) == 1
    return kept.select("id", "zone", "share", best.alias("dominant"))


def _gap(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Each point's distance from the nearest of the edges."""
    d = e[:, 2:] - e[:, :2]
    t = np.clip(((x[:, None] - e[:, 0]) * d[:, 0] + (y[:, None] - e[:, 1]) * d[:, 1]) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
    return np.hypot(e[:, 0] + t * d[:, 0] - x[:, None], e[:, 1] + t * d[:, 1] - y[:, None]).min(axis=1, initial=np.inf)


def _near_border(x: np.ndarray, y: np.ndarray, g: Geometry, tolerance_m: float) -> list[bool | None]:
    """Of each point: None where the geometry, edges included, does not cover it, else whether its border lies within so many metres."""
    out: list[bool | None] = [None] * len(x)
    e = planar.edges(g)
    step = max(1, planar.CELLS // max(1, len(e)))
    for i in range(0, len(x), step):
        px, py = x[i : i + step], y[i : i + step]
        with np.errstate(divide="ignore", invalid="ignore"):
            right = ((e[:, 1] > py[:, None]) != (e[:, 3] > py[:, None])) & (e[:, 0] + (py[:, None] - e[:, 1]) * (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1]) > px[:, None])
        covered = (right.sum(axis=1) % 2 == 1) | (_gap(e, px, py) <= 1e-12)
        for zone in (UTM_EAST, UTM_WEST):
            mine = np.flatnonzero(covered & ((px >= UTM_SPLIT) == (zone == UTM_EAST)))
            if len(mine):
                m = np.column_stack([*planar.to_utm(e[:, 0], e[:, 1], zone), *planar.to_utm(e[:, 2], e[:, 3], zone)])
                for j, near in zip(mine.tolist(), (_gap(m, *planar.to_utm(px[mine], py[mine], zone)) <= tolerance_m).tolist(), strict=True):
                    out[i + j] = near
    return out


def assign(points: DataFrame, regions: DataFrame, tolerance_m: float = EDGE_TOLERANCE_M) -> DataFrame:
    """The region (region_id, geometry) that covers each point (id, lon, lat), ties to the least id, and whether its border is near.

    Points meet regions by grid cells; distances are metres on the point's UTM
    zone. region_id is never null and names one geometry. Points outside all regions, and points without a place, have null.
    """

    def run(px: pa.Array, py: pa.Array, region: pa.Array, g: pa.Array) -> pa.Array:
        # points of one region are worked on together
        x, y, out = px.to_numpy(zero_copy_only=False), py.to_numpy(zero_copy_only=False), np.full(len(px), None, object)
        which = region.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        for r in np.unique(which):
            rows = np.flatnonzero(which == r)
            out[rows] = _near_border(x[rows], y[rows], geometries(g.take(pa.array(rows[:1])))[0] or [], tolerance_m)
        return pa.array(out.tolist(), pa.bool_())

    a = points.where("lon IS NOT NULL AND lat IS NOT NULL").select("lon", "lat").distinct().select("lon", "lat", F.struct(F.col("lon").alias("x0"), F.col("lat").alias("y0"), F.col("lon").alias("x1"), F.col("lat").alias("y1")).alias("abox"))
    # of regions of one shape the least takes all
    b = regions.groupBy(_shape_key(F.col("geometry")).alias("shape")).agg(F.min("region_id").alias("region_id"), F.first("geometry").alias("geometry")).drop("shape")
    b = b.withColumn("bbox", box(F.col("geometry"))).where("bbox.x0 IS NOT NULL")
    found = _met(a, b).select("lon", "lat", "region_id", F.arrow_udf(run, "boolean").asNondeterministic()("lon", "lat", "region_id", "geometry").alias("near")).where("near IS NOT NULL")
    first = found.groupBy("lon", "lat").agg(F.min_by(F.struct("region_id", "near"), "region_id").alias("m"))
    return points.join(first, ["lon", "lat"], "left").select("id", "lon", "lat", "m.region_id", F.col("m.near").alias("boundary_adjacent"))


def match_fields(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """F9, F12, Q-13: the stored field that each incoming one is, one to one, and what becomes of it.

    incoming: (id, farm_id, canonical_id, geometry, derived), in the order of id;
    stored: (field_id, farm_id, canonical_id, geometry, derived). Within a farm a
    canonical id finds the stored field with it, and nothing else; a field without
    one the least stored one without, not yet taken, of an equivalent boundary; a
    field derived from its farm the stored derived one. The first incoming one
    takes a match. action: created, derived_from_farm, unchanged, updated_geometry.
    """
    new = incoming.select("id", "farm_id", "canonical_id", F.col("geometry").alias("ga"), F.coalesce("derived", F.lit(False)).alias("derived"))
    old = stored.select("field_id", "farm_id", F.col("canonical_id").alias("its_id"), F.col("geometry").alias("gb"), F.coalesce("derived", F.lit(False)).alias("was_derived"))
    named = new.where("canonical_id IS NOT NULL AND NOT derived").join(old, "farm_id").where("canonical_id = its_id")
    own = new.where("derived").join(old.where("was_derived"), "farm_id")
    sure = named.unionByName(own).select("id", "field_id", F.lit(False).alias("same"))  # same: already known to be equivalent

    a = new.where("canonical_id IS NULL AND NOT derived").withColumn("abox", box(F.col("ga")))
    b = old.where("its_id IS NULL").withColumn("bbox", box(F.col("gb")))
    near = _met(a.where("abox.x0 IS NOT NULL").select("id", "farm_id", "ga", "abox"), b.where("bbox.x0 IS NOT NULL").select("field_id", "farm_id", "gb", "bbox"), ["farm_id"])
    near = near.where(equivalent(F.col("ga"), F.col("gb"))).select("id", "field_id", F.lit(True).alias("same"))
    pairs, taken = checkpointed(sure.unionByName(near)), None
    # the first of the incoming that want a stored field has it for sure if it wants no lesser one
    while True:
        best = pairs.withColumns({"f": F.min("field_id").over(W.partitionBy("id")), "i": F.min("id").over(W.partitionBy("field_id"))}).where("f = field_id AND i = id")
        best = checkpointed(best.select("id", "field_id", "same"))
        taken = best if taken is None else taken.unionByName(best)
        pairs = checkpointed(pairs.join(best.select("id"), "id", "left_anti").join(best.select("field_id"), "field_id", "left_anti"))
        if pairs.isEmpty():
            break
    out = new.join(taken, "id", "left").join(old.select("field_id", "gb"), "field_id", "left")
    # boundaries that are known to be equivalent, and those of fields without a match, are not compared
    open_ = ~F.coalesce("same", F.lit(True))
    same = equivalent(F.when(open_, F.col("ga")), F.when(open_, F.col("gb")))
    action = F.when(F.col("field_id").isNull(), F.when(F.col("derived"), "derived_from_farm").otherwise("created")).when(same, "unchanged").otherwise("updated_geometry")
    return out.select("id", "farm_id", "field_id", action.alias("action"))


#: Areas in square degrees stand for metric ones where shapes are this small (degrees) and near, up to this share.
_SMALL, _SURE = 0.1, 0.02


def _drift(column: pa.Array) -> tuple[list[float], list[bool], list[float]]:
    """Of each geometry: its area in square degrees (nan if unknown), whether it is convex, and the area swept from the row before to it (inf if unknown).

    Known are small single rings near the two zones. The area swept between rings of as many
    points, point by point, bounds what they differ in, and such bounds add up along a chain.
    """
    n = len(column)
    sizes, convex, steps = np.full(n, np.nan), np.zeros(n, bool), np.full(n, np.inf)
    rings, points = column.values, column.values.values
    outer, middle, inner = (a.offsets.to_numpy() for a in (column, rings, points))
    lo = inner[middle[outer[:-1]]]
    ends = inner[middle[outer[1:]]]
    single = (np.diff(outer) == 1) & (middle[outer[1:]] - middle[outer[:-1]] == 1)
    xy = np.column_stack([points.values.field(i).to_numpy(zero_copy_only=False).astype(float) for i in (0, 1)])
    several = np.flatnonzero(single & (ends - lo > 1))
    ends[several] -= (xy[lo[several]] == xy[ends[several] - 1]).all(axis=1)  # closed rings are opened
    for k in np.unique((ends - lo)[single]).tolist():
        if k < 3:
            continue
        rows = np.flatnonzero(single & (ends - lo == k))
        p = xy[lo[rows][:, None] + np.arange(k)]
        low, high = p.min(axis=1), p.max(axis=1)
        fine = (high - low <= _SMALL).all(axis=1) & (np.abs(p[..., 1]).max(axis=1) <= 45) & (low[:, 0] >= 24) & (high[:, 0] <= 36)
        q = p - p[:, :1]
        d, e = np.roll(q, -1, axis=1) - q, np.roll(q, -2, axis=1) - np.roll(q, -1, axis=1)
        turn, ahead = d[..., 0] * e[..., 1] - d[..., 1] * e[..., 0], (d * e).sum(axis=2)
        round_once = np.abs(np.abs(np.arctan2(turn, ahead).sum(axis=1)) - 2 * np.pi) < 1e-6
        twice = (q[..., 0] * np.roll(q[..., 1], -1, axis=1) - np.roll(q[..., 0], -1, axis=1) * q[..., 1]).sum(axis=1)
        sizes[rows] = np.where(fine, np.abs(twice) / 2, np.nan)
        convex[rows] = fine & round_once & ((turn > 0).all(axis=1) | (turn < 0).all(axis=1))
        after = np.flatnonzero(np.diff(rows) == 1) + 1
        a, b = p[after - 1], p[after]
        a1, b1 = np.roll(a, -1, axis=1), np.roll(b, -1, axis=1)
        half = lambda s, t, u: np.abs((t - s)[..., 0] * (u - s)[..., 1] - (t - s)[..., 1] * (u - s)[..., 0]) / 2
        steps[rows[after]] = np.where(fine[after] & fine[after - 1], (half(a, a1, b1) + half(a, b1, b)).sum(axis=1), np.inf)
    return sizes.tolist(), convex.tolist(), steps.tolist()


def _decided(x: pa.Array, y: pa.Array) -> list[bool | None]:
    """Whether rows of x and y are equivalent, where bounds tell it without laying one over the other; else None.

    The area swept from one to the other bounds the difference from above, the areas of convex ones bound it from below.
    """
    n = len(x)
    if not n or y.type != x.type:
        return [None] * n
    sizes, convex, steps = map(np.array, _drift(pa.concat_arrays([x, y]).take(pa.array(np.arange(2 * n).reshape(2, n).T.ravel()))))
    a, b, swept = sizes[::2], sizes[1::2], steps[1::2]
    most = EQUAL_TOLERANCE * np.maximum(a, b)  # nan where an area is not known, which compares as false
    same, other = swept <= most * (1 - _SURE), convex[::2] & convex[1::2] & (np.abs(a - b) > most * (1 + _SURE))
    return [True if s else False if o else None for s, o in zip(same.tolist(), other.tolist(), strict=True)]


def boundary_versions(seen: DataFrame) -> DataFrame:
    """field_id, version (from 1), geometry, valid_from, valid_to from observations (field_id, at, geometry) in order of at.

    A version opens where the boundary is no longer equivalent to that of the
    last version, so a slow drift opens one once it adds up. A task walks through its
    fields' observations in order and keeps one boundary at a time; only where bounds leave it open are two laid over each other. Observations without a geometry are passed over.
    """
    kinds = dict(seen.dtypes)

    def walk(batches):
        field, kept, version, size, moved = None, None, 0, (0.0, False), 0.0
        for batch in batches:
            column = batch.column("geometry")
            one = lambda i: geometries(column.take(pa.array([i])))[0]  # noqa: E731, B023
            sizes, convex, steps = _drift(column)
            keep, numbers, last = [], [], 0
            for i, key in enumerate(batch.column("field_id").to_pylist()):
                fresh, area = key != field or version == 0, sizes[i]
                # what was swept since the kept boundary bounds the difference from above, areas of convex ones from below
                moved, most = moved + steps[i], EQUAL_TOLERANCE * (max(area, size[0]) if not fresh else 0.0)
                if fresh:
                    equal = False
                elif moved <= most * (1 - _SURE):
                    equal = True
                elif convex[i] and size[1] and abs(area - size[0]) > most * (1 + _SURE):
                    equal = False
                else:
                    kept = one(last) if kept is None else kept
                    equal = _equal(kept, one(i))
                if not equal:
                    field, kept, version, size, moved, last = key, None, 1 if fresh else version + 1, (area, convex[i]), 0.0, i
                    keep.append(i)
                    numbers.append(version)
            if version and kept is None:
                kept = one(last)
            if keep:
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(keep)).columns, pa.array(numbers, pa.int32())], names=["field_id", "at", "geometry", "version"])

    rows = seen.where(F.size("geometry") > 0).select("field_id", "at", "geometry").repartition("field_id").sortWithinPartitions("field_id", "at")
    opened = rows.mapInArrow(walk, f"field_id {kinds['field_id']}, at {kinds['at']}, geometry {MULTI}, version int")
    until = F.lead("at").over(W.partitionBy("field_id").orderBy("version"))
    return opened.select("field_id", "version", "geometry", F.col("at").alias("valid_from"), until.alias("valid_to"))
