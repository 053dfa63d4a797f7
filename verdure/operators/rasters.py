"""Rasters as rows against polygons, other resolutions and map tiles.

A raster has rows of keys, px_row, px_col and values. Its grid is a row of the
same keys with x0, y0 (outer corner of pixel 0, 0, in metres), res (metres a
pixel, rows going south), epsg (UTM zone), height and width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdure.functions.columns import colour, composite, index_bands, index_names, steady_mean
from verdure.functions.constants import BAND_RESOLUTION, GRID_PIXELS, PREVIEW_PIXELS
from verdure.operators import planar
from verdure.operators.geo import from_utm, to_utm
from verdure.operators.pixels import analyse

TILE = 256


def grid_size(west: Column, south: Column, east: Column, north: Column, res: Column) -> tuple[Column, Column]:
    """Rows and columns of a grid over a box in degrees, at least 1 and at most GRID_PIXELS."""
    pixels = lambda metres: F.least(F.greatest(F.round(metres / res), F.lit(1)), F.lit(GRID_PIXELS)).cast("int")
    return pixels((north - south) * 111_320.0), pixels((east - west) * 111_320.0 * F.cos(F.radians((south + north) / 2)))


def _near_edges(shapes: DataFrame, keys: list[str], geometry: str) -> DataFrame:
    """For every row of a grid: keys, px_row, epsg, x0, y0, res, edges: a geometry's edges, in degrees, whose latitudes the row's centre line may meet."""
    ring = lambda r: F.arrays_zip(r.alias("a"), F.concat(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1)).alias("b"))
    # a ring wholly beside the grid is crossed an even number of times, or never
    long, high = F.col("width") * F.col("res"), F.col("height") * F.col("res")
    ends = [from_utm(F.col("x0") + i * long, F.col("y0") - j * high, F.col("epsg")) for i in (0, 1) for j in (0, 1)]
    base = shapes.select(*keys, "x0", "y0", "res", "epsg", "height", "width", F.col(geometry).alias("_g"), F.array(*(x for x, _ in ends)).alias("_lon"), F.array(*(y for _, y in ends)).alias("_lat"))
    # rows and columns are bent by less than this on the way between corners
    pad = ((long * long + high * high) / 6_000_000 + 2 * F.col("res")) / 100_000 / F.cos(F.radians(F.array_max(F.transform("_lat", F.abs))))
    box = {f"_{k}": e for k, e in (("w", F.array_min("_lon") - pad), ("e", F.array_max("_lon") + pad), ("s", F.array_min("_lat") - pad), ("n", F.array_max("_lat") + pad))}
    some = lambda r, test: F.exists(r, test)
    met = lambda r: some(r, lambda p: p["x"] >= F.col("_w")) & some(r, lambda p: p["x"] <= F.col("_e")) & some(r, lambda p: p["y"] >= F.col("_s")) & some(r, lambda p: p["y"] <= F.col("_n"))
    # generated, so that no function of a ring's points computes it again
    base = base.select("*", F.inline(F.array(F.struct(*(e.alias(k) for k, e in box.items()))))).withColumn("_g", F.filter(F.flatten("_g"), met))
    base = base.select(*keys, "x0", "y0", "res", "epsg", "height", "width", F.explode(F.flatten(F.transform("_g", ring))).alias("e")).where("e.a.y <> e.b.y")
    # along a parallel the northing changes with the distance from the middle of the zone, by its square; a row and 3 % are spared
    d, wide = F.col("x0") - 500_000, F.col("width") * F.col("res")
    far, near = F.greatest(F.abs(d), F.abs(d + wide)), F.greatest(d, -d - wide, F.lit(0.0))
    bend = lambda lat, by: F.tan(F.radians(lat)) * by * by / 2 / 6_370_000
    spare = lambda lat: F.abs(bend(lat, far)) * 0.03 + F.col("res")
    line = lambda lat, off: (F.col("y0") - to_utm(F.col("epsg") % 100 * 6.0 - 183, lat, F.col("epsg"))[1] - off) / F.col("res") - 0.5
    south, north = F.least("e.a.y", "e.b.y"), F.greatest("e.a.y", "e.b.y")
    first = F.greatest(F.floor(line(north, F.greatest(bend(north, near), bend(north, far)) + spare(north))), F.lit(0))
    last = F.least(F.ceil(line(south, F.least(bend(south, near), bend(south, far)) - spare(south))), F.col("height") - 1)
    rows = base.where(first <= last).select(*keys, "x0", "y0", "res", "epsg", "e", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("px_row"))
    return rows.groupBy(*keys, "px_row", "epsg", "x0", "y0", "res").agg(F.collect_list("e").alias("edges"))


def inside(pixels: DataFrame, shapes: DataFrame, keys: list[str], geometry: str = "geometry") -> DataFrame:
    """pixels with the column inside: whether the geometry of their keys, whose edges are straight in degrees, covers their centre.

    One equi-join by row brings the edges that the row may meet; of these, those
    that the centre's parallel crosses to its east are counted (even-odd).
    """
    lines = _near_edges(shapes, keys, geometry).withColumn("px_row", F.col("px_row").cast(pixels.schema["px_row"].dataType))
    met = pixels.join(lines.select(*keys, "px_row", F.struct("epsg", "x0", "y0", "res", "edges").alias("_line")), [*keys, "px_row"], "left")
    at = lambda c: F.col(f"_line.{c}")
    lon, lat = from_utm(at("x0") + (F.col("px_col") + 0.5) * at("res"), at("y0") - (F.col("px_row") + 0.5) * at("res"), at("epsg"))
    met = met.select("*", F.inline(F.array(F.struct(lon.alias("_lon"), lat.alias("_lat")))))

    def east(e: Column) -> Column:
        a, b = e["a"], e["b"]
        across = (a["y"] > F.col("_lat")) != (b["y"] > F.col("_lat"))
        return across & (a["x"] + (F.col("_lat") - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"]) > F.col("_lon"))

    hit = F.size(F.filter(at("edges"), east)) % 2 == 1
    return met.withColumn("inside", F.coalesce(F.when(at("epsg").isNotNull(), hit), F.lit(False))).drop("_line", "_lon", "_lat")


def by_resolution(names: list[str] | None = None) -> dict[int, list[str]]:
    """Indices by their native resolution, in their given order."""
    out: dict[int, list[str]] = {}
    for n in names or index_names():
        out.setdefault(max(BAND_RESOLUTION[b] for b in index_bands(n)), []).append(n)
    return out


def band_union(names: list[str], composites: bool = False) -> list[str]:
    """The different bands that indices need, sorted; with those of the true and false colour picture."""
    return sorted({b for n in names for b in index_bands(n)} | ({"B08", "B04", "B03", "B02"} if composites else set()))


def analyse_native(fine: DataFrame, coarse: DataFrame, keys: list[str], offset: Column, quantification: Column, names: list[str] | None = None, factor: int = 2) -> DataFrame:
    """Statistics of every index on its own grid, from 10 m bands (fine) and 20 m bands with the scene classes (coarse).

    fine: keys, px_row, px_col, inside and bands in lower case; coarse: the same
    and scl. On the fine grid a pixel takes the class of the coarse pixel it lies
    in (nearest); on the coarse one a fine band is the mean of its block. Pixels whose counterpart is absent
    have no class, or no band, and count as not clear, or null.
    """
    parent = [F.floor(F.col(c) / factor).alias(c) for c in ("px_row", "px_col")]
    have = {r: [b.lower() for b in BAND_RESOLUTION if BAND_RESOLUTION[b] == r and b.lower() in df.columns] for r, df in ((10, fine), (20, coarse))}
    at = [*keys, "px_row", "px_col"]
    classes = coarse.select(*at, "scl").withColumnsRenamed({"px_row": "_r", "px_col": "_c"})
    groups = by_resolution(names)
    out = []
    for res, own in groups.items():
        if res == 10:
            near = fine.withColumns({"_r": F.floor(F.col("px_row") / factor), "_c": F.floor(F.col("px_col") / factor)})
            rows, bands = near.join(classes, [*keys, "_r", "_c"], "left"), have[10]
        else:
            means = fine.select(*keys, *parent, *have[10]).groupBy(*at).agg(*(F.avg(b).alias(b) for b in have[10]))
            rows, bands = coarse.join(means, at, "left"), [*have[10], *have[20]]
        used = {b.upper(): F.col(b) for b in bands if b.upper() in band_union(own)}
        stats = analyse(rows, keys, used, offset, quantification, F.col("scl"), F.col("inside"), own)
        out.append(stats.withColumn("resolution_m", F.lit(res)))
    both = out[0]
    for more in out[1:]:
        both = both.unionByName(more)
    return both


def overview_factor(z: Column, lat: Column, res: Column, size: int = TILE) -> Column:
    """The power of two by which a raster may be reduced before it is drawn at a zoom: its pixels stay no larger than the tile's."""
    metres = 2 * 3.141592653589793 * 6378137 * F.cos(F.radians(lat)) / (size * F.pow(F.lit(2.0), z))
    return F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(metres / res)), F.lit(0))).cast("long")


def _numbers(rows: pa.RecordBatch, size: int) -> tuple[np.ndarray, ...]:
    """Of a batch of a raster's pixels: row, column, side in metres, x0, y0, zone, and the tile pixels around the world at z."""
    row, col, factor, x0, y0, res, epsg, z = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("px_row", "px_col", "factor", "x0", "y0", "res", "epsg", "z"))
    return row, col, factor * res, x0, y0, epsg, size * 2.0**z


def tiles(raster: DataFrame, grids: DataFrame, keys: list[str], zooms: list[int], size: int = TILE, value: str = "value") -> DataFrame:
    """Keys, z, x, y, row, col, value of every tile pixel that has a value at its centre.

    A tile's pixel takes the raster's at its centre (Web Mercator to degrees to
    UTM), in the coarsest overview that is no coarser than the tile. The raster's
    pixels with a value name the few tile pixels around them, and those whose
    centre falls back into them stay: rows are made for values only, and the raster meets nothing but its grid.
    """
    ends = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))).alias("end")
    _, lat = from_utm(F.col("x0") + F.col("end.i") * F.col("width") * F.col("res"), F.col("y0") - F.col("end.j") * F.col("height") * F.col("res"), F.col("epsg"))
    grid = ["x0", "y0", "res", "epsg", "height", "width"]
    south = grids.select(*keys, *grid, ends).withColumn("lat", lat).groupBy(*keys, *grid).agg(F.min("lat").alias("south"))
    g = south.withColumn("z", F.explode(F.array(*map(F.lit, zooms)))).withColumn("factor", overview_factor(F.col("z"), F.col("south"), F.col("res"), size))
    g = g.groupBy(*keys, "factor").agg(F.first(F.struct(*grid)).alias("grid"), F.collect_list("z").alias("zs"))
    cell = [F.floor(F.col(c) / F.col("factor")).cast("long").alias(c) for c in ("px_row", "px_col")]
    source = raster.where(F.col(value).isNotNull()).join(g.select(*keys, "factor"), keys)
    source = source.groupBy(*keys, "factor", *cell).agg(steady_mean(F.col(value), F.col("factor")).alias("value")).where("value IS NOT NULL")
    source = source.join(g, [*keys, "factor"]).select(*keys, "factor", "px_row", "px_col", "value", "grid.*", F.explode("zs").alias("z"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            row, col, side, x0, y0, zone, n = _numbers(rows, size)
            west = np.full(len(n), np.inf)
            box = [west, -west, west, -west]
            for i in (0, 1):
                for j in (0, 1):
                    lon, lat = planar.from_utm(x0 + (col + i) * side, y0 - (row + j) * side, zone)
                    for k, at in ((0, (lon + 180) / 360 * n), (2, (1 - np.arcsinh(np.tan(np.radians(lat))) / np.pi) / 2 * n)):
                        box[k], box[k + 1] = np.minimum(box[k], at), np.maximum(box[k + 1], at)
            # the sides of a pixel are bent by less than this, in pixels of the tile
            pad = 0.05 + (box[1] - box[0]) * side / 1_000_000
            ends = [np.ceil(box[0] - pad - 0.5), np.floor(box[1] + pad - 0.5), np.ceil(box[2] - pad - 0.5), np.floor(box[3] + pad - 0.5)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(e.astype(np.int64)) for e in ends)], [*rows.schema.names, "_x0", "_x1", "_y0", "_y1"])

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            row, col, side, x0, y0, zone, n = _numbers(rows, size)
            gx, gy, res, height, width = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("gx", "gy", "res", "height", "width"))
            lat = np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * (gy + 0.5) / n))))
            e, north = planar.to_utm((gx + 0.5) / n * 360 - 180, lat, zone)
            c, r, factor = np.floor((e - x0) / res), np.floor((y0 - north) / res), side / res
            ok = (c >= 0) & (c < width) & (r >= 0) & (r < height) & (r // factor == row) & (c // factor == col)
            yield rows.filter(pa.array(ok))

    near = source.mapInArrow(around, kinds + ", _x0 bigint, _x1 bigint, _y0 bigint, _y1 bigint").where("_x0 <= _x1 AND _y0 <= _y1")
    near = near.select("*", F.explode(F.sequence("_x0", "_x1")).alias("gx")).select(*source.columns, "gx", F.explode(F.sequence("_y0", "_y1")).alias("gy"))
    met = near.mapInArrow(hit, kinds + ", gx bigint, gy bigint")
    part = lambda c: (F.floor(F.col(c) / size).cast("long"), F.pmod(F.col(c), F.lit(size)).cast("int"))
    (x, col), (y, row) = part("gx"), part("gy")
    return met.select(*keys, "z", x.alias("x"), y.alias("y"), row.alias("row"), col.alias("col"), "value")


def painted(rows: DataFrame, index: str, difference: bool = False, value: str = "value") -> DataFrame:
    """rows with rgba: the colour of the value on the index's ramp, opaque; transparent black where it is null."""
    rgb = colour(index, F.col(value), difference)
    # generated, so that channels that are taken from it do not compute it again
    return rows.select("*", F.inline(F.array(F.struct(F.coalesce(F.concat(rgb, F.array(F.lit(255))), F.array(*map(F.lit, (0, 0, 0, 0)))).alias("rgba")))))


def pictured(pixels: DataFrame, kind: str, bands: dict[str, Column], covered: Column) -> DataFrame:
    """Pixels with rgba of the composite, transparent where a band is null or the area does not cover the pixel."""
    rgb = F.when(covered, composite(kind, bands))
    return pixels.withColumn("rgba", F.coalesce(F.concat(rgb, F.array(F.lit(255))), F.array(*map(F.lit, (0, 0, 0, 0)))))


def preview(raster: DataFrame, grids: DataFrame, keys: list[str], longest: int = PREVIEW_PIXELS, value: str = "value") -> DataFrame:
    """M8, H6: keys, row, col, value of the whole raster, reduced by block means so that its longer side has no more than so many pixels."""
    step = grids.select(*keys, F.ceil(F.greatest("height", "width") / longest).alias("step"))
    met = raster.join(step, keys)
    cell = [F.floor(F.col(c) / F.col("step")).alias(to) for c, to in (("px_row", "row"), ("px_col", "col"))]
    return met.groupBy(*keys, "step", *cell).agg(steady_mean(F.col(value), F.col("step")).alias("value")).drop("step")
