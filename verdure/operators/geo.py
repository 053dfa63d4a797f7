"""Rings and geometries in column expressions: area, bounds, keys, projection.

A ring is array<struct<x: double, y: double>>; the last point may repeat the first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdure.functions.constants import KEY_DECIMALS

def _edges(ring: Column) -> Column:
    """Array of (a, b): the ring's edges, closed."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    return F.arrays_zip(F.slice(closed, F.lit(1), F.size(ring)).alias("a"), F.slice(closed, F.lit(2), F.size(ring)).alias("b"))


def area(ring: Column) -> Column:
    """Area of a simple ring in its own units."""
    return F.abs(F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def bounds(ring: Column) -> Column:
    """Struct of the least and greatest coordinates."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def _bound(value: Column, function) -> Column:
    """function of a value that is computed once."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def canonical(ring: Column) -> Column:
    """The ring with rounded coordinates, not closed, from its least point towards the lesser of that one's neighbours."""
    rounded = F.transform(ring, lambda p: F.struct((F.round(p["x"], KEY_DECIMALS) + 0.0).alias("x"), (F.round(p["y"], KEY_DECIMALS) + 0.0).alias("y")))
    opened = _bound(rounded, lambda r: F.when((F.size(r) > 1) & (F.get(r, F.lit(0)) == F.get(r, F.size(r) - 1)), F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r))

    def turned(r: Column) -> Column:
        at = F.array_position(r, F.array_min(r)).cast("int")
        return F.concat(F.slice(r, at, F.size(r)), F.slice(r, F.lit(1), at - 1))

    def wound(r: Column) -> Column:
        return F.when(F.get(r, F.lit(1)) > F.get(r, F.size(r) - 1), F.concat(F.slice(r, 1, 1), F.reverse(F.slice(r, F.lit(2), F.size(r))))).otherwise(r)

    return F.when(F.size(ring) > 0, _bound(_bound(opened, turned), wound))


def boundary_key(ring: Column) -> Column:
    """Digest of a ring that neither its first point nor its direction nor its closing point changes. Empty or null: null."""
    return F.sha2(_ring_text(ring), 256)


def _ring_text(ring: Column) -> Column:
    return F.array_join(F.transform(canonical(ring), lambda p: F.format_string(f"%.{KEY_DECIMALS}f %.{KEY_DECIMALS}f", p["x"], p["y"])), ";")


def geometry_key(g: Column) -> Column:
    """Digest of polygons with holes; neither their order, that of holes, nor how a ring is written changes it. Empty or null: null."""
    polygon = lambda p: F.array_join(F.concat(F.array(_ring_text(p[0])), F.array_sort(F.transform(F.slice(p, F.lit(2), F.size(p)), _ring_text))), "|")
    return F.when(F.size(g) > 0, F.sha2(F.array_join(F.array_sort(F.transform(g, polygon)), "/"), 256))


def to_utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing on a southern UTM zone (EPSG 327xx), by the series of sixth order in the third flattening."""
    f = 1 / 298.257223563
    n, e = f / (2 - f), (f * (2 - f)) ** 0.5
    a = 6378137 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    d, s = F.radians(lon - ((zone % 100) * 6 - 183)), F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    x, y = F.atanh(F.sin(d) / F.sqrt(1 + t * t)), F.atan2(t, F.cos(d))
    east = x + sum((k * F.cos(2 * j * y) * F.sinh(2 * j * x) for j, k in enumerate(alpha, 1)), F.lit(0.0))
    north = y + sum((k * F.sin(2 * j * y) * F.cosh(2 * j * x) for j, k in enumerate(alpha, 1)), F.lit(0.0))
    return 500_000 + 0.9996 * a * east, 10_000_000 + 0.9996 * a * north


def from_utm(east: Column, north: Column, zone: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a position on a southern UTM zone, the inverse of to_utm."""
    f = 1 / 298.257223563
    n, e = f / (2 - f), (f * (2 - f)) ** 0.5
    a = 6378137 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    y, x = (north - 10_000_000) / (0.9996 * a), (east - 500_000) / (0.9996 * a)
    v = y - sum((k * F.sin(2 * j * y) * F.cosh(2 * j * x) for j, k in enumerate(beta, 1)), F.lit(0.0))
    u = x - sum((k * F.cos(2 * j * y) * F.sinh(2 * j * x) for j, k in enumerate(beta, 1)), F.lit(0.0))
    t = F.sin(v) / F.sqrt(F.pow(F.sinh(u), 2) + F.pow(F.cos(v), 2))

    def latitude(t: Column) -> Column:
        s = t / F.sqrt(1 + t * t)
        for _ in range(5):
            s = F.tanh(F.asinh(t) + e * F.atanh(e * s))
        return s

    lat = F.degrees(F.asin(_bound(t, latitude)))
    return F.degrees(F.atan2(F.sinh(u), F.cos(v))) + (zone % 100) * 6 - 183, lat
