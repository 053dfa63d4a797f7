"""Column expressions of the domain: all stay in generated code, none is a UDF.

Masked or missing pixels are NULL; every division gives NULL for a zero divisor.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdure.functions.constants import BANDS, CLEAR_CLASSES, COLOUR_RANGE, COMPOSITES, DIVERGING_RAMP, GDD_BASE, HEALTH_HIGH, HEALTH_MEDIUM, INDEX_RANGE, MOISTURE_RAMP, STATUS, STRESS, UTM_EAST, UTM_SPLIT, UTM_WEST, VEGETATION_RAMP


def finite(v: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def reflectance(dn: Column, offset: Column, quantification: Column) -> Column:
    """Digital number to reflectance; 0 is no data. A quantification that isn't positive is an error."""
    ok = F.assert_true((quantification > 0) & (quantification < float("inf")) & offset.isNotNull(), F.lit("quantification must be positive and each band needs an offset"))
    return F.when(ok.isNull() & (dn != 0), (dn + offset) / quantification)


#: The values of blocks of pixels whose side is no longer are added in their own order.
FEW = 8


def steady_mean(value: Column, side: Column | None = None) -> Column:
    """Aggregate: the mean of doubles, the same in whatever order the rows come.

    Of a block of pixels with a short side (a grouping column) the values are
    added from the least on; else as decimals, if more than two that are not too large for these.
    """
    short = F.lit(False) if side is None else side <= FEW
    fits = F.when(~short & (F.abs(value) < 1e9), value)
    exact = F.sum(fits.cast("decimal(38,20)")).cast("double") / F.count(value)
    mean = F.when((F.count(value) > 2) & (F.count(fits) == F.count(value)), exact).otherwise(F.avg(value))
    if side is None:
        return mean
    own = F.sort_array(F.collect_list(F.when(short, value)))
    return F.when(short, F.try_divide(F.aggregate(own, F.lit(0.0), lambda s, v: s + v), F.size(own))).otherwise(mean)


_INDICES = {
    "ndvi": (("B08", "B04"), lambda b: F.try_divide(b["B08"] - b["B04"], b["B08"] + b["B04"])),
    "evi2": (("B08", "B04"), lambda b: F.try_divide(2.5 * (b["B08"] - b["B04"]), b["B08"] + 2.4 * b["B04"] + 1)),
    "savi": (("B08", "B04"), lambda b: F.try_divide(1.5 * (b["B08"] - b["B04"]), b["B08"] + b["B04"] + 0.5)),
    "ndre": (("B08", "B05"), lambda b: F.try_divide(b["B08"] - b["B05"], b["B08"] + b["B05"])),
    "ndmi": (("B08", "B11"), lambda b: F.try_divide(b["B08"] - b["B11"], b["B08"] + b["B11"])),
}


def index_names() -> list[str]:
    return list(_INDICES)


def index_bands(name: str) -> tuple[str, ...]:
    return _index(name)[0]


def _index(name: str):
    if name.strip().lower() not in _INDICES:
        raise KeyError(f"unknown index {name!r}")
    return _INDICES[name.strip().lower()]


def index_value(name: str, bands: dict[str, Column]) -> Column:
    """An index from reflectances, clipped to its range; NULL where a band is."""
    needed, formula = _index(name)
    if missing := [b for b in needed if b not in bands]:
        raise KeyError(f"{name} needs {', '.join(missing)}")
    lo, hi = INDEX_RANGE[name.strip().lower()]
    v = formula(bands)
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(lo)), F.lit(hi)))


def clear(scl: Column) -> Column:
    """P13."""
    return scl.isin(*CLEAR_CLASSES)


def confidence(fraction: Column) -> Column:
    """P14."""
    return F.when(fraction >= HEALTH_HIGH, "high").when(fraction >= HEALTH_MEDIUM, "medium").otherwise("low")


def _band(value: Column, labels: tuple[str, ...], edges: tuple[float, ...]) -> Column:
    out = F.when(value <= edges[0], labels[0])
    for label, edge in zip(labels[1:-1], edges[1:], strict=True):
        out = out.when(value <= edge, label)
    return out.otherwise(labels[-1])


def classify(index: Column, value: Column, crop: Column | None = None) -> Column:
    """The band of a value, upper edges inclusive, by crop where it has its own; NULL for no value or an unknown index."""
    own = F.lower(F.trim(crop)) if crop is not None else F.lit(None).cast("string")
    out = F.lit(None).cast("string")
    for name, (labels, edges) in BANDS.items():
        picked = _band(value, labels, edges[None])
        for c, e in edges.items():
            if c is not None:
                picked = F.when(own == c, _band(value, labels, e)).otherwise(picked)
        out = F.when(F.lower(index) == name, picked).otherwise(out)
    return F.when(value.isNotNull(), out)


def _lookup(table: dict[str, str], key: Column, other: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(other))


def status(label: Column) -> Column:
    """P21."""
    return _lookup(STATUS, label, "healthy")


def stress(health: Column) -> Column:
    """P33."""
    return _lookup(STRESS, health, "none")


def clamp01(v: Column) -> Column:
    """P31; NULL stays NULL."""
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))


def display_range(index: str, difference: bool = False) -> tuple[float, float]:
    """The range over which an index is drawn; a difference of two passes as far to both sides of 0."""
    lo, hi = COLOUR_RANGE[index.lower()]
    reach = max(abs(lo), abs(hi))
    return (-reach, reach) if difference else (lo, hi)


def ramp(index: str, difference: bool = False) -> list[tuple[int, int, int]]:
    """The colours of an index, or of a difference, from low to high."""
    stops = DIVERGING_RAMP if difference else MOISTURE_RAMP if index.lower() == "ndmi" else VEGETATION_RAMP
    return [tuple(int(c[i : i + 2], 16) for i in (1, 3, 5)) for c in stops]


def colour(index: str, value: Column, difference: bool = False) -> Column:
    """P25: colour (array r, g, b) of a value on a piecewise linear ramp over the index's display range; null stays null."""
    (lo, hi), colours = display_range(index, difference), ramp(index, difference)
    at = clamp01((value - lo) / (hi - lo)) * (len(colours) - 1)
    left = F.least(F.floor(at), F.lit(len(colours) - 2)).cast("int")
    stops = F.array(*(F.array(*map(F.lit, c)) for c in colours))
    a, b, part = F.get(stops, left), F.get(stops, left + 1), at - left
    return F.when(value.isNotNull(), F.array(*(F.round(F.get(a, F.lit(i)) + (F.get(b, F.lit(i)) - F.get(a, F.lit(i))) * part).cast("int") for i in range(3))))


def composite(kind: str, bands: dict[str, Column]) -> Column:
    """Colour (array r, g, b) of reflectances in true or false colour; null if one is. A band that is absent is an error."""
    if missing := [b for b, _ in COMPOSITES[kind] if b not in bands]:
        raise ValueError(f"{kind} needs {', '.join(missing)}")
    shades = [F.round(clamp01(bands[b] / top) * 255).cast("int") for b, top in COMPOSITES[kind]]
    return F.when(~F.exists(F.array(*shades), lambda x: x.isNull()), F.array(*shades))


def hatch(row: Column, col: Column, masked: Column) -> Column:
    """Alpha of the hatch over masked pixels."""
    return F.when(((row + col) % 8 < 3) & masked, 140).otherwise(0)


def tile_bounds(z: Column, x: Column, y: Column) -> list[Column]:
    """West, south, east, north of a map tile in degrees."""
    n = F.pow(F.lit(2.0), z)
    lat = lambda t: F.degrees(F.atan(F.sinh(F.lit(3.141592653589793) * (1 - 2 * t / n))))
    return [x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y)]


def utm_zone(lon: Column) -> Column:
    """EPSG code of the working projection."""
    return F.when(lon >= UTM_SPLIT, UTM_EAST).otherwise(UTM_WEST)


def epsg(crs: Column) -> Column:
    """The code in a CRS string such as EPSG:32736, NULL if there is none."""
    return F.nullif(F.regexp_extract(F.upper(F.trim(crs)), r"^(?:EPSG:{1,2})?([0-9]+)$", 1), F.lit("")).try_cast("int")


def mean_temperature(tmin: Column, tmax: Column, tmean: Column) -> Column:
    """P39."""
    return F.coalesce(tmean, (tmin + tmax) / 2)


def growing_degree_days(tmin: Column, tmax: Column, base: float = GDD_BASE, upper: float | None = None) -> Column:
    """P36."""
    if upper is not None:
        tmin, tmax = F.least(tmin, F.lit(upper)), F.least(tmax, F.lit(upper))
    return F.greatest((tmin + tmax) / 2 - base, F.lit(0.0))


def extraterrestrial_radiation(lat: Column, day_of_year: Column) -> Column:
    """Daily radiation in MJ/m2 at a latitude in degrees."""
    phi, turn = F.radians(lat), 2 * 3.141592653589793 / 365 * day_of_year
    distance, tilt = 1 + 0.033 * F.cos(turn), 0.409 * F.sin(turn - 1.39)
    sunset = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.tan(phi) * F.tan(tilt))))
    return 24 * 60 / 3.141592653589793 * 0.0820 * distance * (sunset * F.sin(phi) * F.sin(tilt) + F.cos(phi) * F.cos(tilt) * F.sin(sunset))


def evapotranspiration(tmin: Column, tmax: Column, lat: Column, day_of_year: Column, tmean: Column | None = None) -> Column:
    """Reference evapotranspiration in mm from temperatures; a negative daily range counts as 0."""
    mean = mean_temperature(tmin, tmax, tmean) if tmean is not None else (tmin + tmax) / 2
    return F.lit(0.0023) * (mean + 17.8) * F.sqrt(F.greatest(tmax - tmin, F.lit(0.0))) * 0.408 * extraterrestrial_radiation(lat, day_of_year)


def dotted_id(canonical: Column) -> dict[str, Column]:
    """Field, sub-plot and scope of a canonical id such as 4.1; no id: farm."""
    part = lambda n: F.split_part(canonical, F.lit("."), F.lit(n))
    field, plot = part(1).try_cast("int"), F.nullif(part(2), F.lit("")).try_cast("int")
    return {"field": field, "sub_plot": plot, "scope": F.when(canonical.isNull(), "farm").when(plot.isNotNull(), "sub_plot").otherwise("field")}


def storage_key(version: Column, field: Column, scene: Column, index: Column) -> Column:
    """K17."""
    return F.format_string("cog/v%d/%s/%s/%s.tif", version, field, scene, index)


def identity(field: Column, index: Column, day: Column, version: Column, scene: Column) -> Column:
    """What makes a result unique, missing parts empty."""
    return F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in (field, index, day, version, scene)))


def idempotency_key(identities: Column) -> Column:
    """Digest of an array of identities in any order."""
    return F.sha2(F.array_join(F.array_sort(identities), "\n"), 256)
