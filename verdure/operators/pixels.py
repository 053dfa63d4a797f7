"""Pixels to zonal statistics, overviews, differences and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdure.functions.columns import clear, confidence, hatch, index_bands, index_names, index_value, reflectance
from verdure.functions.constants import BAND_RESOLUTION, FORMULA_VERSION


def check_resolution(name: str, grid_m: float) -> None:
    """a grid finer than an index's coarsest band is an error."""
    native = max(BAND_RESOLUTION[b] for b in index_bands(name))
    if grid_m < native:
        raise ValueError(f"{name} is a {native} m index: a {grid_m:g} m grid would pretend to more detail")


def zonal_stats(rows: DataFrame, keys: list[str], value: str = "value", include: Column | None = None) -> DataFrame:
    """A1: statistics of the included non-NULL values by keys; all NULL where count is 0. One shuffle."""
    v = F.when(include, F.col(value)) if include is not None else F.col(value)
    p = F.percentile(v, F.array(*map(F.lit, (0.05, 0.1, 0.9, 0.95))))
    out = rows.groupBy(*keys).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"), p.alias("_p"))
    return out.select(*keys, "count", "mean", "min", "max", "std", *(F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(("p5", "p10", "p90", "p95"))))


def clear_fraction(scl: Column, inside: Column) -> Column:
    """A2: aggregate; clear pixels inside over all inside, 0 for none inside."""
    return F.coalesce(F.try_divide(F.count_if(clear(scl) & inside), F.count_if(inside)), F.lit(0.0))


def analyse(pixels: DataFrame, keys: list[str], bands: dict[str, Column], offset: Column, quantification: Column, scl: Column | None, inside: Column, indices: list[str] | None = None, override: Column | None = None) -> DataFrame:
    """Digital numbers to one row of statistics per key and index.

    All indices come from one projection of one scan and one aggregation a key,
    unpivoted after it. Without scl the clear fraction is override, or the finite part.
    """
    names = indices or index_names()
    rho = {b: reflectance(c.cast("double"), offset, quantification) for b, c in bands.items()}
    base = pixels.select(*keys, inside.alias("_in"), (clear(scl) if scl is not None else F.lit(True)).alias("_clear"), *(c.alias(f"_{b}") for b, c in rho.items()))
    wide = base.select(*keys, "_in", "_clear", *(index_value(n, {b: F.col(f"_{b}") for b in bands}).alias(n) for n in names), *([override.alias("_override")] if override is not None else []))
    ok = F.col("_in") & F.col("_clear")
    if scl is not None:
        share = lambda n: F.try_divide(F.count_if(ok), F.count_if("_in"))
    elif override is not None:
        share = lambda n: F.first("_override")
    else:
        share = lambda n: F.try_divide(F.count_if(F.col("_in") & F.col(n).isNotNull()), F.count_if("_in"))
    aggs = []
    for n in names:
        v = F.when(ok, F.col(n))
        p = F.percentile(v, F.array(*map(F.lit, (0.05, 0.1, 0.9, 0.95))))
        clear_part = share(n) if override is not None and scl is None else F.coalesce(share(n), F.lit(0.0))
        parts = {"count": F.count(v), "mean": F.avg(v), "min": F.min(v), "max": F.max(v), "std": F.stddev_pop(v), "_p": p, "clear_fraction": clear_part}
        aggs.append(F.struct(F.lit(n).alias("index_name"), *(c.alias(k) for k, c in parts.items())))
    long = wide.groupBy(*keys).agg(F.array(*aggs).alias("_s")).select(*keys, F.explode("_s").alias("_s"))
    out = long.select(*keys, "_s.index_name", *(f"_s.{c}" for c in ("count", "mean", "min", "max", "std")), *(F.get("_s._p", F.lit(i)).alias(n) for i, n in enumerate(("p5", "p10", "p90", "p95"))), "_s.clear_fraction")
    return out.withColumn("confidence", confidence(F.col("clear_fraction"))).withColumn("formula_version", F.lit(FORMULA_VERSION))


def overview(raster: DataFrame, keys: list[str], factor: int = 2, value: str = "value") -> DataFrame:
    """Block averages of px_row, px_col by factor; blocks without values are NULL."""
    return raster.groupBy(*keys, F.floor(F.col("px_row") / factor).alias("px_row"), F.floor(F.col("px_col") / factor).alias("px_col")).agg(F.avg(value).alias(value))


def difference(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """B - a where both rasters have a value."""
    at = [*keys, "px_row", "px_col"]
    return a.select(*at, F.col(value).alias("_a")).join(b.select(*at, F.col(value).alias("_b")), at).select(*at, (F.col("_b") - F.col("_a")).alias(value))


def cloud_hatch(pixels: DataFrame) -> DataFrame:
    """Alpha of the hatch over cloudy pixels inside the area."""
    return pixels.withColumn("alpha", hatch(F.col("px_row"), F.col("px_col"), F.col("inside") & ~clear(F.col("scl"))))
