"""Catalogue, product and weather sources as DataFrames of parsed JSON and XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURE = "id string, properties struct<datetime:string,start_datetime:string,`eo:cloud_cover`:double>, assets map<string,struct<href:string>>"
WEATHER = "latitude double, longitude double, daily struct<time:array<string>,temperature_2m_min:array<double>,temperature_2m_max:array<double>,temperature_2m_mean:array<double>,precipitation_sum:array<double>>"


def stac_items(raw: DataFrame, column: str = "json") -> DataFrame:
    """Features with an id and a time; the others are dropped. Cloud cover may be null."""
    f = F.from_json(column, FEATURE)
    at = F.try_to_timestamp(F.coalesce(f["properties"]["datetime"], f["properties"]["start_datetime"]))
    return raw.select(f["id"].alias("scene_id"), at.alias("sensed_at"), f["properties"]["eo:cloud_cover"].alias("cloud_pct"), f["assets"].alias("assets")).where("scene_id is not null and sensed_at is not null")


def search(items: DataFrame, start: str, end: str, max_cloud: float | None = None, limit: int = 100) -> DataFrame:
    """At most ``limit`` items of a period by time; a cloud limit drops cloudier ones and those without a figure."""
    rows = items.where(F.col("sensed_at").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    rows = rows.where(F.col("cloud_pct") <= max_cloud) if max_cloud is not None else rows
    return rows.orderBy("sensed_at", "scene_id").limit(limit)


def band_asset(assets: Column, band: str, resolution_m: int) -> Column:
    """Address of a band: by key, by key with resolution, else the first asset that names it."""
    named = F.filter(F.array_sort(F.map_entries(assets)), lambda e: F.contains(F.upper(e["key"]), F.lit(band)) | F.contains(F.upper(e["value"]["href"]), F.lit(band)))
    exact = [F.try_element_at(assets, F.lit(k))["href"] for k in (band, f"{band}_{resolution_m}m", f"{band}-{resolution_m}m")]
    return F.coalesce(*exact, F.get(named, F.lit(0))["value"]["href"])


def product_metadata(raw: DataFrame, column: str = "xml") -> DataFrame:
    """Quantification, baseline and offsets by band id of product XML; no offsets: 0 for each band asked for."""
    node = lambda name: F.expr(f"nullif(xpath_string({column}, \"//*[local-name()='{name}']\"), '')")
    ids = F.expr(f"xpath({column}, \"//*[local-name()='BOA_ADD_OFFSET']/@band_id\")")
    values = F.expr(f"xpath({column}, \"//*[local-name()='BOA_ADD_OFFSET']/text()\")")
    offsets = F.map_from_arrays(ids, F.transform(values, lambda v: v.cast("double")))
    return raw.select("scene_id", node("BOA_QUANTIFICATION_VALUE").cast("double").alias("quantification"), node("PROCESSING_BASELINE").alias("baseline"), offsets.alias("offsets"))


def daily_weather(raw: DataFrame, column: str = "json") -> DataFrame:
    """One row per place and day of a columnar response; missing figures are 0, a missing mean stays null."""
    w = F.from_json(column, WEATHER)
    d = w["daily"]
    days = F.arrays_zip(d["time"].alias("t"), d["temperature_2m_min"].alias("lo"), d["temperature_2m_max"].alias("hi"), d["temperature_2m_mean"].alias("mid"), d["precipitation_sum"].alias("rain"))
    rows = raw.select(w["latitude"].alias("lat"), w["longitude"].alias("lon"), F.explode(days).alias("x"))
    zero = lambda c: F.coalesce(F.col(f"x.{c}"), F.lit(0.0))
    return rows.select("lat", "lon", F.to_date("x.t").alias("day"), zero("lo").alias("tmin_c"), zero("hi").alias("tmax_c"), F.col("x.mid").alias("tmean_c"), zero("rain").alias("precip_mm"))
