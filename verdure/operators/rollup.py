"""Farm health from field statistics (A6 to A10, U1), estate figures and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from verdure.functions.columns import classify, status
from verdure.functions.constants import COLOUR_RANGE


def _weighted(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(F.when(value.isNotNull(), value * weight)), F.sum(F.when(value.isNotNull(), weight)))


def _health(value: Column, crop: Column | None = None) -> Column:
    return F.when(value.isNotNull(), status(classify(F.lit("ndvi"), value, crop)))


def farm_summary(field: DataFrame, analysis: DataFrame) -> DataFrame:
    """Every farm's fields, hectares, crops, latest pass and health, in one plan for all farms.

    The latest pass is over all indices; health uses its NDVI rows alone, weighs
    by area (1 where missing), and is rounded before it is classified.
    """
    base = field.groupBy("farm_id").agg(F.count("*").alias("field_count"), F.round(F.coalesce(F.sum("area_m2"), F.lit(0.0)) / 10000, 2).alias("total_ha"), F.array_join(F.array_sort(F.collect_set("crop")), ",").alias("crops"))
    rows = analysis.select("field_id", "pass_date", "index_name", "mean").join(field.select("field_id", "farm_id", "crop", "area_m2"), "field_id")
    latest = rows.groupBy("farm_id").agg(F.max("pass_date").alias("latest_pass_date"))
    now = rows.join(latest, "farm_id").where((F.col("pass_date") == F.col("latest_pass_date")) & (F.col("index_name") == "ndvi"))
    area, own = F.coalesce("area_m2", F.lit(1.0)), _health(F.col("mean"), F.col("crop"))
    scored = now.groupBy("farm_id").agg(F.round(_weighted(F.col("mean"), area), 4).alias("score"), *(F.count_if(own == s).alias(s) for s in ("healthy", "moderate", "stressed", "critical")))
    out = base.join(latest, "farm_id", "left").join(scored, "farm_id", "left")
    return out.select("farm_id", "field_count", "total_ha", "crops", "latest_pass_date", "score", _health(F.col("score")).alias("overall_health"), *(F.coalesce(s, F.lit(0)).alias(s) for s in ("healthy", "moderate", "stressed", "critical")))


def farm_series(field: DataFrame, analysis: DataFrame, index: str = "ndvi", start: str | None = None, end: str | None = None) -> DataFrame:
    """By farm, pass and scene: area-weighted mean and clear fraction, records, hectares and (NDVI) shares of each health.

    Records without a mean count as records but weigh nothing; a scene without any mean gives no row.
    """
    rows = analysis.where(F.col("index_name") == index)
    rows = rows.where(F.col("pass_date") >= F.lit(start).cast("date")) if start else rows
    rows = rows.where(F.col("pass_date") <= F.lit(end).cast("date")) if end else rows
    rows = rows.join(field.select("field_id", "farm_id", "crop", "area_m2"), "field_id")
    area, own = F.coalesce("area_m2", F.lit(1.0)), _health(F.col("mean"), F.col("crop"))
    some = F.when(F.col("mean").isNotNull(), area)
    shares = [F.round(100 * F.try_divide(F.coalesce(F.sum(F.when(own == s, area)), F.lit(0.0)), F.sum(some)), 1).alias(f"{s}_pct") for s in ("healthy", "moderate", "stressed", "critical")] if index == "ndvi" else []
    out = rows.groupBy("farm_id", "pass_date", "scene_id").agg(F.round(_weighted(F.col("mean"), area), 4).alias("mean"), F.round(F.try_divide(F.sum(F.when(F.col("mean").isNotNull(), F.col("clear_fraction") * area)), F.sum(some)), 4).alias("clear_fraction"), F.count("*").alias("analyzed_fields"), F.round(F.sum(some) / 10000, 2).alias("hectares"), *shares)
    return out.where("mean is not null")


def farm_anomalies(field: DataFrame, analysis: DataFrame, below: float = 0.15, drop: float = 0.2) -> DataFrame:
    """NDVI of fields in the farm's latest pass far below the farm's mean, or fallen since the field's pass before.

    The latest pass is over all indices: a farm whose last pass has no NDVI gives no row.
    """
    rows = analysis.select("field_id", "pass_date", "index_name", "mean").join(field.select("field_id", "farm_id", "crop", "area_m2"), "field_id")
    latest = rows.groupBy("farm_id").agg(F.max("pass_date").alias("latest"))
    vigour = rows.where("index_name = 'ndvi'").join(latest, "farm_id")
    before = vigour.where("pass_date < latest").groupBy("field_id").agg(F.max(F.struct("pass_date", "mean")).alias("before"))
    now = vigour.where("pass_date = latest and mean is not null")
    farm = now.groupBy("farm_id").agg(_weighted(F.col("mean"), F.coalesce("area_m2", F.lit(1.0))).alias("farm_mean"))
    out = now.join(farm, "farm_id").join(before, "field_id", "left")
    under, fall = F.col("mean") < F.col("farm_mean") - below, F.col("before.mean") - F.col("mean")
    fallen, two = F.coalesce(fall >= drop, F.lit(False)), lambda v: F.round(v, 2).cast("string")
    low = F.concat(F.lit("NDVI is "), two(F.col("farm_mean") - F.col("mean")), F.lit(" below farm average ("), two(F.col("farm_mean")), F.lit(")"))
    fell = F.concat(F.lit("NDVI dropped by "), two(fall), F.lit(" from "), two(F.col("before.mean")), F.lit(" on "), F.col("before.pass_date").cast("string"))
    out = out.withColumn("anomaly_type", F.concat_ws("/", F.when(under, "underperforming"), F.when(fallen, "sudden_drop"))).where("anomaly_type <> ''")
    return out.select("farm_id", "pass_date", "field_id", "crop", F.round(F.coalesce("area_m2", F.lit(0.0)) / 10000, 2).alias("field_area_hectares"), F.round("mean", 4).alias("field_value"), F.round("farm_mean", 4).alias("farm_average"), _health(F.col("mean"), F.col("crop")).alias("status"), "anomaly_type", F.concat_ws("; ", F.when(under, low), F.when(fallen, fell)).alias("detail"))


PROVENANCE = ["index_name", "pass_date", "provider", "provider_scene_id", "formula_version", "processing_mode", "resolution_m"]


def publish_rollup(field: DataFrame, analysis: DataFrame, areas: DataFrame) -> DataFrame:
    """Field rows, and one farm row for each provenance. areas: (field_id, geometry_version, area_m2).

    A row's area is that of its own geometry version, 1 where that is unknown.
    Mean and std are averaged over the area of the fields that report them, the
    clear fraction (null: 0) over all; min and p10 are the least, max and p90 the
    greatest; the confidence is the weakest given one, high if none is.
    """
    rows = analysis.join(field.select("field_id", "farm_id"), "field_id").join(areas, ["field_id", "geometry_version"], "left").withColumn("area", F.coalesce("area_m2", F.lit(1.0)))
    rank = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "low", 2).when(F.col("confidence").isNotNull(), 1)
    farm = rows.groupBy("farm_id", *PROVENANCE).agg(
        F.round(_weighted(F.col("mean"), F.col("area")), 4).alias("mean"), F.round(_weighted(F.col("std"), F.col("area")), 4).alias("std"),
        F.min("min_val").alias("min"), F.max("max_val").alias("max"), F.min("p10").alias("p10"), F.max("p90").alias("p90"),
        F.round(F.try_divide(F.sum(F.coalesce("clear_fraction", F.lit(0.0)) * F.col("area")), F.sum("area")), 4).alias("clear_fraction"),
        F.element_at(F.array(*map(F.lit, ("high", "medium", "low"))), F.coalesce(F.max(rank), F.lit(0)) + 1).alias("confidence"),
    )
    own = rows.select("farm_id", "field_id", *PROVENANCE, "mean", "std", F.col("min_val").alias("min"), F.col("max_val").alias("max"), "p10", "p90", "clear_fraction", "confidence")
    return own.unionByName(farm.withColumn("field_id", F.lit(None).cast(own.schema["field_id"].dataType)))


def index_means(analysis: DataFrame) -> DataFrame:
    """A field's mean of each index over its passes."""
    return analysis.groupBy("field_id").agg(*(F.avg(F.when(F.col("index_name") == n, F.col("mean"))).alias(n) for n in ("ndvi", "evi2", "savi", "ndre", "ndmi")))


def field_scores(analysis: DataFrame) -> DataFrame:
    """A field's dimensions (canopy, nitrogen, moisture, coverage) in 0..100 and their weighted score, a whole number."""

    def scale(c: str) -> Column:
        lo, hi = COLOUR_RANGE[c]
        return F.when(F.col(c).isNotNull(), F.least(F.greatest((F.col(c) - lo) / (hi - lo) * 100, F.lit(0.0)), F.lit(100.0)))

    canopy = F.coalesce(0.6 * scale("ndvi") + 0.4 * scale("evi2"), scale("ndvi"), scale("evi2"))
    parts = {"canopy": (canopy, 35), "nitrogen": (scale("ndre"), 25), "moisture": (scale("ndmi"), 25), "coverage": (scale("savi"), 15)}
    rows = index_means(analysis).select("field_id", *(c.alias(n) for n, (c, _) in parts.items()))
    total = sum((F.coalesce(F.col(n) * w, F.lit(0.0)) for n, (_, w) in parts.items()), F.lit(0.0))
    weight = sum((F.when(F.col(n).isNotNull(), w).otherwise(0) for n, (_, w) in parts.items()), F.lit(0))
    score = F.floor(F.round(F.coalesce(F.try_divide(total, weight), F.lit(0.0)), 8) + 0.5).cast("int")
    label = F.when(score >= 80, "Excellent").when(score >= 65, "Good").when(score >= 45, "Moderate").when(score >= 25, "Stressed").otherwise("Poor")
    tone = F.when(score >= 65, "positive").when(score >= 40, "caution").when(score >= 15, "critical").otherwise("neutral")
    return rows.select("field_id", *(F.round(n, 8).alias(n) for n in parts), score.alias("score"), label.alias("label"), tone.alias("tone"))


def findings(means: DataFrame) -> DataFrame:
    """What a field's mean indices say together: (field_id, n, tone, code), in order; no vegetation ends the list."""
    c = F.col
    bare = (c("ndvi") < 0.1) & (c("evi2") < 0.1)
    rules = [
        ("positive", "dense_canopy", (c("ndvi") > 0.65) & (c("evi2") > 0.45)),
        ("caution", "nitrogen_risk", (c("ndvi") > 0.45) & (c("ndre") < 0.22)),
        ("positive", "nitrogen_uptake", (c("ndre") > 0.32) & (c("ndvi") > 0.45)),
        ("caution", "moisture_stress", (c("ndvi") > 0.4) & (c("ndmi") < 0.0)),
        ("critical", "severe_water_stress", c("ndmi") < -0.15),
        ("positive", "moisture_adequate", (c("ndmi") > 0.18) & (c("ndvi") > 0.35)),
        ("caution", "patchy_canopy", (c("ndvi") > 0.35) & (c("savi") < c("ndvi") * 0.58)),
        ("caution", "waterlogging", (c("ndmi") > 0.28) & (c("ndvi") < 0.3)),
    ]
    one = lambda tone, code: F.struct(F.lit(tone).alias("tone"), F.lit(code).alias("code"))
    many = F.array_compact(F.array(*(F.when(when, one(tone, code)) for tone, code, when in rules)))
    rest = F.when(F.size(many) > 0, many).when(c("ndvi") > 0.35, F.array(one("positive", "consistent")))
    rows = means.select("field_id", F.when(bare, F.array(one("critical", "no_vegetation"))).otherwise(rest).alias("all"))
    return rows.select("field_id", F.posexplode("all").alias("n", "f")).select("field_id", "n", "f.tone", "f.code")


def estate(farms: DataFrame) -> DataFrame:
    """By region, of farm summaries (region, field_count, total_ha, overall_health, awaiting): totals, health shares, coverage."""
    counts = [F.count_if(F.col("overall_health") == s).alias(s) for s in ("healthy", "moderate", "stressed", "critical")]
    out = farms.groupBy("region").agg(F.count("*").alias("farms"), F.sum("field_count").alias("fields"), F.round(F.sum("total_ha"), 2).alias("hectares"), F.sum("awaiting").alias("awaiting"), *counts)
    known = sum((F.col(s) for s in ("moderate", "stressed", "critical")), F.col("healthy"))
    return out.select("*", *(F.round(100 * F.try_divide(F.col(s), known), 0).alias(f"{s}_pct") for s in ("healthy", "moderate", "stressed", "critical")), F.round(100 * F.try_divide(F.col("fields") - F.col("awaiting"), F.col("fields")), 0).alias("coverage_pct"))
