"""What to collect, keep and drop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdure.functions.constants import BACKFILL_MONTHS, CADENCE_DAYS


def outstanding(discovered: DataFrame, processed: DataFrame) -> DataFrame:
    """Each discovered scene once, at its first position, unless processed; late ones are kept."""
    once = discovered.groupBy("field_id", "scene_id").agg(F.min("pos").alias("pos"))
    return once.join(processed.select("field_id", "scene_id").distinct(), ["field_id", "scene_id"], "left_anti")


def backfill_start(today: Column, months: int = BACKFILL_MONTHS) -> Column:
    """So many calendar months back, the day clamped to the month."""
    return F.add_months(today, -months)


def prunable(rasters: DataFrame, versions: DataFrame, cutoff: Column) -> DataFrame:
    """F13, A44, Q-26: rasters of an older version than the field's current one, or from before the cutoff; unknown fields are never stale."""
    both = rasters.join(versions.select("field_id", F.col("version").alias("_now")), "field_id", "left")
    stale, aged = F.coalesce(F.col("geometry_version") < F.col("_now"), F.lit(False)), F.col("pass_date") < cutoff
    return both.where(stale | aged).withColumn("reason", F.when(stale, "stale").otherwise("aged")).drop("_now")


def due(state: DataFrame, now: Column, days: int = CADENCE_DAYS) -> DataFrame:
    """Fields to poll: to be backfilled, or complete and not polled for so many days (never: due)."""
    late = F.col("last_poll_at").isNull() | (F.unix_seconds(now) - F.unix_seconds("last_poll_at") >= days * 86400)
    return state.where(F.col("needs_backfill") | (F.col("backfill_complete") & late))


def partition_months(today: Column, months: int = BACKFILL_MONTHS, slack: int = 1, ahead: int = 3) -> Column:
    """Array of month starts that the fact table needs."""
    return F.sequence(F.trunc(F.add_months(today, -months - slack), "MM"), F.trunc(F.add_months(today, ahead), "MM"), F.expr("interval 1 month"))


def partition_name(month: Column) -> Column:
    """H30."""
    return F.date_format(month, "'analysis_y'yyyy'm'MM")


def latency(rows: DataFrame, key: str, ms: str) -> DataFrame:
    """Mean, nearest-rank percentiles and maximum by key, as Spark's discrete percentile ranks them."""
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {ms})")
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(ms), 4).alias("mean_ms"), rank(0.5).alias("p50"), rank(0.95).alias("p95"), rank(0.99).alias("p99"), F.max(ms).alias("max_ms"))


def health_alerts(summary: DataFrame, awaiting_share: float = 0.5) -> DataFrame:
    """A11, A12, Q-14: alerts from counts (fields, awaiting, dead_letters)."""
    share = F.try_divide(F.col("awaiting"), F.col("fields"))
    made = lambda when, kind, severity: F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity")))
    found = F.array_compact(F.array(made(F.col("dead_letters") > 0, "dead_letters", "critical"), made(share > awaiting_share, "awaiting_backfill", "warning")))
    return summary.select("*", F.explode(found).alias("a")).select(*summary.columns, "a.kind", "a.severity")
