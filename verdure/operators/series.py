"""Passes in time: as-of, snapping, brackets, alerts, phenology, correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from verdure.functions import constants as C


def best_scene(passes: DataFrame) -> DataFrame:
    """The clearest scene of each field and date, ties to the least scene."""
    order = W.partitionBy("field_id", "pass_date").orderBy(F.desc("clear_fraction"), "scene_id")
    return passes.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def _timeline(asked: DataFrame, passes: DataFrame, value: Column) -> DataFrame:
    """asked (field_id, day, ...) with p and n: structs of the date d and value v of the last pass on or before the day, and of the first one after it.

    Passes and requests of a field stand in one line of time, so each field is
    sorted once and read from both ends: no request meets all of its field's passes.
    Of several passes of a day the greatest value counts.
    """
    daily = passes.groupBy("field_id", F.col("pass_date").alias("day")).agg(F.max(value).alias("v"))
    line = asked.withColumn("_q", F.lit(1)).unionByName(daily.select("field_id", "day", F.struct(F.col("day").alias("d"), "v").alias("_p"), F.lit(0).alias("_q")), allowMissingColumns=True)
    own = W.partitionBy("field_id")
    back, on = own.orderBy("day", "_q").rowsBetween(W.unboundedPreceding, 0), own.orderBy(F.desc("day"), F.desc("_q")).rowsBetween(W.unboundedPreceding, 0)
    found = line.withColumns({"p": F.last("_p", ignorenulls=True).over(back), "n": F.last("_p", ignorenulls=True).over(on)})
    return found.where("_q = 1").drop("_q", "_p")


def as_of(requests: DataFrame, passes: DataFrame, min_clear: float = C.MIN_CLEAR) -> DataFrame:
    """For each (field_id, day): the pass at or before, the one after, and the nearer one, ties to before."""
    good = passes.where(F.col("clear_fraction") >= min_clear)
    out = _timeline(requests.select("field_id", "day").distinct(), good, F.col("clear_fraction")).select("field_id", "day", F.col("p.d").alias("before"), F.col("n.d").alias("after"))
    b, a = F.datediff("before", "day"), F.datediff("after", "day")
    nearer = F.when(F.col("after").isNull() | (F.abs(b) <= F.abs(a)), F.coalesce("before", "after")).otherwise(F.col("after"))
    return out.select("field_id", "day", "before", b.alias("before_gap"), "after", a.alias("after_gap"), nearer.alias("resolved"))


def snap(requests: DataFrame, scenes: DataFrame, within: int = C.SNAP_DAYS) -> DataFrame:
    """The scene nearest to each requested day, within so many days; ties to the earlier day, then scene.

    Days are dealt into buckets as wide as the reach, so a request meets three
    buckets of scenes by equality rather than all scenes.
    """
    bucket = lambda c: F.floor(F.unix_date(F.col(c)) / within)
    asked = requests.withColumn("_b", F.explode(F.array(*(bucket("day") + i for i in (-1, 0, 1)))))
    met = asked.join(scenes.withColumn("_b", bucket("scene_date")), "_b")
    gap = F.datediff("scene_date", "day")
    met = met.where(F.abs(gap) <= within)
    best = F.min(F.struct(F.abs(gap).alias("g"), "scene_date", "scene_id"))
    return met.groupBy("day").agg(best.alias("x")).select("day", "x.scene_date", "x.scene_id", F.datediff("x.scene_date", "day").alias("gap"))


STATS = ["mean", "min_val", "max_val", "p10", "p90"]


def interpolate(requests: DataFrame, passes: DataFrame) -> DataFrame:
    """A field's pass of each day, or the average of the nearest before and after, or no_pass.

    passes: field_id, pass_date, STATS, clear_fraction, confidence, resolution_m.
    Averages ignore what is missing; confidence is the weaker one, the resolution the coarser.
    """
    out = _timeline(requests.select("field_id", "day").distinct(), passes, F.struct(*STATS, "clear_fraction", "confidence", "resolution_m"))
    e, b, a = (F.col(c) for c in ("p.v", "p.v", "n.v"))
    out = out.withColumns({"before": F.col("p.d"), "after": F.col("n.d")})
    kind = F.when(F.col("before") == F.col("day"), "ok").when(F.col("before").isNotNull() & F.col("after").isNotNull(), "interpolated").otherwise("no_pass")
    pick = lambda c, between: F.when(kind == "ok", e[c]).when(kind == "interpolated", between)
    average = lambda c: F.coalesce((b[c] + a[c]) / 2, b[c], a[c])
    rank = lambda c: F.when(c == "high", 2).when(c == "medium", 1).otherwise(0)
    weaker = F.when(b["confidence"].isNull() | a["confidence"].isNull(), F.coalesce(b["confidence"], a["confidence"])).when(rank(b["confidence"]) <= rank(a["confidence"]), b["confidence"]).otherwise(a["confidence"])
    return out.select(
        "field_id", "day", kind.alias("status"), F.when(kind == "interpolated", F.col("before")).alias("before"), F.when(kind == "interpolated", F.col("after")).alias("after"),
        *(F.round(pick(c, average(c)), 6).alias(c) for c in STATS), F.round(pick("clear_fraction", F.coalesce(average("clear_fraction"), F.lit(0.0))), 6).alias("clear_fraction"),
        pick("confidence", weaker).alias("confidence"), pick("resolution_m", F.greatest(b["resolution_m"], a["resolution_m"])).alias("resolution_m"),
    )


def alerts(readings: DataFrame) -> DataFrame:
    """Q-21, W3 to W6, F1, U5: alerts of each field's latest usable pass.

    The two rules on NDVI, the one on NDMI, and z-scores of NDRE and NDMI. One
    window pass computes all rules; a row's rules become rows by explode.
    """
    usable = readings.where(F.col("clear_fraction") >= C.MIN_CLEAR).where("mean is not null")
    by = W.partitionBy("field_id", "index_name").orderBy("pass_date")
    prior, recent = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(-C.BASELINE_WINDOW, -1)
    rows = usable.select(
        "field_id", "index_name", "pass_date", "mean",
        F.lag("mean").over(by).alias("before"), F.percentile("mean", F.lit(0.5)).over(recent).alias("base"), F.count("mean").over(recent).alias("base_n"),
        F.avg("mean").over(prior).alias("mu"), F.stddev_pop("mean").over(prior).alias("sigma"), F.count("mean").over(prior).alias("n"),
        F.lead("pass_date").over(by).alias("next"),
    ).where("next is null")
    index = F.col("index_name")
    fall, under = F.round(F.col("before") - F.col("mean"), 6), F.round(F.col("base") - F.col("mean"), 6)
    z = F.round(F.try_divide(F.col("mean") - F.col("mu"), F.when(F.col("sigma") > 1e-12, F.col("sigma"))), 4)
    made = lambda code, level, value, when: F.when(when, F.struct(F.lit(code).alias("code"), level.alias("level"), value.alias("value")))
    warning = F.lit("warning")
    rules = F.array_compact(
        F.array(
            made("ndvi_drop_vs_prior", F.when(fall >= C.DROP_CRITICAL, "critical").otherwise(warning), fall, (index == "ndvi") & (fall >= C.DROP_WARNING)),
            made("ndvi_below_baseline", warning, under, (index == "ndvi") & (F.col("base_n") >= C.BASELINE_LEAST - 1) & (under >= C.DROP_WARNING)),
            made("ndmi_water_stress", warning, F.col("mean"), (index == "ndmi") & (F.col("mean") <= C.DRY_AT)),
            made("anomaly", warning, z, index.isin("ndre", "ndmi") & (F.col("n") >= C.Z_LEAST) & (F.abs(z) >= C.Z_LIMIT)),
        )
    )
    return rows.select("field_id", "index_name", "pass_date", F.explode(rules).alias("r")).select("field_id", "index_name", "pass_date", "r.code", "r.level", "r.value")


def water_deficit(totals: DataFrame) -> DataFrame:
    """Q-21: an alert for each field (field_id, precip_mm, et0_mm) whose rain is under half of its reference evapotranspiration, in the columns of alerts."""
    short = totals.where((F.col("et0_mm") > 0) & (F.col("precip_mm") < C.WATER_RATIO * F.col("et0_mm")))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return short.select("field_id", none("string", "index_name"), none("date", "pass_date"), F.lit("water_deficit").alias("code"), F.lit("warning").alias("level"), F.col("precip_mm").cast("double").alias("value"))


def phenology(passes: DataFrame, fraction: float = 0.5) -> DataFrame:
    """Season figures of each field with three valid passes or more; the others give no row. The integral is that above the base."""
    rows = passes.where("mean is not null")
    by = W.partitionBy("field_id")
    rows = rows.withColumn("base", F.min("mean").over(by)).withColumn("peak", F.max("mean").over(by)).withColumn("n", F.count("*").over(by)).where("n >= 3")
    rows = rows.withColumn("peak_date", F.min(F.when(F.col("mean") == F.col("peak"), F.col("pass_date"))).over(by)).withColumn("level", F.col("base") + fraction * (F.col("peak") - F.col("base")))
    order = by.orderBy("pass_date")
    rows = rows.withColumn("low", F.max((F.col("mean") < F.col("level")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)))
    step = F.datediff(F.lead("pass_date").over(order), "pass_date") * (F.lead("mean").over(order) + F.col("mean") - 2 * F.col("base")) / 2
    rows = rows.withColumn("area", step)
    p, d = F.col("peak_date"), F.col("pass_date")
    out = rows.groupBy("field_id").agg(
        F.first("peak_date").alias("peak_date"), F.first("peak").alias("peak_value"), F.first("base").alias("base_value"),
        F.min(F.when((d <= p) & (F.col("low") == 1) & (F.col("mean") >= F.col("level")), d)).alias("start_date"),
        F.min(F.when((d > p) & (F.col("mean") <= F.col("level")), d)).alias("end_date"), F.round(F.sum("area"), 8).alias("integral"),
    )
    return out.select("field_id", "peak_date", F.round("peak_value", 6).alias("peak_value"), F.round("base_value", 6).alias("base_value"), F.round(F.col("peak_value") - F.col("base_value"), 6).alias("amplitude"), "start_date", "end_date", F.datediff("end_date", "start_date").alias("season_days"), "integral")


def correlate(activities: DataFrame, passes: DataFrame, window: int = 30) -> DataFrame:
    """Baseline (last pass at or before) and mean response in the days after each activity."""
    good = passes.where("mean is not null").groupBy("field_id", "pass_date").agg(F.max("mean").alias("mean"))
    line = _timeline(activities.distinct(), good, F.col("mean")).select("field_id", "day", "activity", F.col("p.d").alias("baseline_date"), F.col("p.v").alias("b"))
    both = line.unionByName(good.select("field_id", F.col("pass_date").alias("day"), F.col("mean").alias("_v")), allowMissingColumns=True)
    later = W.partitionBy("field_id").orderBy(F.unix_date("day")).rangeBetween(1, window)
    out = both.withColumns({"r": F.avg("_v").over(later), "response_date": F.max(F.when(F.col("_v").isNotNull(), F.col("day"))).over(later), "passes": F.count("_v").over(later)}).where("activity is not null")
    base = F.when(F.col("baseline_date").isNotNull(), F.col("b"))
    return out.select("field_id", "day", "activity", "baseline_date", (F.round(base, 10) + 0.0).alias("baseline"), (F.round("r", 10) + 0.0).alias("response"), "response_date", "passes", (F.round(F.col("r") - base, 10) + 0.0).alias("delta"))


def trend(passes: DataFrame) -> DataFrame:
    """Mean of the second half of a field's passes minus that of the first, from four passes on."""
    order = W.partitionBy("field_id", "index_name").orderBy("pass_date")
    rows = passes.where("mean is not null").withColumn("i", F.row_number().over(order)).withColumn("n", F.count("*").over(W.partitionBy("field_id", "index_name")))
    first = F.col("i") <= F.floor(F.col("n") / 2)
    out = rows.where("n >= 4").groupBy("field_id", "index_name").agg(F.avg(F.when(first, F.col("mean"))).alias("a"), F.avg(F.when(~first, F.col("mean"))).alias("b"), F.count("*").alias("passes"))
    return out.select("field_id", "index_name", "passes", (F.round(F.col("b") - F.col("a"), 10) + 0.0).alias("change"))


def recent(passes: DataFrame, k: int, good: float | None = None) -> DataFrame:
    """The k latest passes of each field; with good: just the newest that is clear enough, else the clearest."""
    order = W.partitionBy("field_id").orderBy(F.desc("pass_date"), "scene_id")
    rows = passes.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)
    if good is None:
        return rows
    clear = F.col("clear_fraction") >= good
    pick = W.partitionBy("field_id").orderBy(F.when(clear, F.col("rn")).asc_nulls_last(), F.desc("clear_fraction"), "rn")
    return rows.withColumn("_p", F.row_number().over(pick)).where("_p = 1").drop("_p")


def sessions(events: DataFrame, key: str, at: Column, minutes: int = 30) -> DataFrame:
    """Runs of events of a key without a gap of more than so many minutes."""
    order = W.partitionBy(key).orderBy("_t", "event_id")
    rows = events.withColumn("_t", at.cast("timestamp"))
    new = F.coalesce((F.unix_micros("_t") - F.unix_micros(F.lag("_t").over(order)) > minutes * 60_000_000).cast("int"), F.lit(1))
    rows = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(key, "run").agg(F.count("*").alias("events"), F.min("_t").alias("started"), F.max("_t").alias("ended"))
