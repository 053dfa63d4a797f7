"""What analysts keep and see: reviews, notes, layers, series with their counts, exports, targets, standing in a group.

(K5 to K7, K11, K13, J17, J22, F18, A34, A43, X15, T10, T11, T13 to T15, U4, H7, H8, H22 to H24, P34, P35, H37, H73, Q-17, Q-20; comparison groups are an extension.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from verdure.functions.constants import ACTIVITY_DAYS, CLIENT_CSV_COLUMNS, CONTEXT_ACTIVITIES, GROUP_LEAST, GROUP_QUORUM, GROUP_WINDOW_DAYS, LOCAL_OFFSET, MAD_LIMIT


def reviewed(notes: DataFrame, reviews: DataFrame) -> DataFrame:
    """K5: notes (note_id, field_id, narrative, published, needs_review, reviewed_by, reviewed_at) after reviews (note_id, field_id, reviewer, publish, narrative, at).

    A review counts for the note of its id in its field only; of several the last
    by time. It publishes or not, ends the need of review and signs; a narrative
    replaces the text, null leaves it. Status and confidence are not its matter.
    """
    last = reviews.groupBy("note_id", "field_id").agg(F.max_by(F.struct("reviewer", "publish", "at"), F.struct("at", "reviewer")).alias("r"), F.max_by("narrative", F.when(F.col("narrative").isNotNull(), F.col("at"))).alias("_text"))
    both = notes.join(last, ["note_id", "field_id"], "left")
    done = F.col("r").isNotNull()
    new = {"narrative": F.coalesce("_text", "narrative"), "published": F.when(done, F.col("r.publish")).otherwise(F.col("published")), "needs_review": F.when(done, False).otherwise(F.col("needs_review")), "reviewed_by": F.when(done, F.col("r.reviewer")).otherwise(F.col("reviewed_by")), "reviewed_at": F.when(done, F.col("r.at")).otherwise(F.col("reviewed_at"))}
    return both.withColumns(new).select(*notes.columns)


def annotate(notes: DataFrame, added: DataFrame, fields: DataFrame) -> DataFrame:
    """Notes with those added (id, field_id, body, created_at, ...), each pinned to its field's present geometry version; notes of unknown fields are refused."""
    pinned = added.join(fields.select("field_id", "geometry_version"), "field_id")
    return notes.unionByName(pinned.select(*notes.columns))


def erased(notes: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K6, K7: the notes left after deletions (id, field_id), and of each deletion whether it removed one: the id must be the field's own."""
    key = ["id", "field_id"]
    hit = asked.select(*key).distinct().join(notes.select(*key, F.lit(True).alias("removed")), key, "left")
    return notes.join(asked.select(*key), key, "left_anti"), hit.withColumn("removed", F.coalesce("removed", F.lit(False)))


def backfilled(state: DataFrame, done: DataFrame) -> DataFrame:
    """Collection states (field_id, geometry_version, backfill_complete, last_poll_at) after backfills (field_id, geometry_version, at) that came to their end; an unknown one is added."""
    last = done.groupBy("field_id", "geometry_version").agg(F.max("at").alias("_at"))
    both = state.join(last, ["field_id", "geometry_version"], "full")
    ended = F.col("_at").isNotNull()
    return both.select("field_id", "geometry_version", F.when(ended, True).otherwise(F.col("backfill_complete")).alias("backfill_complete"), F.when(ended, F.col("_at")).otherwise(F.col("last_poll_at")).alias("last_poll_at"))


def present_states(fields: DataFrame, states: DataFrame) -> DataFrame:
    """Fields with the collection state of their present geometry version; null where they have none of it."""
    return fields.join(states, ["field_id", "geometry_version"], "left")


def context_activities(passes: DataFrame, activities: DataFrame) -> DataFrame:
    """J17, F18, Q-20: of each pass (field_id, pass_date) the activities of the days up to it that matter for its reading: how many, of which kinds, and the last day.

    Passes and activities of a field stand in one line of days, a row a day, and each looks back over it.
    """
    kinds = sorted(CONTEXT_ACTIVITIES)
    none = {k: F.lit(False) for k in kinds}
    asked = passes.select("field_id", F.col("pass_date").alias("day")).distinct().withColumns({"asked": F.lit(True), "n": F.lit(0).cast("bigint"), **none})
    kept = activities.where(F.col("activity").isin(*kinds) & F.col("field_id").isNotNull() & F.col("day").isNotNull())
    kept = kept.select("field_id", "day", F.lit(False).alias("asked"), F.lit(1).cast("bigint").alias("n"), *((F.col("activity") == k).alias(k) for k in kinds))
    days = asked.unionByName(kept).groupBy("field_id", "day").agg(F.bool_or("asked").alias("asked"), F.sum("n").alias("n"), *(F.bool_or(k).alias(k) for k in kinds))
    back = W.partitionBy("field_id").orderBy(F.unix_date(F.col("day").cast("date"))).rangeBetween(-ACTIVITY_DAYS, 0)
    seen = {"activities": F.sum("n").over(back), "last_day": F.max(F.when(F.col("n") > 0, F.col("day"))).over(back), **{f"_{i}": F.bool_or(k).over(back) for i, k in enumerate(kinds)}}
    met = days.withColumns(seen).where("asked")
    named = F.concat_ws(",", *(F.when(F.col(f"_{i}"), k) for i, k in enumerate(kinds)))
    return met.select("field_id", F.col("day").alias("pass_date"), "activities", named.alias("kinds"), "last_day")


def overlay_notes(passes: DataFrame, notes: DataFrame) -> DataFrame:
    """Passes with a reading, each with the note of its field and date; of several the last by id."""
    last = notes.groupBy("field_id", "pass_date").agg(F.max_by("narrative", "note_id").alias("narrative"))
    return passes.where("mean IS NOT NULL").join(last, ["field_id", "pass_date"], "left")


def local_time(at: Column) -> Column:
    """A UTC time on the farms' clocks."""
    return F.from_utc_timestamp(at, LOCAL_OFFSET)


def utc_time(local: Column) -> Column:
    """A time on the farms' clocks in UTC."""
    return F.to_utc_timestamp(local, LOCAL_OFFSET)


def iso_utc(at: Column) -> Column:
    """A UTC time as text for requests."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def isolated(rows: DataFrame, value: Column, problem: Column) -> DataFrame:
    """Rows with status and value: a row with a problem is an `error` with its detail and no value, and spoils no other."""
    return rows.withColumns({"status": F.when(problem.isNotNull(), "error").otherwise("ok"), "detail": problem, "value": F.when(problem.isNull(), value)})


def envelope(passes: DataFrame, keys: list[str]) -> DataFrame:
    """A43, Q-08, U4: of each series (keys, index_name, pass_date, status): passes asked for and resolved (ok or interpolated), errors, and its different dates in order."""
    resolved = F.col("status").isin("ok", "interpolated")
    return passes.groupBy(*keys, "index_name").agg(F.count("*").alias("requested"), F.count_if(resolved).alias("resolved"), F.count_if(F.col("status") == "error").alias("errors"), F.array_join(F.array_sort(F.collect_set(F.when(resolved, F.col("pass_date")))), ",").alias("dates"))


def judged(stats: DataFrame, targets: list[tuple[str, str, float, bool]]) -> DataFrame:
    """Scenario, metric, measured, threshold, passed of each target (scenario, metric, threshold, upper bound?) on stats (scenario and a column a metric); a bound that is met counts as passed."""
    metrics = sorted({t[1] for t in targets})
    long = stats.unpivot(["scenario"], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "measured") if metrics else stats.limit(0)
    asked = stats.sparkSession.createDataFrame(targets, "scenario string, metric string, threshold double, upper boolean")
    met = long.join(F.broadcast(asked), ["scenario", "metric"])  # as many rows as targets are given
    passed = F.when(F.col("upper"), F.col("measured") <= F.col("threshold")).otherwise(F.col("measured") >= F.col("threshold"))
    return met.select("scenario", "metric", "measured", "threshold", F.coalesce(passed, F.lit(False)).alias("passed"))


def page(rows: DataFrame, keys: list[str], order: list[Column], size: int, number: int) -> DataFrame:
    """Of each key the rows of a page (from 0) in that order, with their place n."""
    placed = rows.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return placed.where((F.col("n") > size * number) & (F.col("n") <= size * (number + 1)))


def client_lines(passes: DataFrame, columns: tuple[str, ...] = CLIENT_CSV_COLUMNS) -> DataFrame:
    """Passes with line: the client's columns, nulls empty, without quotes; absent columns are empty."""
    from verdure.operators.records import number_text

    kinds = dict(passes.dtypes)

    def cell(c: str) -> Column:
        if c not in kinds:
            return F.lit("")
        if kinds[c] in ("double", "float"):
            return F.coalesce(F.regexp_replace(number_text(F.col(c)), r"\.0$", ""), F.lit(""))
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    return passes.withColumn("line", F.concat_ws(",", *map(cell, columns)))


def newest_layer(layers: DataFrame) -> DataFrame:
    """H7: the latest read-only layer, ties to the least id."""
    return layers.where("read_only").agg(F.min_by("layer_id", F.struct(-F.unix_micros("created_at"), "layer_id")).alias("layer_id")).where("layer_id IS NOT NULL")


def features(boundaries: DataFrame, geometry: Column) -> DataFrame:
    """Q-17, T15: layer_id, n, feature: each layer's boundaries by name, as GeoJSON features."""
    n = F.row_number().over(W.partitionBy("layer_id").orderBy("name", "region_id"))
    text = F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), F.to_json(F.struct("region_id", "layer_id", "name", "source", "dominant")), F.lit("}"))
    return boundaries.select("layer_id", n.alias("n"), text.alias("feature"))


def reference_pass(members: DataFrame, reads: DataFrame, quorum: float = GROUP_QUORUM) -> DataFrame:
    """Extension: group_id, day: the latest day by which a quorum of a group's members (group_id, field_id) had a clear read (field_id, pass_date) of no more than GROUP_WINDOW_DAYS before.

    A member counts on every day from a read until the window ends; its reads'
    windows are merged, so each day's count is a running sum of beginnings and
    endings. Groups that never reach the quorum have no row. Only days of reads count.
    """
    size = members.groupBy("group_id").agg(F.count_distinct("field_id").alias("size"))
    seen = members.distinct().join(reads.select("field_id", "pass_date").distinct(), "field_id")
    own = W.partitionBy("group_id", "field_id").orderBy("pass_date")
    gap = F.datediff(F.lead("pass_date").over(own), "pass_date")
    first = F.coalesce(F.datediff("pass_date", F.lag("pass_date").over(own)) > GROUP_WINDOW_DAYS + 1, F.lit(True))
    ends = F.coalesce(gap > GROUP_WINDOW_DAYS + 1, F.lit(True))
    marks = seen.select("group_id", "pass_date", F.array(F.struct(F.col("pass_date").alias("day"), first.cast("int").alias("d"), F.lit(True).alias("read")), F.struct(F.date_add("pass_date", GROUP_WINDOW_DAYS + 1).alias("day"), (-ends.cast("int")).alias("d"), F.lit(False).alias("read"))).alias("m"))
    marks = marks.select("group_id", F.inline("m")).groupBy("group_id", "day").agg(F.sum("d").alias("d"), F.bool_or("read").alias("read"))
    run = marks.withColumn("have", F.sum("d").over(W.partitionBy("group_id").orderBy("day")))
    good = run.join(size, "group_id").where(F.col("read") & (F.col("have") >= F.col("size") * quorum))
    return good.groupBy("group_id").agg(F.max("day").alias("day"))


def nearest_reads(members: DataFrame, reads: DataFrame, days: DataFrame) -> DataFrame:
    """Extension: group_id, field_id, mean of each member's clear read (field_id, pass_date, mean) nearest to the group's day, within GROUP_WINDOW_DAYS; ties to the earlier. Others sit out."""
    met = members.distinct().join(days, "group_id").join(reads, "field_id").withColumn("gap", F.abs(F.datediff("pass_date", "day")))
    return met.where(F.col("gap") <= GROUP_WINDOW_DAYS).groupBy("group_id", "field_id").agg(F.min_by("mean", F.struct("gap", "pass_date")).alias("mean"))


def standing(reads: DataFrame) -> DataFrame:
    """Extension: reads (group_id, crop, field_id, mean) with percentile: the share of the other members of the same crop that are lower; null for one alone."""
    return reads.withColumn("percentile", F.when(F.count("*").over(W.partitionBy("group_id", "crop")) > 1, F.percent_rank().over(W.partitionBy("group_id", "crop").orderBy("mean"))))


def movement(deltas: DataFrame, decline: float, least: int = GROUP_LEAST) -> DataFrame:
    """Extension: deltas (group_id, field_id, delta) with z and movement: systemic, resilient, idiosyncratic or nominal; null in groups of fewer than least.

    The group has fallen if the median delta is at or below decline; a member has
    fallen with it if its own is. In a steady group a member is idiosyncratic if its
    delta lies MAD_LIMIT median deviations or more below the median, and itself at or below decline.
    """
    mid = deltas.groupBy("group_id").agg(F.median("delta").alias("mid"), F.count("delta").alias("n"))
    off = deltas.join(mid, "group_id").withColumn("off", F.abs(F.col("delta") - F.col("mid")))
    mad = off.groupBy("group_id").agg(F.median("off").alias("mad"))
    both = off.join(mad, "group_id")
    z = F.try_divide(F.lit(0.6745) * (F.col("delta") - F.col("mid")), F.col("mad"))
    fell, group_fell = F.col("delta") <= decline, F.col("mid") <= decline
    alone = fell & (F.col("delta") < F.col("mid")) & F.coalesce(z <= -MAD_LIMIT, F.lit(True))
    label = F.when(group_fell & fell, "systemic").when(group_fell, "resilient").when(alone, "idiosyncratic").otherwise("nominal")
    return both.select(*deltas.columns, z.alias("z"), F.when((F.col("n") >= least) & F.col("delta").isNotNull(), label).alias("movement"))
