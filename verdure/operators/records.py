"""Outbound records and payloads."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from verdure.functions.columns import clamp01, classify, dotted_id, idempotency_key, identity, status, stress
from verdure.functions.constants import CSV_COLUMNS

NAMES = ["ndvi", "evi2", "savi", "ndre", "ndmi"]


def rounded(v: Column, digits: int) -> Column:
    """A double rounded as the number that it is, scaled: 0.285 * 100 lies below 28.5 and gives 0.28, where round goes by its shortest text and gives 0.29."""
    return F.round(v * 10.0**digits) / 10.0**digits


def metrics(rows: DataFrame) -> DataFrame:
    """One record per canonical id and date; of several scenes the last wins, NDVI is classified without crop."""
    ids = dotted_id(F.col("canonical_id"))
    one = [F.max_by(F.when(F.col("index_name") == n, F.col("mean")), F.when(F.col("index_name") == n, F.col("scene_id"))).alias(n) for n in NAMES]
    out = rows.groupBy("canonical_id", "pass_date").agg(*one, F.min_by("clear_fraction", F.struct("scene_id", "index_name")).alias("clear"))
    health = F.when(F.col("ndvi").isNotNull(), status(classify(F.lit("ndvi"), F.col("ndvi"))))
    key = F.concat_ws("-", F.lit("sat"), F.lit("2"), F.replace("canonical_id", F.lit("."), F.lit("-")), F.date_format("pass_date", "yyyy-MM-dd"))
    return out.select("canonical_id", "pass_date", ids["field"].alias("field"), ids["sub_plot"].alias("sub_plot"), ids["scope"].alias("scope"), *NAMES, rounded((1 - F.col("clear")) * 100, 1).alias("cloud_pct"), health.alias("health"), rounded(clamp01(F.col("ndvi")), 2).alias("score"), F.when(health.isNotNull(), stress(health)).alias("stress"), key.alias("external_id"))


def nested(records: DataFrame) -> DataFrame:
    """Field records and, per field and date, one group of its sub-plots, as JSON without nulls."""
    flat = records.where("scope <> 'sub_plot'").select("field", "pass_date", F.lit("field").alias("scope"), F.to_json(F.struct("external_id", "health", "score", "stress")).alias("record"))
    plot = F.struct("sub_plot", "external_id", "health", "score")
    plots = records.where("scope = 'sub_plot'").groupBy("field", "pass_date").agg(F.to_json(F.array_sort(F.collect_list(plot))).alias("record"))
    return flat.unionByName(plots.select("field", "pass_date", F.lit("sub_plots").alias("scope"), "record"))


def pushable(passes: DataFrame) -> DataFrame:
    """F19, Q-10: the results that a finished job pushes: passes that are ok, or averaged from two.

    An averaged one goes under the date that was asked for (else its scenes'),
    with the scene ``avg:a+b``, the earlier scene's provider, and the mean of
    both clear fractions. Passes without a date are an error's sign and left out.
    passes: status, index_name, requested_date, pass_date, scene_id, provider,
    processing_mode, clear_fraction, mean, and before and after, structs of pass_date, scene_id, provider, clear_fraction.
    """
    two = F.col("status") == "interpolated"
    a, b = (lambda c: F.col(f"before.{c}")), (lambda c: F.col(f"after.{c}"))
    scenes = F.concat(F.lit("avg:"), F.coalesce(a("scene_id"), F.lit("")), F.lit("+"), F.coalesce(b("scene_id"), F.lit("")))
    scene = F.when(F.coalesce(a("scene_id"), b("scene_id")).isNotNull(), scenes).otherwise("interpolated")
    rows = passes.where("status IN ('ok', 'interpolated')").select(
        "index_name",
        F.when(two, F.coalesce("requested_date", a("pass_date"), "pass_date")).otherwise(F.col("pass_date")).alias("pass_date"),
        "mean",
        F.when(two, F.coalesce((a("clear_fraction") + b("clear_fraction")) / 2, "clear_fraction", F.lit(0.0))).otherwise(F.coalesce("clear_fraction", F.lit(0.0))).alias("clear_fraction"),
        F.when(two, F.coalesce(a("provider"), b("provider"), F.lit("interpolated"))).otherwise(F.coalesce("provider", F.lit("unknown"))).alias("provider"),
        F.when(two, scene).otherwise(F.coalesce("scene_id", F.lit("unknown"))).alias("scene_id"),
        F.when(two, "interpolated").otherwise(F.coalesce("processing_mode", F.lit("unknown"))).alias("processing_mode"),
        *(c for c in passes.columns if c not in ("status", "index_name", "requested_date", "pass_date", "mean", "clear_fraction", "provider", "scene_id", "processing_mode", "before", "after")),
    )
    return rows.where("pass_date IS NOT NULL")


def payload_keys(rows: DataFrame) -> DataFrame:
    """Each farm's results of a pass and the digest that makes its payload idempotent."""
    one = identity(F.col("field_id"), F.col("index_name"), F.col("pass_date"), F.col("geometry_version"), F.col("scene_id"))
    return rows.groupBy("farm_id", "pass_date").agg(F.count("*").alias("results"), idempotency_key(F.collect_list(one)).alias("idempotency_key"))


def latest_review(notes: DataFrame) -> DataFrame:
    """The note of each field and date that was reviewed last; unreviewed ones come last."""
    order = W.partitionBy("field_id", "pass_date").orderBy(F.desc_nulls_last("reviewed_at"), "note_id")
    return notes.where("published").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def number_text(v: Column) -> Column:
    """A double as text with the fewest digits that give it back: plain from 0.0001 up to 10^16, else with an exponent of two digits; null stays null."""
    return _shortest(v.cast("double"))


@F.arrow_udf(T.StringType())
def _shortest(v: pa.Array) -> pa.Array:
    size = pc.abs(v)
    plain = pc.or_(pc.and_(pc.greater_equal(size, 1e-3), pc.less(size, 1e6)), pc.equal(size, 0.0))
    text = pc.cast(v, pa.string())
    text = pc.if_else(pc.match_substring(text, "."), text, pc.binary_join_element_wise(text, "0", "."))
    if pc.all(plain).as_py() is not False:
        return text
    far = pa.array([repr(x) for x in v.filter(pc.invert(plain)).to_pylist()], pa.string())
    return pc.replace_with_mask(text, pc.fill_null(pc.invert(plain), False), far)


def _cell(name: str, kind: str) -> Column:
    """A value as CSV text: null is empty, doubles are whole, text with separators is quoted."""
    v = F.col(name)
    if kind in ("double", "float"):
        return F.coalesce(number_text(v), F.lit(""))
    v = F.coalesce(v.cast("string"), F.lit(""))
    return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def csv_lines(rows: DataFrame, columns=CSV_COLUMNS) -> DataFrame:
    """Rows with ``line``, the fixed columns as a line of CSV; the columns' names are the header."""
    kinds = dict(rows.dtypes)
    return rows.withColumn("line", F.concat_ws(",", *(_cell(c, kinds[c]) for c in columns)))
