"""Keyed tables without MERGE: upserts, first writes, versions, logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from verdure.operators.lineage import checkpointed


def upsert(old: DataFrame, new: DataFrame, identity: list[str], keep: list[str]) -> DataFrame:
    """K1, K2: old with the rows of new in place of those of equal identity; columns ``keep`` stay as first written.

    A new NULL overwrites. One full join on the identity; of repeated new rows
    the caller must have picked one. created: whether the row is new.
    """
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in identity]
    both = old.withColumn("_o", F.lit(True)).alias("o").join(new.withColumn("_n", F.lit(True)).alias("n"), same, "full")
    took = F.col("n._n").isNotNull()
    out = [F.when(F.col("o._o").isNotNull() if c in keep else ~took, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in old.columns]
    return both.select(*out, F.col("o._o").isNull().alias("created"))


def merge(path: str, new: DataFrame, identity: list[str], keep: list[str], month: str, order: str | None = None) -> DataFrame:
    """The rows of new into the table at path, which is partitioned by month; returns what they replaced (month, created, rows).

    Only the months that new holds are read, by partition filters, and only they
    are written again; all other files stay as they are. The merged rows are
    checkpointed before the table is touched, so a failed write can be done
    again, and doing it again changes nothing. Of new rows with one identity the
    last by order counts; identity includes the month.
    """
    spark = new.sparkSession
    if order:
        last = W.partitionBy(*identity).orderBy(F.desc_nulls_last(order), F.xxhash64(*new.columns))
        new = new.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    new = checkpointed(new)
    months = [r[0] for r in new.select(month).distinct().collect()]  # as many as there are months
    try:
        old = spark.read.schema(new.schema).parquet(path).where(F.col(month).isin(months))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        old = new.limit(0)
    both = checkpointed(upsert(old, new, identity, keep))
    both.drop("created").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(month).parquet(path)
    return both.groupBy(month).agg(F.count_if("created").alias("created"), F.count("*").alias("rows"))


def first_write(old: DataFrame, new: DataFrame, identity: list[str]) -> DataFrame:
    """Old and those rows of new whose identity it lacks."""
    return old.unionByName(new.join(old.select(*identity), identity, "left_anti"))


def last_attempt(log: DataFrame, key: str, at: str) -> DataFrame:
    """Attempts and latest status of each key of an append-only log."""
    return log.groupBy(key).agg(F.count("*").alias("attempts"), F.max_by("status", at).alias("status"), F.max(at).alias("last_at"))


def advance_cursor(current: Column, candidate: Column) -> Column:
    """Forward only; missing values are passed over."""
    return F.greatest(current, candidate)


def record_poll(state: DataFrame, polls: DataFrame) -> DataFrame:
    """State (field_id, cursor_date, last_scene_id) after polls (field_id, scene_date, scene_id); the scene changes only if the date advances."""
    best = polls.groupBy("field_id").agg(F.max(F.struct("scene_date", "scene_id")).alias("x"))
    both = state.join(best, "field_id", "full")
    ahead = F.col("x.scene_date").isNotNull() & (F.col("cursor_date").isNull() | (F.col("x.scene_date") > F.col("cursor_date")))
    return both.select("field_id", advance_cursor(F.col("cursor_date"), F.col("x.scene_date")).alias("cursor_date"), F.when(ahead, F.col("x.scene_id")).otherwise(F.col("last_scene_id")).alias("last_scene_id"))


def versions(changes: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """History of a value (version from 1, valid_from, valid_to) from its observations; equal ones in a row are one."""
    order = W.partitionBy(key).orderBy(at)
    rows = changes.withColumn("_p", F.lag(value).over(order)).withColumn("_i", F.row_number().over(order))
    rows = rows.where((F.col("_i") == 1) | ~F.col(value).eqNullSafe(F.col("_p")))
    return rows.select(key, F.row_number().over(order).alias("version"), value, F.col(at).alias("valid_from"), F.lead(at).over(order).alias("valid_to"))


def heal_ids(rows: DataFrame, identity: list[str]) -> DataFrame:
    """Ids with a doubled prefix (9.9.21) become 9.21, unless that row exists already."""
    fixed = F.regexp_replace("canonical_id", r"^(\d+)\.\1\.(.+)$", r"$1.$2")
    rows = rows.withColumn("_new", fixed)
    good, bad = rows.where("_new = canonical_id"), rows.where("_new <> canonical_id").withColumn("canonical_id", F.col("_new"))
    return good.unionByName(bad.dropDuplicates(["canonical_id", *identity]).join(good.select("canonical_id", *identity), ["canonical_id", *identity], "left_anti")).drop("_new")


def settle(log: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The outbox (key, farm_id, results, status, attempts, detail, last_at) after outcomes (key, farm_id, results, ok, detail, at).

    Each outcome is one attempt more; ok makes a key published, else it is a dead
    letter, whose detail stays until an attempt succeeds. Published keys never go
    back. Of several outcomes of a key the last decides.
    """
    last = outcomes.groupBy("key").agg(F.count("*").alias("n"), F.bool_or("ok").alias("any_ok"), F.max_by(F.struct("farm_id", "results", "detail", "at"), "at").alias("o"))
    both = log.join(last, "key", "full")
    done = (F.coalesce("status", F.lit("")) == "published") | F.coalesce("any_ok", F.lit(False))
    status = F.when(done, "published").when(F.col("o").isNotNull(), "dead_letter").otherwise(F.col("status"))
    detail = F.when(~done, F.coalesce("o.detail", "detail"))
    return both.select("key", F.coalesce("farm_id", "o.farm_id").alias("farm_id"), F.coalesce("o.results", "results").alias("results"), status.alias("status"), (F.coalesce("attempts", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("bigint").alias("attempts"), detail.alias("detail"), F.greatest("last_at", "o.at").alias("last_at"))


def unpublished(payloads: DataFrame, log: DataFrame) -> DataFrame:
    """Payloads whose key the outbox (key, status) does not hold as published, each key once."""
    return payloads.dropDuplicates(["key"]).join(log.where("status = 'published'").select("key"), "key", "left_anti")
