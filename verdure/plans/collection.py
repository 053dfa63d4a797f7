"""Named queries over collection, merging and publication, with SQL. Tables that they write stand in folders of their own below the shared one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.operators import planning, records, store
from verdure.operators.lineage import shared_folder
from verdure.plans.queries import query
from verdure.plans.views import view
from verdure.streaming import collect


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FACT = ["field_id", "pass_date", "index_name"]


@query(
    """SELECT coalesce(o.field_id, n.field_id) AS field_id, coalesce(o.pass_date, n.pass_date) AS pass_date, coalesce(o.index_name, n.index_name) AS index_name,
      CASE WHEN n.field_id IS NULL THEN o.mean ELSE n.mean END AS mean, coalesce(o.made, n.made) AS made, CAST(date_trunc('month', coalesce(o.pass_date, n.pass_date)) AS DATE) AS month
      FROM o FULL JOIN n ON o.field_id = n.field_id AND o.pass_date = n.pass_date AND o.index_name = n.index_name""",
    o="SELECT field_id, pass_date, index_name, mean, 'first' AS made FROM analysis WHERE field_id % 5 > 0 OR pass_date < DATE '1997-01-01'",
    n="SELECT field_id, pass_date, index_name, CASE WHEN field_id % 4 > 0 THEN mean + 1 END AS mean, 'second' AS made FROM analysis WHERE pass_date >= DATE '1997-01-01' AND field_id % 3 > 0",
)
def merged_months(spark, sf_dir):
    """A second load merged into a table by month; only the months that it holds are read and written again."""
    path, a = _folder(spark, "facts"), view(spark, sf_dir, "analysis").select(*_FACT, "mean", F.trunc("pass_date", "MM").alias("month"))
    old = a.where("field_id % 5 > 0 OR pass_date < DATE '1997-01-01'").withColumn("made", F.lit("first"))
    new = a.where("pass_date >= DATE '1997-01-01' AND field_id % 3 > 0").withColumn("made", F.lit("second")).withColumn("mean", F.when(F.col("field_id") % 4 > 0, F.col("mean") + 1))
    for rows in (old, new):
        store.merge(path, rows, [*_FACT, "month"], ["made"], "month")
    return spark.read.schema(old.schema).parquet(path).select(*_FACT, "mean", "made", "month")


_SCENES = "SELECT user_id AS field_id, concat('S', CAST(CAST(ts AS DATE) AS STRING), '-', CAST(event_id % 3 AS STRING)) AS scene_id, CAST(ts AS DATE) AS sensed_on FROM events"


@query(
    "SELECT s.field_id, scene_id, sensed_on AS pass_date, CAST(date_trunc('month', sensed_on) AS DATE) AS month, cursor FROM s JOIN (SELECT field_id, max(sensed_on) AS cursor FROM s GROUP BY 1) c ON s.field_id = c.field_id",
    s=f"SELECT DISTINCT * FROM ({_SCENES.replace('STRING', 'VARCHAR')}) e",
)
def incremental_collection(spark, sf_dir):
    """Scenes stream in, four files one after the other with repeats and out of order, and each is collected once into a table by month; with the fields' cursors."""
    made, path = _folder(spark, "scenes"), _folder(spark, "facts")
    scenes = spark.sql(_SCENES.replace("FROM events", "FROM {events}"), events=_table(spark, sf_dir, "events"))
    scenes.repartition(4, F.xxhash64("field_id", "sensed_on", "scene_id") % 5, F.rand(1)).write.parquet(made)
    stream = spark.readStream.schema(scenes.schema).option("maxFilesPerTrigger", 1).parquet(made)
    facts = lambda batch: batch.select("field_id", "scene_id", F.col("sensed_on").alias("pass_date"), F.trunc("sensed_on", "MM").alias("month"), "cursor")
    collect.collect(stream, facts, path, ["field_id", "scene_id", "month"], [], _folder(spark, "states")).awaitTermination()
    out = spark.read.schema("field_id bigint, scene_id string, pass_date date, cursor date, month date").parquet(path)
    last = out.groupBy("field_id").agg(F.max("cursor").alias("cursor"))
    return out.drop("cursor").join(last, "field_id").select("field_id", "scene_id", "pass_date", "month", "cursor")


@query(
    "SELECT key, any_value(farm_id) AS farm_id, CASE WHEN any_value(refused) THEN 'dead_letter' ELSE 'published' END AS status, CASE WHEN any_value(refused) THEN count(DISTINCT part) ELSE 1 END AS attempts FROM p GROUP BY key",
    p="SELECT concat('k', CAST(o_custkey % 997 AS VARCHAR)) AS key, CAST(o_custkey % 997 % 25 AS VARCHAR) AS farm_id, o_custkey % 997 % 11 = 0 AS refused, o_orderkey % 2 AS part FROM orders",
)
def outbox_publication(spark, sf_dir):
    """X17, K8, H20, H21, Q-22: payloads are published from a stream, each once; those that are refused are tried again when they come again."""
    made, box = _folder(spark, "payloads"), _folder(spark, "outbox")
    k = F.col("o_custkey") % 997
    p = _table(spark, sf_dir, "orders").select(F.concat(F.lit("k"), k.cast("string")).alias("key"), (k % 25).cast("string").alias("farm_id"), F.lit(1).cast("bigint").alias("results"), F.col("o_orderdate").cast("timestamp").alias("at"), (F.col("o_orderkey") % 2).alias("part"))
    for part in (0, 1):
        p.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(made)
    number = F.substring("key", 2, 9).cast("int")
    deliver = lambda todo: todo.select("key", (number % 11 != 0).alias("ok"), F.when(number % 11 == 0, "refused").alias("detail"))
    stream = spark.readStream.schema(p.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(made)
    collect.publish(stream, deliver, box, _folder(spark, "states")).awaitTermination()
    none = spark.createDataFrame([], "key string, farm_id string, results bigint, status string, attempts bigint, detail string, last_at timestamp")
    return store.settle(none, collect.attempts(spark, box)).select("key", "farm_id", "status", "attempts")


_PASS = "SELECT CASE scene_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'interpolated' WHEN 2 THEN 'no_scene' ELSE 'ok' END AS status, field_id, index_name, CASE WHEN scene_id % 8 = 1 THEN pass_date END AS requested_date, CASE WHEN scene_id % 4 <> 1 THEN pass_date END AS pass_date, concat('s', CAST(scene_id AS STRING)) AS scene_id, CASE WHEN scene_id % 3 > 0 THEN 'p' END AS provider, 'live' AS processing_mode, clear_fraction, mean, scene_id AS n, pass_date AS day FROM analysis"


@query(
    """SELECT field_id, index_name, day AS pass_date, mean, CASE WHEN status = 'ok' THEN clear_fraction WHEN n % 16 = 1 THEN clear_fraction ELSE round((clear_fraction + 0.5) / 2, 9) END AS clear_fraction,
      CASE WHEN status = 'ok' THEN coalesce(provider, 'unknown') ELSE coalesce(provider, 'q') END AS provider, CASE WHEN status = 'ok' THEN scene_id ELSE concat('avg:a', scene_id, '+b', scene_id) END AS scene_id,
      CASE WHEN status = 'ok' THEN 'live' ELSE 'interpolated' END AS processing_mode FROM p WHERE status IN ('ok', 'interpolated')""",
    p=_PASS.replace("STRING", "VARCHAR"),
)
def pushable_results(spark, sf_dir):
    """F19, Q-10: what a finished job pushes; averaged passes get a scene of both their scenes."""
    p = spark.sql(_PASS.replace("FROM analysis", "FROM {analysis}"), analysis=view(spark, sf_dir, "analysis"))
    half = lambda name, provider, clear: F.when(F.col("status") == "interpolated", F.struct(F.col("day").alias("pass_date"), F.concat(F.lit(name), "scene_id").alias("scene_id"), provider.alias("provider"), clear.alias("clear_fraction")))
    p = p.withColumn("before", half("a", F.col("provider"), F.col("clear_fraction"))).withColumn("after", half("b", F.lit("q"), F.when(F.col("n") % 16 != 1, 0.5)))
    out = records.pushable(p.drop("n", "day"))
    return out.select("field_id", "index_name", "pass_date", "mean", F.round("clear_fraction", 9).alias("clear_fraction"), "provider", "scene_id", "processing_mode")


@query(
    "SELECT c_custkey AS field_id FROM customer LEFT JOIN (SELECT o_custkey, max(CAST(o_orderdate AS TIMESTAMP)) AS polled FROM orders WHERE o_orderdate < DATE '1998-06-01' GROUP BY 1) o ON o_custkey = c_custkey WHERE c_custkey % 10 = 0 OR c_custkey % 4 > 0 AND (polled IS NULL OR epoch(TIMESTAMP '1998-06-01') - epoch(polled) >= 5 * 86400)"
)
def due_fields(spark, sf_dir):
    """The fields that a scan polls: to be backfilled, or complete and not polled for five days."""
    polls = _table(spark, sf_dir, "orders").where("o_orderdate < DATE '1998-06-01'").groupBy("o_custkey").agg(F.max(F.col("o_orderdate").cast("timestamp")).alias("last_poll_at"))
    state = _table(spark, sf_dir, "customer").join(polls, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("c_custkey").alias("field_id"), (F.col("c_custkey") % 10 == 0).alias("needs_backfill"), (F.col("c_custkey") % 4 > 0).alias("backfill_complete"), "last_poll_at")
    return planning.due(state, F.lit("1998-06-01").cast("timestamp")).select("field_id")


@query(
    "SELECT id, any_value(v ORDER BY turn) AS v, CAST(any_value(turn ORDER BY turn) AS INT) AS turn FROM (SELECT o_custkey AS id, o_totalprice AS v, 1 AS turn FROM orders WHERE o_orderkey % 3 = 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 UNION ALL SELECT o_custkey, o_totalprice, 2 FROM orders WHERE o_orderkey % 3 > 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) x GROUP BY id"
)
def first_writes(spark, sf_dir):
    """Rows are added where their identity is new; what was written first stays."""
    o = _table(spark, sf_dir, "orders")
    first = lambda c: o.where(c).groupBy(F.col("o_custkey").alias("id")).agg(F.min_by("o_totalprice", "o_orderkey").alias("v"))
    return store.first_write(first("o_orderkey % 3 = 0").withColumn("turn", F.lit(1)), first("o_orderkey % 3 > 0").withColumn("turn", F.lit(2)), ["id"])
