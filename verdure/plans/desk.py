"""Named queries over reviews, notes, layers, series, targets and comparison groups, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.functions import columns as X
from verdure.operators import desk, overlay
from verdure.plans.geometry import lots, shape, slanted
from verdure.plans.queries import query
from verdure.plans.views import view


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_NOTES = "SELECT o_orderkey AS note_id, o_custkey AS field_id, concat('draft ', CAST(o_orderkey AS STRING)) AS narrative, o_orderkey % 5 = 0 AS published, TRUE AS needs_review, CAST(NULL AS STRING) AS reviewed_by, CAST(NULL AS TIMESTAMP) AS reviewed_at FROM orders"
_REVIEWS = "SELECT l_orderkey AS note_id, CASE WHEN l_orderkey % 7 > 0 THEN o_custkey ELSE -1 END AS field_id, concat('r', CAST(l_linenumber AS STRING)) AS reviewer, l_linenumber % 2 = 0 AS publish, CASE WHEN l_linenumber % 3 = 0 THEN concat('text ', CAST(l_linenumber AS STRING)) END AS narrative, CAST(CAST('2024-01-01' AS DATE) + CAST(l_linenumber AS INT) AS TIMESTAMP) AS at_time FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 25"


@query(
    """SELECT n.note_id, n.field_id, coalesce(words, n.narrative) AS narrative, CASE WHEN turn IS NULL THEN n.published ELSE r.publish END AS published, turn IS NULL AS needs_review, r.reviewer AS reviewed_by, r.at_time AS reviewed_at FROM n
      LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY note_id, field_id ORDER BY at_time DESC, reviewer DESC) AS turn FROM v QUALIFY turn = 1) r ON r.note_id = n.note_id AND r.field_id = n.field_id
      LEFT JOIN (SELECT note_id, field_id, arg_max(narrative, at_time) FILTER (narrative IS NOT NULL) AS words FROM v GROUP BY 1, 2) w ON w.note_id = n.note_id AND w.field_id = n.field_id""",
    n=_NOTES.replace("STRING", "VARCHAR"),
    v=_REVIEWS.replace("STRING", "VARCHAR"),
)
def reviewed_notes(spark, sf_dir):
    """Drafts after their reviews; the last review decides, the last text given stays, other fields' reviews don't count."""
    o, li = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    notes = spark.sql(_NOTES.replace("FROM orders", "FROM {orders}"), orders=o)
    reviews = spark.sql(_REVIEWS.replace("FROM lineitem JOIN orders", "FROM {lineitem} JOIN {orders}"), lineitem=li, orders=o)
    return desk.reviewed(notes, reviews.withColumnRenamed("at_time", "at"))


@query(
    """SELECT id, field_id, geometry_version, body, created_at, CAST(row_number() OVER (PARTITION BY field_id ORDER BY created_at DESC, id) AS INT) AS n FROM
      (SELECT event_id AS id, user_id AS field_id, 1 AS geometry_version, event_type AS body, ts AS created_at FROM events WHERE event_id % 3 = 0
       UNION ALL SELECT event_id, user_id, geometry_version, event_type, ts FROM events JOIN field ON user_id = field_id WHERE event_id % 3 = 1) x WHERE NOT (id % 5 = 0 AND field_id % 2 = 0)"""
)
def field_annotations(spark, sf_dir):
    """Notes with new ones pinned to the present geometry, less those deleted by their own field; newest first."""
    e = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("field_id"), F.col("event_type").alias("body"), F.col("ts").alias("created_at"))
    old = e.where("id % 3 = 0").select("id", "field_id", F.lit(1).alias("geometry_version"), "body", "created_at")
    notes = desk.annotate(old, e.where("id % 3 = 1"), view(spark, sf_dir, "field"))
    # deletions of odd fields' notes ask under another field's id
    asked = e.where("id % 5 = 0").select("id", F.when(F.col("field_id") % 2 == 0, F.col("field_id")).otherwise(-1).alias("field_id"))
    left, _ = desk.erased(notes, asked)
    every = desk.page(left, ["field_id"], [F.desc("created_at"), F.asc("id")], 1 << 30, 0)
    return every.select("id", "field_id", "geometry_version", "body", "created_at", "n")


@query("SELECT DISTINCT event_id AS id, CASE WHEN user_id % 2 = 0 THEN user_id ELSE -1 END AS field_id, user_id % 2 = 0 AND event_id % 3 = 0 AS removed FROM events WHERE event_id % 5 = 0")
def deleted_annotations(spark, sf_dir):
    """K7: of every deletion that was asked for, whether it removed a note."""
    e = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("field_id"))
    asked = e.where("id % 5 = 0").select("id", F.when(F.col("field_id") % 2 == 0, F.col("field_id")).otherwise(-1).alias("field_id"))
    return desk.erased(e.where("id % 3 = 0"), asked)[1]


@query(
    """SELECT f.field_id, f.geometry_version, CASE WHEN at IS NOT NULL THEN TRUE ELSE FALSE END AS backfill_complete, polled FROM field f LEFT JOIN s ON s.field_id = f.field_id AND s.geometry_version = f.geometry_version""".replace("at IS", "done IS"),
    s="SELECT o_custkey AS field_id, 1 + o_orderkey % 3 AS geometry_version, max(o_orderdate) FILTER (o_orderkey % 2 = 0) AS done, CASE WHEN max(o_orderdate) FILTER (o_orderkey % 2 = 0) IS NOT NULL THEN CAST(max(o_orderdate) FILTER (o_orderkey % 2 = 0) AS TIMESTAMP) ELSE CAST(min(o_orderdate) AS TIMESTAMP) END AS polled FROM orders GROUP BY 1, 2",
)
def collection_states(spark, sf_dir):
    """Each field with the collection state of its present geometry, after backfills that came to their end."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("field_id"), (1 + F.col("o_orderkey") % 3).cast("int").alias("geometry_version"), F.col("o_orderdate").cast("timestamp").alias("at"), "o_orderkey")
    state = o.groupBy("field_id", "geometry_version").agg(F.lit(False).alias("backfill_complete"), F.min("at").alias("last_poll_at"))
    now = desk.present_states(view(spark, sf_dir, "field").select("field_id", "geometry_version"), desk.backfilled(state, o.where("o_orderkey % 2 = 0")))
    return now.select("field_id", "geometry_version", F.coalesce("backfill_complete", F.lit(False)).alias("backfill_complete"), F.col("last_poll_at").alias("polled"))


_LOGS = "SELECT user_id AS field_id, CAST(ts AS DATE) AS day, CASE event_id % 6 WHEN 0 THEN 'planting' WHEN 1 THEN 'fertilizer' WHEN 2 THEN 'spray' WHEN 3 THEN 'irrigation' WHEN 4 THEN 'weeding' ELSE 'harvest' END AS activity FROM events"


@query(
    "SELECT p.field_id, p.pass_date, count(activity) AS activities, coalesce(string_agg(DISTINCT activity, ',' ORDER BY activity), '') AS kinds, max(day) AS last_day FROM (SELECT DISTINCT field_id, pass_date FROM readings) p LEFT JOIN (SELECT * FROM logs WHERE activity IN ('planting', 'fertilizer', 'spray', 'irrigation')) g ON g.field_id = p.field_id AND g.day BETWEEN p.pass_date - 30 AND p.pass_date GROUP BY 1, 2",
    logs=_LOGS,
)
def activity_context(spark, sf_dir):
    """J17, F18, Q-20: planting, fertilizer, spray and irrigation of the thirty days up to each pass."""
    logs = spark.sql(_LOGS.replace("FROM events", "FROM {events}"), events=_table(spark, sf_dir, "events"))
    return desk.context_activities(view(spark, sf_dir, "readings"), logs)


@query(
    "SELECT p.field_id, p.pass_date, p.index_name, mean, narrative FROM pass_stats p LEFT JOIN (SELECT o_custkey AS field_id, CAST(o_orderdate AS DATE) AS pass_date, arg_max('n' || o_orderkey, o_orderkey) AS narrative FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2) n ON n.field_id = p.field_id AND n.pass_date = p.pass_date WHERE mean IS NOT NULL"
)
def chart_overlay(spark, sf_dir):
    """Readings of a chart with the note of their date, the last one."""
    notes = _table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("field_id"), F.to_date("o_orderdate").alias("pass_date"), F.concat(F.lit("n"), "o_orderkey").alias("narrative"), F.col("o_orderkey").alias("note_id"))
    return desk.overlay_notes(view(spark, sf_dir, "pass_stats").select("field_id", "pass_date", "index_name", "mean"), notes)


@query("SELECT event_id, ts + INTERVAL 2 HOUR AS local, ts - INTERVAL 2 HOUR AS utc, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS text FROM events")
def local_times(spark, sf_dir):
    """Times on the farms' clocks, in UTC, and as text."""
    return _table(spark, sf_dir, "events").select("event_id", desk.local_time(F.col("ts")).alias("local"), desk.utc_time(F.col("ts")).alias("utc"), desk.iso_utc(F.col("ts")).alias("text"))


_SERIES = "SELECT o_custkey AS field_id, CASE l_linenumber % 3 WHEN 0 THEN 'ndvi' WHEN 1 THEN 'evi2' ELSE 'ndmi' END AS index_name, CAST(o_orderdate AS DATE) AS pass_date, CAST(l_quantity AS DOUBLE) AS dn, CASE WHEN l_suppkey % 5 > 0 THEN 10000.0 ELSE 0.0 END AS quant, l_returnflag = 'A' AS averaged FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query(
    """SELECT field_id, index_name, count(*) AS requested, count(*) FILTER (quant > 0 AND dn <> 1) AS resolved, count(*) FILTER (quant <= 0) AS errors, coalesce(string_agg(DISTINCT CAST(pass_date AS VARCHAR), ',' ORDER BY CAST(pass_date AS VARCHAR)) FILTER (quant > 0 AND dn <> 1), '') AS dates FROM s GROUP BY 1, 2""",
    s=_SERIES,
)
def series_envelope(spark, sf_dir):
    """Q-08, A43, X15, U4: series of several indices: what was asked for and resolved; a pass whose reflectances can't be computed is an error of its own."""
    rows = spark.sql(_SERIES.replace("FROM lineitem JOIN orders", "FROM {lineitem} JOIN {orders}"), lineitem=_table(spark, sf_dir, "lineitem"), orders=_table(spark, sf_dir, "orders"))
    problem = F.when(F.col("quant") <= 0, F.concat(F.lit("quantification must be positive, got "), F.col("quant")))
    made = desk.isolated(rows, X.reflectance(F.col("dn"), F.lit(-1.0), F.col("quant")), problem)
    status = F.when((F.col("status") == "ok") & (F.col("dn") == 1), "no_scene").when((F.col("status") == "ok") & F.col("averaged"), "interpolated").otherwise(F.col("status"))
    return desk.envelope(made.withColumn("status", status).withColumn("pass_date", F.col("pass_date").cast("string")), ["field_id"])


@query(
    "SELECT scenario, 'p95' AS metric, p95 AS measured, CAST(200 AS DOUBLE) AS threshold, coalesce(p95 <= 200, FALSE) AS passed FROM q UNION ALL SELECT scenario, 'mean', mean, CAST(25 AS DOUBLE), coalesce(mean >= 25, FALSE) FROM q WHERE scenario <> 'A'",
    q="SELECT l_returnflag AS scenario, CAST(quantile_disc(l_quantity * 5, 0.95) AS DOUBLE) AS p95, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1",
)
def target_report(spark, sf_dir):
    """Measured figures against targets, upper and lower bounds."""
    stats = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("scenario")).agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY l_quantity * 5)").cast("double").alias("p95"), F.round(F.avg("l_quantity"), 6).alias("mean"))
    names = [r[0] for r in stats.select("scenario").collect()]  # three flags
    targets = [(n, "p95", 200.0, True) for n in names] + [(n, "mean", 25.0, False) for n in names if n != "A"]
    return desk.judged(stats, targets)


@query("SELECT user_id, event_id, ts, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS n FROM events QUALIFY n <= 14")
def activity_feed(spark, sf_dir):
    """The latest fourteen activities of each user."""
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return desk.page(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 14, 0)


@query("SELECT farm_id, field_id, crop, CAST(row_number() OVER (PARTITION BY farm_id ORDER BY CAST(field_id AS VARCHAR)) AS INT) AS n FROM field QUALIFY n > 24 AND n <= 48")
def field_sheet(spark, sf_dir):
    """The second page of each farm's fields by canonical id."""
    f = view(spark, sf_dir, "field").select("farm_id", "field_id", "crop")
    return desk.page(f, ["farm_id"], [F.col("field_id").cast("string")], 24, 1)


@query(
    """SELECT layer_id, CAST(row_number() OVER (PARTITION BY layer_id ORDER BY name, region_id) AS INT) AS n, '{"type":"Feature","geometry":null,"properties":{"region_id":' || region_id || ',"layer_id":' || layer_id || ',"name":"' || name || '","source":"' || source || '"' || CASE WHEN dominant IS NULL THEN '' ELSE ',"dominant":"' || dominant || '"' END || '}}' AS feature FROM r""",
    r="SELECT s_suppkey AS region_id, s_nationkey AS layer_id, 'region ' || s_suppkey % 10 AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'drawn' ELSE 'uploaded' END AS source, CASE WHEN s_suppkey % 3 > 0 THEN 'II' END AS dominant FROM supplier",
)
def layer_features(spark, sf_dir):
    """Q-17, T15: every layer's boundaries by name as features; their geometry is left out here, its text is tested."""
    k = F.col("s_suppkey")
    r = _table(spark, sf_dir, "supplier").select(k.alias("region_id"), F.col("s_nationkey").alias("layer_id"), F.concat(F.lit("region "), k % 10).alias("name"), F.when(k % 2 == 0, "drawn").otherwise("uploaded").alias("source"), F.when(k % 3 > 0, "II").alias("dominant"))
    return desk.features(r, F.lit("null"))


_SHORT = "coalesce(regexp_replace(CAST({} AS VARCHAR), '[.]0$', ''), '')"


@query(
    "SELECT field_id, pass_date, index_name, concat_ws(',', '', pass_date, '', '', 'ok', "
    + ", ".join(_SHORT.format(c) for c in ("mean", "min_val", "max_val", "p10", "p90", "clear_fraction"))
    + ", coalesce(confidence, ''), resolution_m, '', scene_id) AS line FROM pass_stats"
)
def client_csv(spark, sf_dir):
    """Passes as lines of the client's export."""
    p = view(spark, sf_dir, "pass_stats").withColumnsRenamed({"min_val": "min", "max_val": "max"}).withColumn("status", F.lit("ok"))
    return desk.client_lines(p).select("field_id", "pass_date", "index_name", "line")


_LEFT = "1 - (1 + 0.0004 * w.kept) / (1 + 0.0004 * o.n) > 0.001"


@query(
    "SELECT f.id AS field_id, CAST(version AS INT) AS version, obs.seen AS valid_from, lead(obs.seen) OVER (PARTITION BY f.id ORDER BY version) AS valid_to FROM f JOIN obs ON obs.id = f.id AND obs.n = f.n WHERE opened",
    obs="SELECT o_custkey AS id, CAST(o_orderkey AS BIGINT) AS seen, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders) x",
    f=f"WITH RECURSIVE w(id, n, kept, version, opened) AS (SELECT id, n, n, 1, TRUE FROM obs WHERE n = 1 UNION ALL SELECT o.id, o.n, CASE WHEN {_LEFT} THEN o.n ELSE w.kept END, CASE WHEN {_LEFT} THEN w.version + 1 ELSE w.version END, {_LEFT} FROM w JOIN obs o ON o.id = w.id AND o.n = w.n + 1) SELECT * FROM w",
)
def boundary_versions(spark, sf_dir):
    """Versions of boundaries that drift a little at each observation: one opens as soon as the last one kept is left by more than the tolerance."""
    from pyspark.sql.window import Window as W

    seen = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").cast("bigint").alias("seen")).distinct()
    seen = seen.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("seen")))
    rows = seen.join(lots(spark, sf_dir), "id", "left")
    wide = F.lit(0.004) * (1 + 0.0004 * F.col("n"))
    g = shape(slanted(F.coalesce("u", F.lit(30.0)), F.coalesce("v", F.lit(-18.0)), F.coalesce("u", F.lit(30.0)) + wide, F.coalesce("v", F.lit(-18.0)) + 0.003))
    out = overlay.boundary_versions(rows.select(F.col("id").alias("field_id"), F.col("seen").alias("at"), g.alias("geometry")))
    return out.select("field_id", "version", "valid_from", "valid_to")


_MEMBERS = "SELECT DISTINCT user_id AS field_id, CAST(user_id % 7 AS INT) AS group_id, CASE user_id % 3 WHEN 0 THEN 'maize' WHEN 1 THEN 'tobacco' ELSE 'cotton' END AS crop FROM events"
_READS = "SELECT user_id AS field_id, CAST(ts AS DATE) AS pass_date, round(avg(value) / 500, 6) AS mean FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2"
_READ_DAYS = "SELECT DISTINCT group_id, pass_date AS day FROM mem JOIN reads ON mem.field_id = reads.field_id"


@query(
    f"""SELECT n.group_id, crop, n.field_id, mean, CASE WHEN count(*) OVER (PARTITION BY n.group_id, crop) > 1 THEN round(percent_rank() OVER (PARTITION BY n.group_id, crop ORDER BY mean), 6) END AS percentile, day FROM near n JOIN mem ON mem.field_id = n.field_id""",
    mem=_MEMBERS,
    reads=_READS,
    days=_READ_DAYS,
    good="SELECT d.group_id, d.day FROM days d JOIN mem ON mem.group_id = d.group_id LEFT JOIN reads ON reads.field_id = mem.field_id AND reads.pass_date BETWEEN d.day - 14 AND d.day GROUP BY 1, 2 HAVING count(DISTINCT reads.field_id) >= 0.5 * count(DISTINCT mem.field_id)",
    ref="SELECT group_id, max(day) AS day FROM good GROUP BY 1",
    near="SELECT mem.group_id, mem.field_id, day, arg_min(mean, abs(pass_date - day) * 100000 + epoch(pass_date) / 86400) AS mean FROM mem JOIN ref ON ref.group_id = mem.group_id JOIN reads ON reads.field_id = mem.field_id AND abs(pass_date - day) <= 14 GROUP BY 1, 2, 3",
)
def group_standing(spark, sf_dir):
    """Extension: each field's percentile among its group's fields of the same crop on the group's reference day."""
    e = _table(spark, sf_dir, "events")
    mem = spark.sql(_MEMBERS.replace("FROM events", "FROM {events}"), events=e)
    reads = spark.sql(_READS.replace("FROM events", "FROM {events}"), events=e)
    days = desk.reference_pass(mem.select("group_id", "field_id"), reads)
    near = desk.nearest_reads(mem.select("group_id", "field_id"), reads, days)
    out = desk.standing(near.join(mem.select("field_id", "crop"), "field_id")).join(days, "group_id")
    return out.select("group_id", "crop", "field_id", "mean", F.round("percentile", 6).alias("percentile"), "day")


@query(
    """SELECT group_id, field_id, delta, round(z, 6) AS z, CASE WHEN n >= 5 THEN CASE WHEN mid <= -0.05 AND delta <= -0.05 THEN 'systemic' WHEN mid <= -0.05 THEN 'resilient' WHEN delta <= -0.05 AND delta < mid AND coalesce(z <= -2, TRUE) THEN 'idiosyncratic' ELSE 'nominal' END END AS movement
      FROM (SELECT d.*, mid, n, 0.6745 * (delta - mid) / nullif(mad, 0) AS z FROM d JOIN mids ON d.group_id = mids.group_id JOIN mads ON d.group_id = mads.group_id) x""",
    d="SELECT o_custkey AS field_id, o_custkey % 200 AS group_id, round((o_custkey % 200 % 3 - 1) * 0.04 + avg(o_totalprice % 100) / 400 - 0.13, 6) AS delta FROM orders GROUP BY o_custkey",
    mids="SELECT group_id, median(delta) AS mid, count(*) AS n FROM d GROUP BY 1",
    mads="SELECT d.group_id, median(abs(delta - mid)) AS mad FROM d JOIN mids ON d.group_id = mids.group_id GROUP BY 1",
)
def group_movement(spark, sf_dir):
    """Extension: whether a field moved with its group, against it, or alone, by medians and median deviations."""
    k = F.col("o_custkey")
    delta = F.round((F.first(k) % 200 % 3 - 1) * 0.04 + F.avg(F.col("o_totalprice") % 100) / 400 - 0.13, 6)
    d = _table(spark, sf_dir, "orders").groupBy(k.alias("field_id")).agg((F.first(k) % 200).alias("group_id"), delta.alias("delta"))
    return desk.movement(d.select("group_id", "field_id", "delta"), -0.05).withColumn("z", F.round("z", 6))
