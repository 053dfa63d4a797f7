"""Named queries over stores, plans, records, weather, regions, sources and states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.functions import columns as X
from verdure.operators import geo, planning, records, rollup, store, zones
from verdure.plans.queries import _case, _status, query
from verdure.plans.views import view
from verdure.sources import catalogue, inbound


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    """SELECT day, tmin_c, tmax_c, precip_mm, greatest((tmin_c + tmax_c) / 2 - 10, 0) AS gdd, round(0.0023 * ((tmin_c + tmax_c) / 2 + 17.8) * sqrt(greatest(tmax_c - tmin_c, 0)) * 0.408 * ra, 6) AS et0 FROM
      (SELECT *, 24 * 60 / 3.141592653589793 * 0.0820 * dr * (ws * sin(phi) * sin(tilt) + cos(phi) * cos(tilt) * sin(ws)) AS ra FROM
       (SELECT *, acos(greatest(-1.0, least(1.0, -tan(phi) * tan(tilt)))) AS ws FROM
        (SELECT *, radians(-18.0) AS phi, 1 + 0.033 * cos(turn) AS dr, 0.409 * sin(turn - 1.39) AS tilt FROM (SELECT *, 2 * 3.141592653589793 / 365 * dayofyear(day) AS turn FROM weather) a) b) c) d"""
)
def agro_daily(spark, sf_dir):
    """Growing degree days and reference evapotranspiration of each day."""
    lo, hi = F.col("tmin_c"), F.col("tmax_c")
    et = X.evapotranspiration(lo, hi, F.lit(-18.0), F.dayofyear("day"))
    return view(spark, sf_dir, "weather").select("day", "tmin_c", "tmax_c", "precip_mm", X.growing_degree_days(lo, hi).alias("gdd"), F.round(et, 6).alias("et0"))


@query("SELECT date_trunc('month', day)::DATE AS month, round(sum(greatest((tmin_c + tmax_c) / 2 - 10, 0)), 4) AS gdd, sum(precip_mm) AS rain, count(*) AS days FROM weather GROUP BY 1")
def agro_monthly(spark, sf_dir):
    """Degree days and rain of each month."""
    rows = view(spark, sf_dir, "weather")
    return rows.groupBy(F.trunc("day", "MM").alias("month")).agg(F.round(F.sum(X.growing_degree_days(F.col("tmin_c"), F.col("tmax_c"))), 4).alias("gdd"), F.sum("precip_mm").alias("rain"), F.count("*").alias("days"))


@query(
    "SELECT p.day, count(w.day) AS days, coalesce(sum(w.precip_mm), 0) AS rain, coalesce(sum(greatest((w.tmin_c + w.tmax_c) / 2 - 10, 0)), 0) AS gdd FROM p LEFT JOIN weather w ON w.day >= p.day - 14 AND w.day < p.day GROUP BY 1",
    p="SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders",
)
def weather_context(spark, sf_dir):
    """J17, Q19, Q-20: weather of the 14 days before each pass, by an equi-join on the days looked back to."""
    passes = _table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    back = passes.withColumn("w", F.explode(F.sequence(F.date_sub("day", 14), F.date_sub("day", 1))))
    w = view(spark, sf_dir, "weather").select(F.col("day").alias("w"), "precip_mm", X.growing_degree_days(F.col("tmin_c"), F.col("tmax_c")).alias("g"))
    return back.join(w, "w", "left").groupBy("day").agg(F.count("g").alias("days"), F.coalesce(F.sum("precip_mm"), F.lit(0.0)).alias("rain"), F.coalesce(F.sum("g"), F.lit(0.0)).alias("gdd"))


_WIDE = ", ".join(f"max(mean) FILTER (index_name = '{n}') AS {n}" for n in records.NAMES)


@query(
    f"""SELECT canonical_id, pass_date, CAST(split_part(canonical_id, '.', 1) AS INT) AS field, CAST(nullif(split_part(canonical_id, '.', 2), '') AS INT) AS sub_plot,
      CASE WHEN split_part(canonical_id, '.', 2) <> '' THEN 'sub_plot' ELSE 'field' END AS scope, ndvi, evi2, savi, ndre, ndmi, round((1 - clear) * 100, 1) AS cloud_pct, health, CASE WHEN ndvi IS NOT NULL THEN round(least(greatest(ndvi, 0.0), 1.0), 2) END AS score,
      CASE health WHEN 'healthy' THEN 'none' WHEN 'moderate' THEN 'low' WHEN 'stressed' THEN 'moderate' WHEN 'critical' THEN 'high' END AS stress,
      'sat-2-' || replace(canonical_id, '.', '-') || '-' || strftime(pass_date, '%Y-%m-%d') AS external_id
      FROM (SELECT *, CASE WHEN ndvi IS NOT NULL THEN {_status(_case("'ndvi'", "ndvi", "CAST(NULL AS VARCHAR)"))} END AS health FROM m) x""",
    ids="SELECT *, CAST(field_id AS VARCHAR) || CASE WHEN field_id % 3 = 0 THEN '.1' ELSE '' END AS canonical_id FROM analysis",
    m=f"SELECT canonical_id, pass_date, {_WIDE}, arg_min(clear_fraction, {{'s': scene_id, 'i': index_name}}) AS clear FROM ids GROUP BY 1, 2",
)
def outbound_records(spark, sf_dir):
    """A23, P30 to P33, Q-11, Q24, Q25: one record per field or sub-plot and date."""
    rows = view(spark, sf_dir, "analysis")
    ident = F.concat(F.col("field_id").cast("string"), F.when(F.col("field_id") % 3 == 0, ".1").otherwise(""))
    return records.metrics(rows.withColumn("canonical_id", ident))


@query(
    """SELECT farm_id, pass_date, count(*) AS results, sha256(string_agg(one, chr(10) ORDER BY one)) AS idempotency_key FROM
      (SELECT farm_id, pass_date, a.field_id || '|' || index_name || '|' || strftime(pass_date, '%Y-%m-%d') || '|' || a.geometry_version || '|' || scene_id AS one FROM analysis a JOIN field f ON a.field_id = f.field_id) x GROUP BY 1, 2"""
)
def payload_keys(spark, sf_dir):
    """Digest of each farm's results of each pass."""
    a = view(spark, sf_dir, "analysis")
    return records.payload_keys(a.join(view(spark, sf_dir, "field").select("field_id", "farm_id"), "field_id"))


@query(
    "SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.v ELSE o.v END AS v, CASE WHEN o.k IS NOT NULL THEN o.made ELSE n.made END AS made, o.k IS NULL AS created FROM o FULL JOIN n ON o.k = n.k",
    o="SELECT o_orderkey AS k, o_totalprice AS v, CAST(o_orderdate AS DATE) AS made FROM orders WHERE o_orderkey % 3 <> 0",
    n="SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE round(o_totalprice * 2, 2) END AS v, DATE '2030-01-01' AS made FROM orders WHERE o_orderkey % 2 = 0",
)
def upsert_facts(spark, sf_dir):
    """Refreshed facts; new NULLs overwrite, the creation date stays."""
    o = _table(spark, sf_dir, "orders")
    made = o.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.to_date("o_orderdate").alias("made"))
    new = made.where("k % 2 = 0").select("k", F.when(F.col("k") % 5 != 0, F.round(F.col("v") * 2, 2)).alias("v"), F.lit("2030-01-01").cast("date").alias("made"))
    return store.upsert(made.where("k % 3 <> 0"), new, ["k"], ["made"])


@query("SELECT o_custkey AS key, count(*) AS attempts, arg_max(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS last_at FROM orders GROUP BY 1")
def outbox_status(spark, sf_dir):
    """K8, W11, H20, H21, Q-22: attempts and latest status of each delivery."""
    log = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("at"))
    return store.last_attempt(log, "key", "at").withColumnRenamed("at", "last_at")


@query(
    "SELECT o_custkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS version, o_orderpriority AS value, o_orderkey AS valid_from, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS valid_to FROM v WHERE p IS NULL OR p <> o_orderpriority",
    v="SELECT *, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM (SELECT o_custkey, o_orderkey, min(o_orderpriority) AS o_orderpriority FROM orders GROUP BY 1, 2) y",
)
def geometry_versions(spark, sf_dir):
    """History of a changing value with closed intervals."""
    rows = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), "o_orderkey").agg(F.min("o_orderpriority").alias("value"))
    return store.versions(rows, "k", "o_orderkey", "value")


@query(
    """SELECT field_id, greatest(coalesce(cursor_date, d), coalesce(d, cursor_date)) AS cursor_date, CASE WHEN d IS NOT NULL AND (cursor_date IS NULL OR d > cursor_date) THEN s ELSE last_scene_id END AS last_scene_id FROM st FULL JOIN
      (SELECT field_id, max(pass_date) AS d, max({'d': pass_date, 's': scene_id}).s AS s FROM analysis WHERE pass_date >= DATE '2000-01-01' GROUP BY 1) x USING (field_id)""",
    st="SELECT field_id, max(pass_date) AS cursor_date, CAST(max(scene_id) AS BIGINT) AS last_scene_id FROM analysis WHERE pass_date < DATE '2000-01-01' GROUP BY 1",
)
def forward_cursor(spark, sf_dir):
    """Cursors move forward only."""
    a = view(spark, sf_dir, "analysis")
    state = a.where("pass_date < date'2000-01-01'").groupBy("field_id").agg(F.max("pass_date").alias("cursor_date"), F.max("scene_id").alias("last_scene_id"))
    return store.record_poll(state, a.where("pass_date >= date'2000-01-01'").select("field_id", F.col("pass_date").alias("scene_date"), "scene_id"))


@query(
    "SELECT field_id, scene_id, min(pos) AS pos FROM (SELECT o_custkey AS field_id, o_orderkey AS scene_id, l_shipdate AS pos FROM orders JOIN lineitem ON o_orderkey = l_orderkey) x WHERE scene_id % 4 <> 0 GROUP BY 1, 2"
)
def outstanding_scenes(spark, sf_dir):
    """Discovered scenes that are not processed, once each. Every fourth order is processed."""
    o = _table(spark, sf_dir, "orders")
    seen = o.join(_table(spark, sf_dir, "lineitem"), o.o_orderkey == F.col("l_orderkey")).select(F.col("o_custkey").alias("field_id"), F.col("o_orderkey").alias("scene_id"), F.col("l_shipdate").alias("pos"))
    done = o.where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("field_id"), F.col("o_orderkey").alias("scene_id"))
    return planning.outstanding(seen, done)


@query(
    """SELECT a.field_id, pass_date, index_name, CASE WHEN a.geometry_version < v.geometry_version THEN 'stale' ELSE 'aged' END AS reason FROM analysis a LEFT JOIN (SELECT field_id, geometry_version FROM field WHERE field_id % 5 <> 0) v ON a.field_id = v.field_id
      WHERE coalesce(a.geometry_version < v.geometry_version, false) OR pass_date < DATE '2001-06-30' - INTERVAL 18 MONTH"""
)
def prunable_rasters(spark, sf_dir):
    """F13, T9, A44, Q-26: stale and aged rasters; a fifth of the fields is unknown."""
    v = view(spark, sf_dir, "field").where("field_id % 5 <> 0").select("field_id", F.col("geometry_version").alias("version"))
    cutoff = planning.backfill_start(F.lit("2001-06-30").cast("date"))
    return planning.prunable(view(spark, sf_dir, "analysis"), v, cutoff).select("field_id", "pass_date", "index_name", "reason")


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) - INTERVAL 18 MONTH AS since, date_trunc('month', CAST(o_orderdate AS DATE) - INTERVAL 19 MONTH) AS first_month, 'analysis_y' || strftime(o_orderdate, '%Y') || 'm' || strftime(o_orderdate, '%m') AS part, CAST(23 AS INT) AS months FROM orders")
def partition_plan(spark, sf_dir):
    """Backfill start and month partitions for each day."""
    days = _table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    plan = planning.partition_months(F.col("day"))
    return days.select("day", planning.backfill_start(F.col("day")).alias("since"), F.get(plan, F.lit(0)).alias("first_month"), planning.partition_name(F.col("day")).alias("part"), F.size(plan).alias("months"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean_ms, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS max_ms FROM events GROUP BY 1")
def latency_summary(spark, sf_dir):
    """Latency figures by scenario."""
    return planning.latency(_table(spark, sf_dir, "events"), "event_type", "value")


@query("SELECT farm_id, fields, awaiting, dead_letters, kind, severity FROM (SELECT *, 'dead_letters' AS kind, 'critical' AS severity FROM s WHERE dead_letters > 0 UNION ALL SELECT *, 'awaiting_backfill', 'warning' FROM s WHERE awaiting > 0.5 * fields) x", s="SELECT farm_id, count(*) AS fields, count(*) FILTER (area_m2 > 400000) AS awaiting, count(*) FILTER (crop IS NULL AND area_m2 IS NULL) AS dead_letters FROM field GROUP BY 1")
def pipeline_health(spark, sf_dir):
    """A11, A12, Q-14: health alerts of each farm."""
    f = view(spark, sf_dir, "field")
    s = f.groupBy("farm_id").agg(F.count("*").alias("fields"), F.count_if(F.col("area_m2") > 400000).alias("awaiting"), F.count_if(F.col("crop").isNull() & F.col("area_m2").isNull()).alias("dead_letters"))
    return planning.health_alerts(s)


@query("SELECT r_regionkey AS layer_id, r_name AS name, count(n_nationkey) AS boundaries FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2")
def layer_counts(spark, sf_dir):
    """J6, T12, Q-16, H10: layers with their boundaries; layers without any stay."""
    n = _table(spark, sf_dir, "nation")
    r = _table(spark, sf_dir, "region")
    return r.join(n, r.r_regionkey == n.n_regionkey, "left").groupBy(F.col("r_regionkey").alias("layer_id"), F.col("r_name").alias("name")).agg(F.count("n_nationkey").alias("boundaries"))


@query("SELECT o_orderkey, n_name, o_custkey, CAST(o_orderdate AS DATE) AS pass_date FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority LIKE '1%' ORDER BY pass_date, n_name, o_custkey, o_orderkey LIMIT 200")
def review_queue(spark, sf_dir):
    """T3, J5, F17, Q-15: the first 200 items to review; the limit is the feature."""
    o, c, n = (_table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.where("o_orderpriority LIKE '1%'").join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return rows.select("o_orderkey", "n_name", "o_custkey", F.to_date("o_orderdate").alias("pass_date")).orderBy("pass_date", "n_name", "o_custkey", "o_orderkey").limit(200)


@query("SELECT event_id AS note_id, user_id AS field_id, pass_date, reviewed_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id, pass_date ORDER BY reviewed_at DESC NULLS LAST, event_id) AS n FROM (SELECT *, CAST(ts AS DATE) AS pass_date, CASE WHEN event_id % 3 > 0 THEN event_id % 1000 END AS reviewed_at FROM events WHERE event_type <> 'error') a) b WHERE n = 1")
def latest_narratives(spark, sf_dir):
    """Latest reviewed note of each field and date."""
    e = _table(spark, sf_dir, "events")
    notes = e.select(F.col("event_id").alias("note_id"), F.col("user_id").alias("field_id"), F.to_date("ts").alias("pass_date"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 1000).alias("reviewed_at"), (F.col("event_type") != "error").alias("published"))
    return records.latest_review(notes).drop("published")


def _scaled(n: str, lo: float, hi: float) -> str:
    v = f"avg(mean) FILTER (index_name = '{n}')"
    return f"CASE WHEN {v} IS NOT NULL THEN least(greatest(({v} - ({lo})) / (({hi}) - ({lo})) * 100, 0.0), 100.0) END"


@query(
    "SELECT field_id, round(canopy, 8) AS canopy, round(nitrogen, 8) AS nitrogen, round(moisture, 8) AS moisture, round(coverage, 8) AS coverage, score, CASE WHEN score >= 80 THEN 'Excellent' WHEN score >= 65 THEN 'Good' WHEN score >= 45 THEN 'Moderate' WHEN score >= 25 THEN 'Stressed' ELSE 'Poor' END AS label, CASE WHEN score >= 65 THEN 'positive' WHEN score >= 40 THEN 'caution' WHEN score >= 15 THEN 'critical' ELSE 'neutral' END AS tone FROM s",
    w=f"SELECT field_id, {_scaled('ndvi', -0.2, 0.9)} AS n, {_scaled('evi2', -0.1, 0.8)} AS e, {_scaled('ndre', -0.1, 0.6)} AS nitrogen, {_scaled('ndmi', -0.3, 0.5)} AS moisture, {_scaled('savi', -0.1, 0.7)} AS coverage FROM pass_stats GROUP BY 1",
    d="SELECT field_id, coalesce(0.6 * n + 0.4 * e, n, e) AS canopy, nitrogen, moisture, coverage FROM w",
    s="SELECT *, CAST(floor(round(coalesce((coalesce(canopy * 35, 0) + coalesce(nitrogen * 25, 0) + coalesce(moisture * 25, 0) + coalesce(coverage * 15, 0)) / nullif(CASE WHEN canopy IS NULL THEN 0 ELSE 35 END + CASE WHEN nitrogen IS NULL THEN 0 ELSE 25 END + CASE WHEN moisture IS NULL THEN 0 ELSE 25 END + CASE WHEN coverage IS NULL THEN 0 ELSE 15 END, 0), 0), 8) + 0.5) AS INT) AS score FROM d",
)
def field_scores(spark, sf_dir):
    """Dimensions and overall score of each field."""
    return rollup.field_scores(view(spark, sf_dir, "pass_stats"))


_FINDINGS = [
    ("positive", "dense_canopy", "ndvi > 0.65 AND evi2 > 0.45"),
    ("caution", "nitrogen_risk", "ndvi > 0.45 AND ndre < 0.22"),
    ("positive", "nitrogen_uptake", "ndre > 0.32 AND ndvi > 0.45"),
    ("caution", "moisture_stress", "ndvi > 0.4 AND ndmi < 0"),
    ("critical", "severe_water_stress", "ndmi < -0.15"),
    ("positive", "moisture_adequate", "ndmi > 0.18 AND ndvi > 0.35"),
    ("caution", "patchy_canopy", "ndvi > 0.35 AND savi < ndvi * 0.58"),
    ("caution", "waterlogging", "ndmi > 0.28 AND ndvi < 0.3"),
]


@query(
    "SELECT field_id, CAST(row_number() OVER (PARTITION BY field_id ORDER BY k) - 1 AS INT) AS n, tone, code FROM fired",
    m="SELECT field_id, " + ", ".join(f"avg(mean) FILTER (index_name = '{n}') AS {n}" for n in records.NAMES) + " FROM readings_by_field GROUP BY 1",
    own="SELECT *, coalesce(ndvi < 0.1 AND evi2 < 0.1, false) AS bare FROM m",
    several=" UNION ALL ".join(f"SELECT field_id, {k} AS k, '{tone}' AS tone, '{code}' AS code FROM own WHERE NOT bare AND {when}" for k, (tone, code, when) in enumerate(_FINDINGS)),
    fired="SELECT * FROM several UNION ALL SELECT field_id, 0, 'critical', 'no_vegetation' FROM own WHERE bare UNION ALL SELECT field_id, 0, 'positive', 'consistent' FROM own WHERE NOT bare AND ndvi > 0.35 AND field_id NOT IN (SELECT field_id FROM several)",
)
def field_findings(spark, sf_dir):
    """What each field's indices say together, in order. Every 40 readings of a user are a field's."""
    return rollup.findings(rollup.index_means(view(spark, sf_dir, "readings_by_field")))


@query(
    "SELECT *, " + ", ".join(f"round(100.0 * {s} / nullif(healthy + moderate + stressed + critical, 0), 0) AS {s}_pct" for s in ("healthy", "moderate", "stressed", "critical")) + ", round(100.0 * (fields - awaiting) / nullif(fields, 0), 0) AS coverage_pct FROM t",
    f="SELECT r_name AS region, c_custkey, c_acctbal, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    farms="SELECT region, n_nationkey, count(*) AS field_count, round(sum(greatest(c_acctbal, 0)) / 100, 2) AS total_ha, count(*) FILTER (c_custkey % 4 = 0) AS awaiting, CASE n_nationkey % 5 WHEN 0 THEN 'healthy' WHEN 1 THEN 'moderate' WHEN 2 THEN 'stressed' WHEN 3 THEN 'critical' END AS overall_health FROM f GROUP BY 1, 2",
    t="SELECT region, count(*) AS farms, CAST(sum(field_count) AS BIGINT) AS fields, round(sum(total_ha), 2) AS hectares, CAST(sum(awaiting) AS BIGINT) AS awaiting, " + ", ".join(f"count(*) FILTER (overall_health = '{s}') AS {s}" for s in ("healthy", "moderate", "stressed", "critical")) + " FROM farms GROUP BY 1",
)
def estate_overview(spark, sf_dir):
    """Fields, hectares, backlog, health shares and coverage of each region's farms."""
    c, n, r = (_table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    kinds = F.get(F.array(*map(F.lit, ("healthy", "moderate", "stressed", "critical", None))), F.col("n_nationkey") % 5)
    farms = rows.groupBy(F.col("r_name").alias("region"), "n_nationkey").agg(F.count("*").alias("field_count"), F.round(F.sum(F.greatest("c_acctbal", F.lit(0.0))) / 100, 2).alias("total_ha"), F.count_if(F.col("c_custkey") % 4 == 0).alias("awaiting"))
    return rollup.estate(farms.withColumn("overall_health", kinds))


@query("SELECT l_orderkey, l_linenumber, z, x, y, round(x / pow(2.0, z) * 360 - 180, 9) AS west, round((x + 1) / pow(2.0, z) * 360 - 180, 9) AS east, round(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / pow(2.0, z))))), 9) AS south, round(degrees(atan(sinh(pi() * (1 - 2 * y / pow(2.0, z))))), 9) AS north FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 12 AS INT) AS z, CAST(l_orderkey % pow(2, l_partkey % 12) AS INT) AS x, CAST(l_suppkey % pow(2, l_partkey % 12) AS INT) AS y FROM lineitem) t")
def map_tiles(spark, sf_dir):
    """Bounds of map tiles."""
    n = F.pow(F.lit(2), F.col("l_partkey") % 12)
    t = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 12).cast("int").alias("z"), (F.col("l_orderkey") % n).cast("int").alias("x"), (F.col("l_suppkey") % n).cast("int").alias("y"))
    west, south, east, north = X.tile_bounds(F.col("z"), F.col("x"), F.col("y"))
    return t.select("*", *(F.round(v, 9).alias(k) for k, v in (("west", west), ("east", east), ("south", south), ("north", north))))


_POINTS = "SELECT c_custkey AS id, 29 + (c_custkey * 37 % 5000) / 1000.0 AS lon, -20 + (c_custkey * 91 % 6000) / 1000.0 AS lat FROM customer"


def _points(spark, sf_dir):
    k = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(k.alias("id"), (29 + (k * 37 % 5000) / 1000.0).cast("double").alias("lon"), (-20 + (k * 91 % 6000) / 1000.0).cast("double").alias("lat"))


def _rings(points: DataFrame, grow: float = 0.0) -> DataFrame:
    """points with ring, a rectangle of 0.75 + grow by 0.5 from each."""
    p = lambda dx, dy: F.struct((F.col("lon") + dx).alias("x"), (F.col("lat") + dy).alias("y"))
    return points.withColumn("ring", F.array(p(0.0, 0.0), p(0.75 + grow, 0.0), p(0.75 + grow, 0.5), p(0.0, 0.5)))


@query(
    f"SELECT id, sha256(printf('%.6f %.6f;%.6f %.6f;%.6f %.6f;%.6f %.6f', lon, lat, lon, lat + 0.5, lon + 0.75, lat + 0.5, lon + 0.75, lat)) AS boundary_key FROM ({_POINTS}) p"
)
def boundary_keys(spark, sf_dir):
    """The key of each boundary, written from another corner, in another direction, closed or not, and with noise."""
    r = _rings(_points(spark, sf_dir)).withColumn("ring", F.transform("ring", lambda p: F.struct((p["x"] + 1e-9).alias("x"), (p["y"] - 1e-9).alias("y"))))
    k = (F.col("id") % 4).cast("int")
    r = r.withColumn("ring", F.concat(F.slice("ring", k + 1, F.lit(4)), F.slice("ring", F.lit(1), k)))
    r = r.withColumn("ring", F.when(F.col("id") % 3 == 0, F.reverse("ring")).otherwise(F.col("ring")))
    r = r.withColumn("ring", F.when(F.col("id") % 5 == 0, F.concat("ring", F.slice("ring", 1, 1))).otherwise(F.col("ring")))
    return r.select("id", geo.boundary_key(F.col("ring")).alias("boundary_key"))


_NUMBER = "coalesce(CAST({} AS VARCHAR), '')"


@query(
    "SELECT field_id, pass_date, index_name, scene_id, geometry_version, concat_ws(',', field_id, index_name, pass_date, "
    + ", ".join(_NUMBER.format(c) for c in ("mean / 3", "min_val / 7", "max_val * 1e7 / 3", "std / 1e4", "p10 / 1e7", "p90 / 3", "clear_fraction"))
    + ", coalesce(confidence, ''), resolution_m) AS line FROM pass_stats"
)
def results_csv(spark, sf_dir):
    """Each result as a line of the fixed CSV export, every number with all its digits."""
    c = {"mean": F.col("mean") / 3, "min": F.col("min_val") / 7, "max": F.col("max_val") * 1e7 / 3, "std": F.col("std") / 1e4, "p10": F.col("p10") / 1e7, "p90": F.col("p90") / 3}
    rows = view(spark, sf_dir, "pass_stats").withColumns({"canonical_field_id": F.col("field_id"), **c})
    return records.csv_lines(rows).select("field_id", "pass_date", "index_name", "scene_id", "geometry_version", "line")


@query()
def productivity_zones(spark, sf_dir):
    """M1 to M4, Q-25: zones of each field; tests hold k-means against hand-made fields."""
    px = view(spark, sf_dir, "pixel")
    v = X.index_value("ndvi", {b: X.reflectance(F.col(b.lower()).cast("double"), F.lit(-1000.0), F.lit(10000.0)) for b in ("B08", "B04")})
    return zones.productivity_zones(px.select("field_id", "px_row", "px_col", v.alias("value")))


@query(
    "SELECT 'S' || event_id AS scene_id, ts AS sensed_at, CASE WHEN event_id % 7 > 0 THEN round(value / 5, 4) END AS cloud_pct, 's3://b/' || event_id || '_B04.tif' AS b04 FROM events WHERE event_id % 11 > 0"
)
def stac_search(spark, sf_dir):
    """Catalogue features to scenes; those without a time are dropped. JSON is made from events."""
    e = _table(spark, sf_dir, "events")
    when = F.when(F.col("event_id") % 11 > 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    href = F.struct(F.concat(F.lit("s3://b/"), F.col("event_id"), F.lit("_B04.tif")).alias("href"))
    body = F.to_json(F.struct(F.concat(F.lit("S"), F.col("event_id")).alias("id"), F.struct(when.alias("datetime"), F.when(F.col("event_id") % 7 > 0, F.round(F.col("value") / 5, 4)).alias("eo:cloud_cover")).alias("properties"), F.create_map(F.lit("B04_10m"), href).alias("assets")))
    items = catalogue.stac_items(e.select(body.alias("json")))
    return items.select("scene_id", "sensed_at", "cloud_pct", catalogue.band_asset(F.col("assets"), "B04", 10).alias("b04"))


@query("SELECT CAST(c_nationkey AS VARCHAR) AS farm_id, CAST(c_custkey AS VARCHAR) AS canonical_id, c_name AS name, c_mktsegment AS crop FROM customer UNION ALL SELECT CAST(c_nationkey AS VARCHAR), c_custkey || '.1', 'plot', NULL FROM customer WHERE c_custkey % 2 = 0")
def inbound_fields(spark, sf_dir):
    """S27 to S30, J20, Q-12: nested and flat payloads to fields and sub-plots. Payloads of a hundred fields at most are made from customers."""
    c = _table(spark, sf_dir, "customer").withColumn("fid", F.col("c_custkey").cast("string")).withColumn("farm", F.col("c_nationkey").cast("string")).withColumn("part", F.floor(F.col("c_custkey") / 100))
    plot = F.when(F.col("c_custkey") % 2 == 0, F.array(F.struct(F.lit("1").alias("plot_id"), F.lit("plot").alias("name"))))
    nested = c.where("c_nationkey % 2 = 0").groupBy("farm", "part").agg(F.collect_list(F.struct(F.col("fid").alias("field_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("crop"), plot.alias("sub_plots"))).alias("fields"))
    nested = nested.select(F.to_json(F.struct(F.array(F.struct(F.col("farm").alias("farm_id"), "fields")).alias("farms"))).alias("json"))
    flat_plot = F.when(F.col("c_custkey") % 2 == 0, F.struct(F.lit("1").alias("plotId"), F.col("fid").alias("fieldId"), F.lit("plot").alias("name")))
    flat = c.where("c_nationkey % 2 = 1").groupBy("farm", "part").agg(F.collect_list(F.struct(F.col("fid").alias("fieldId"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("crop"))).alias("fields"), F.collect_list(flat_plot).alias("subPlots"))
    flat = flat.select(F.to_json(F.struct(F.col("farm").alias("farmId"), "fields", "subPlots")).alias("json"))
    return inbound.farm_rows(nested.unionByName(flat))


@query("SELECT n, id, CASE WHEN id NOT LIKE '%.%' THEN id WHEN split_part(id, '.', 1) = split_part(id, '.', 2) AND split_part(id, '.', 3) <> '' THEN split_part(id, '.', 2) || '.' || split_part(id, '.', 3) ELSE id END AS canonical_id FROM (SELECT s_suppkey AS n, CASE s_suppkey % 3 WHEN 0 THEN s_suppkey || '.' || s_suppkey || '.2' WHEN 1 THEN s_suppkey || '.2' ELSE CAST(s_suppkey AS VARCHAR) END AS id FROM supplier) x")
def healed_ids(spark, sf_dir):
    """Doubled id prefixes are taken off."""
    k = F.col("s_suppkey").cast("string")
    ident = F.when(F.col("s_suppkey") % 3 == 0, F.concat_ws(".", k, k, F.lit("2"))).when(F.col("s_suppkey") % 3 == 1, F.concat_ws(".", k, F.lit("2"))).otherwise(k)
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("n"), ident.alias("id"), ident.alias("canonical_id"))
    return store.heal_ids(rows, ["n"])


@query(
    """SELECT field, pass_date, 'field' AS scope, '{"external_id":"' || external_id || '"' || CASE WHEN health IS NULL THEN '' ELSE ',"health":"' || health || '"' END || '}' AS record FROM r WHERE plot = ''
       UNION ALL SELECT field, pass_date, 'sub_plots', '[' || string_agg('{"sub_plot":' || plot || ',"external_id":"' || external_id || '"' || CASE WHEN health IS NULL THEN '' ELSE ',"health":"' || health || '"' END || '}', ',' ORDER BY CAST(plot AS INT)) || ']' FROM r WHERE plot <> '' GROUP BY 1, 2""",
    r="SELECT CAST(field_id // 3 AS INT) AS field, CASE field_id % 3 WHEN 0 THEN '' ELSE CAST(field_id % 3 AS VARCHAR) END AS plot, pass_date, 'x-' || field_id AS external_id, CASE WHEN field_id % 5 > 0 THEN 'healthy' END AS health FROM (SELECT DISTINCT field_id, pass_date FROM analysis) a",
)
def nested_records(spark, sf_dir):
    """Records of fields, and those of sub-plots nested by field and date."""
    a = view(spark, sf_dir, "analysis").select("field_id", "pass_date").distinct()
    k = F.col("field_id") % 3
    rows = a.select(F.floor(F.col("field_id") / 3).cast("int").alias("field"), F.when(k > 0, k.cast("int")).alias("sub_plot"), F.when(k > 0, "sub_plot").otherwise("field").alias("scope"), "pass_date", F.concat(F.lit("x-"), "field_id").alias("external_id"), F.when(F.col("field_id") % 5 > 0, "healthy").alias("health"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("stress"))
    return records.nested(rows)


@query("SELECT field_id, pass_date, index_name, 'cog/v' || geometry_version || '/' || field_id || '/S' || scene_id || '/' || index_name || '.tif' AS key FROM analysis")
def raster_keys(spark, sf_dir):
    """Where each result's raster is kept."""
    a = view(spark, sf_dir, "analysis")
    return a.select("field_id", "pass_date", "index_name", X.storage_key(F.col("geometry_version"), F.col("field_id"), F.concat(F.lit("S"), "scene_id"), F.col("index_name")).alias("key"))


@query("SELECT 'S' || event_id AS scene_id, CAST(ts AS TIMESTAMP) AS sensed_at, value / 5 AS cloud_pct FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND event_id % 7 > 0 AND value / 5 <= 12 ORDER BY ts, 'S' || event_id LIMIT 100")
def scene_search(spark, sf_dir):
    """The first hundred scenes of a period with little cloud; those without a figure don't count."""
    e = _table(spark, sf_dir, "events")
    items = e.select(F.concat(F.lit("S"), "event_id").alias("scene_id"), F.col("ts").cast("timestamp").alias("sensed_at"), F.when(F.col("event_id") % 7 > 0, F.col("value") / 5).alias("cloud_pct"))
    return catalogue.search(items, "2024-01-05", "2024-01-20", 12.0)


@query("SELECT s_suppkey AS scene_id, CAST(10000 + s_suppkey % 3 AS DOUBLE) AS quantification, CASE WHEN s_suppkey % 4 > 0 THEN '05.0' || s_suppkey % 10 END AS baseline, CASE WHEN s_suppkey % 2 = 0 THEN CAST(-1000 - s_suppkey AS DOUBLE) END AS offset_3 FROM supplier")
def product_offsets(spark, sf_dir):
    """Quantification, baseline and offsets of product descriptions in XML, with and without prefixes."""
    k = F.col("s_suppkey")
    part = lambda tag, text, more="": F.concat(F.lit(f"<n:{tag}{more}>"), text.cast("string"), F.lit(f"</n:{tag}>"))
    body = F.concat(F.lit('<n:P xmlns:n="u">'), part("BOA_QUANTIFICATION_VALUE", 10000 + k % 3), F.when(k % 4 > 0, part("PROCESSING_BASELINE", F.concat(F.lit("05.0"), k % 10))).otherwise(""), F.when(k % 2 == 0, part("BOA_ADD_OFFSET", -1000 - k, ' band_id="3"')).otherwise(""), F.lit("</n:P>"))
    found = catalogue.product_metadata(_table(spark, sf_dir, "supplier").select(k.alias("scene_id"), body.alias("xml")))
    return found.select("scene_id", "quantification", "baseline", F.try_element_at("offsets", F.lit("3")).alias("offset_3"))


@query("SELECT CAST(s_nationkey AS DOUBLE) AS lat, day, coalesce(lo, 0) AS tmin_c, hi AS tmax_c, CASE WHEN s_nationkey % 2 = 0 THEN hi - 5 END AS tmean_c, coalesce(CASE WHEN s_nationkey % 3 > 0 THEN rain END, 0) AS precip_mm FROM (SELECT DISTINCT s_nationkey FROM supplier) s, (SELECT day, CASE WHEN tmin_c < 17 THEN tmin_c END AS lo, tmax_c AS hi, precip_mm AS rain FROM weather) w")
def weather_responses(spark, sf_dir):
    """Columnar weather of places, one row a place and day; what is missing is 0 but for the mean."""
    w = view(spark, sf_dir, "weather").agg(F.array_sort(F.collect_list(F.struct("day", "tmin_c", "tmax_c", "precip_mm"))).alias("d"))
    n = F.col("s_nationkey")
    each = lambda f, kind: F.transform("d", f).cast(f"array<{kind}>")
    daily = F.struct(each(lambda x: F.date_format(x["day"], "yyyy-MM-dd"), "string").alias("time"), each(lambda x: F.when(x["tmin_c"] < 17, x["tmin_c"]), "double").alias("temperature_2m_min"), each(lambda x: x["tmax_c"], "double").alias("temperature_2m_max"), each(lambda x: F.when(n % 2 == 0, x["tmax_c"] - 5), "double").alias("temperature_2m_mean"), each(lambda x: F.when(n % 3 > 0, x["precip_mm"]), "double").alias("precipitation_sum"))
    # a season of one place is one response
    body = F.to_json(F.struct(n.cast("double").alias("latitude"), F.lit(30.0).alias("longitude"), daily.alias("daily")), {"ignoreNullFields": "false"})
    places = _table(spark, sf_dir, "supplier").select("s_nationkey").distinct()
    return catalogue.daily_weather(places.join(F.broadcast(w)).select(body.alias("json"))).select("lat", "day", "tmin_c", "tmax_c", "tmean_c", "precip_mm")
