"""Named queries over the domain views, each with SQL that DuckDB can run on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from verdure.functions import columns as X
from verdure.functions.constants import BANDS, STATUS
from verdure.operators import pixels, rollup, series
from verdure.plans.views import duck, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, **views: str):
    """Registers a function as a query, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = duck(sql, **views)
        return f

    return add


def _case(index: str, value: str, crop: str) -> str:
    """The bands of BANDS as SQL."""
    out = []
    for name, (labels, edges) in BANDS.items():
        for c, e in sorted(edges.items(), key=lambda kv: kv[0] is None):
            own = f"{index} = '{name}'" + (f" AND {crop} = '{c}'" if c else "")
            inner = " ".join(f"WHEN {value} <= {x} THEN '{lab}'" for x, lab in zip(e, labels, strict=False))
            out.append(f"WHEN {value} IS NOT NULL AND {own} THEN CASE {inner} ELSE '{labels[-1]}' END")
    return "CASE " + " ".join(out) + " END"


def _status(label: str) -> str:
    return f"CASE {label} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " ELSE 'healthy' END"


def _rho(c: str) -> str:
    return f"(CASE WHEN {c} <> 0 THEN (CAST({c} AS DOUBLE) - 1000) / 10000.0 END)"


_RHO = {b: _rho(b.lower()) for b in ("B08", "B04", "B05", "B11")}
_FORMULA = {
    "ndvi": "(n - r) / nullif(n + r, 0)",
    "evi2": "2.5 * (n - r) / nullif(n + 2.4 * r + 1, 0)",
    "savi": "1.5 * (n - r) / nullif(n + r + 0.5, 0)",
    "ndre": "(n - e) / nullif(n + e, 0)",
    "ndmi": "(n - s) / nullif(n + s, 0)",
}
_LONG = " UNION ALL ".join(
    f"SELECT field_id, scl, inside, '{k}' AS index_name, greatest({-1.5 if k == 'savi' else -1.0}, least({1.5 if k == 'savi' else 1.0}, {f})) AS v FROM rho" for k, f in _FORMULA.items()
)


@query(
    """SELECT field_id, index_name, count(v) FILTER (ok) AS count, round(avg(v) FILTER (ok), 6) AS mean, round(min(v) FILTER (ok), 6) AS min, round(max(v) FILTER (ok), 6) AS max,
      round(stddev_pop(v) FILTER (ok), 6) AS std, round(quantile_cont(v, 0.05) FILTER (ok), 6) AS p5, round(quantile_cont(v, 0.1) FILTER (ok), 6) AS p10,
      round(quantile_cont(v, 0.9) FILTER (ok), 6) AS p90, round(quantile_cont(v, 0.95) FILTER (ok), 6) AS p95, round(coalesce(CAST(count(*) FILTER (ok) AS DOUBLE) / nullif(count(*) FILTER (inside), 0), 0), 6) AS clear_fraction
      FROM (SELECT *, inside AND scl IN (4, 5, 6, 7) AS ok FROM long_rows) x GROUP BY field_id, index_name""",
    rho=f"SELECT field_id, scl, inside, {_RHO['B08']} AS n, {_RHO['B04']} AS r, {_RHO['B05']} AS e, {_RHO['B11']} AS s FROM pixel",
    long_rows=_LONG,
)
def zonal_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digital numbers to statistics per field and index."""
    px = view(spark, sf_dir, "pixel")
    out = pixels.analyse(px, ["field_id"], {b: F.col(b.lower()) for b in ("B08", "B04", "B05", "B11")}, F.lit(-1000.0), F.lit(10000.0), F.col("scl"), F.col("inside"))
    return out.select("field_id", "index_name", "count", *(F.round(c, 6).alias(c) for c in ("mean", "min", "max", "std", "p5", "p10", "p90", "p95", "clear_fraction")))


@query("SELECT field_id, px_row // 2 AS px_row, px_col // 2 AS px_col, round(avg(b08), 6) AS value FROM pixel GROUP BY 1, 2, 3")
def raster_overview(spark, sf_dir):
    """Half-size overview of a raster."""
    px = view(spark, sf_dir, "pixel").withColumn("value", F.col("b08"))
    return pixels.overview(px, ["field_id"]).withColumn("value", F.round("value", 6))


@query(
    "SELECT x.field_id, x.px_row, x.px_col, round(y.value - x.value, 6) AS value FROM a x JOIN b y USING (field_id, px_row, px_col)",
    a="SELECT field_id, px_row, px_col, avg(b04) AS value FROM pixel GROUP BY 1, 2, 3",
    b="SELECT field_id, px_row, px_col, avg(b08) AS value FROM pixel GROUP BY 1, 2, 3",
)
def raster_difference(spark, sf_dir):
    """Second raster minus first, where both have values."""
    px = view(spark, sf_dir, "pixel")
    by = ["field_id", "px_row", "px_col"]
    a, b = (px.groupBy(*by).agg(F.avg(c).alias("value")) for c in ("b04", "b08"))
    return pixels.difference(a, b, ["field_id"]).withColumn("value", F.round("value", 6))


@query("SELECT field_id, px_row, px_col, CASE WHEN (px_row + px_col) % 8 < 3 AND inside AND scl NOT IN (4, 5, 6, 7) THEN 140 ELSE 0 END AS alpha FROM pixel")
def cloud_hatch(spark, sf_dir):
    """Hatch over clouds."""
    return pixels.cloud_hatch(view(spark, sf_dir, "pixel")).select("field_id", "px_row", "px_col", F.col("alpha").cast("int"))


@query(f"SELECT field_id, pass_date, index_name, mean, {_case('index_name', 'mean', 'crop')} AS band, {_status(_case('index_name', 'mean', 'crop'))} AS status FROM analysis JOIN field USING (field_id)")
def classify_bands(spark, sf_dir):
    """Band and health status of every field reading, by crop."""
    rows = view(spark, sf_dir, "analysis").join(view(spark, sf_dir, "field").select("field_id", "crop"), "field_id")
    band = X.classify(F.col("index_name"), F.col("mean"), F.col("crop"))
    return rows.select("field_id", "pass_date", "index_name", "mean", band.alias("band"), X.status(band).alias("status"))


_OWN = _status(_case("'ndvi'", "mean", "crop"))
_ALL = _status(_case("'ndvi'", "score", "CAST(NULL AS VARCHAR)"))


@query(
    f"""SELECT base.farm_id, field_count, total_ha, crops, latest_pass_date, score, CASE WHEN score IS NOT NULL THEN {_ALL} END AS overall_health,
      coalesce(healthy, 0) AS healthy, coalesce(moderate, 0) AS moderate, coalesce(stressed, 0) AS stressed, coalesce(critical, 0) AS critical
      FROM base LEFT JOIN latest USING (farm_id) LEFT JOIN scored USING (farm_id)""",
    base="SELECT farm_id, count(*) AS field_count, round(coalesce(sum(area_m2), 0.0) / 10000, 2) AS total_ha, coalesce(string_agg(DISTINCT crop, ',' ORDER BY crop), '') AS crops FROM field GROUP BY 1",
    rows="SELECT farm_id, pass_date, index_name, mean, crop, coalesce(area_m2, 1.0) AS w FROM analysis JOIN field USING (field_id)",
    latest="SELECT farm_id, max(pass_date) AS latest_pass_date FROM rows GROUP BY 1",
    now=f"SELECT farm_id, mean, w, CASE WHEN mean IS NOT NULL THEN {_OWN} END AS st FROM rows JOIN latest USING (farm_id) WHERE pass_date = latest_pass_date AND index_name = 'ndvi'",
    scored="SELECT farm_id, round(sum(mean * w) / nullif(sum(w) FILTER (mean IS NOT NULL), 0), 4) AS score, count(*) FILTER (st = 'healthy') AS healthy, count(*) FILTER (st = 'moderate') AS moderate, count(*) FILTER (st = 'stressed') AS stressed, count(*) FILTER (st = 'critical') AS critical FROM now GROUP BY 1",
)
def farm_summary(spark, sf_dir):
    """A6, A10, Q-01, J1, J2, Q1 to Q3: health summary of every farm."""
    return rollup.farm_summary(view(spark, sf_dir, "field"), view(spark, sf_dir, "analysis"))


@query(
    "SELECT farm_id, pass_date, scene_id, round(sum(mean * w) / sum(w) FILTER (mean IS NOT NULL), 4) AS mean, round(sum(clear_fraction * w) FILTER (mean IS NOT NULL) / sum(w) FILTER (mean IS NOT NULL), 4) AS clear_fraction, count(*) AS analyzed_fields, round(sum(w) FILTER (mean IS NOT NULL) / 10000, 2) AS hectares, "
    + ", ".join(f"round(100 * coalesce(sum(w) FILTER (st = '{s}'), 0) / sum(w) FILTER (mean IS NOT NULL), 1) AS {s}_pct" for s in ("healthy", "moderate", "stressed", "critical"))
    + " FROM rows GROUP BY 1, 2, 3 HAVING count(mean) > 0",
    rows=f"SELECT farm_id, pass_date, scene_id, mean, clear_fraction, coalesce(area_m2, 1.0) AS w, CASE WHEN mean IS NOT NULL THEN {_OWN} END AS st FROM pass_stats JOIN field USING (field_id) WHERE index_name = 'ndvi'",
)
def farm_series(spark, sf_dir):
    """A7, Q-24, F2: area-weighted NDVI series of every farm, a row for each scene of a day."""
    return rollup.farm_series(view(spark, sf_dir, "field"), view(spark, sf_dir, "pass_stats"))


@query(
    """SELECT farm_id, pass_date, field_id, crop, round(coalesce(area_m2, 0.0) / 10000, 2) AS field_area_hectares, round(mean, 4) AS field_value, round(farm_mean, 4) AS farm_average, st AS status,
      concat_ws('/', CASE WHEN low THEN 'underperforming' END, CASE WHEN fallen THEN 'sudden_drop' END) AS anomaly_type,
      concat_ws('; ', CASE WHEN low THEN 'NDVI is ' || round(farm_mean - mean, 2) || ' below farm average (' || round(farm_mean, 2) || ')' END,
        CASE WHEN fallen THEN 'NDVI dropped by ' || round(previous - mean, 2) || ' from ' || round(previous, 2) || ' on ' || strftime(previous_date, '%Y-%m-%d') END) AS detail FROM judged WHERE low OR fallen""",
    rows="SELECT farm_id, field_id, crop, area_m2, pass_date, index_name, mean FROM pass_stats JOIN field USING (field_id)",
    latest="SELECT farm_id, max(pass_date) AS pass_date FROM rows GROUP BY 1",
    now=f"SELECT *, {_OWN} AS st FROM rows JOIN latest USING (farm_id, pass_date) WHERE index_name = 'ndvi' AND mean IS NOT NULL",
    farm_now="SELECT farm_id, sum(mean * coalesce(area_m2, 1.0)) / sum(coalesce(area_m2, 1.0)) AS farm_mean FROM now GROUP BY 1",
    before="SELECT field_id, mean AS previous, pass_date AS previous_date FROM (SELECT r.*, row_number() OVER (PARTITION BY field_id ORDER BY r.pass_date DESC) AS n FROM rows r JOIN latest l ON r.farm_id = l.farm_id AND r.pass_date < l.pass_date WHERE index_name = 'ndvi') x WHERE n = 1",
    judged="SELECT *, mean < farm_mean - 0.15 AS low, coalesce(previous - mean >= 0.2, false) AS fallen FROM now JOIN farm_now USING (farm_id) LEFT JOIN before USING (field_id)",
)
def farm_anomalies(spark, sf_dir):
    """A8, Q-23, J16, W2: fields below their farm or fallen suddenly, in the latest pass over all indices."""
    return rollup.farm_anomalies(view(spark, sf_dir, "field"), view(spark, sf_dir, "pass_stats"))


_KEYS = ", ".join(rollup.PROVENANCE)


@query(
    f"""SELECT farm_id, field_id, {_KEYS}, mean, std, min_val AS min, max_val AS max, p10, p90, clear_fraction, confidence FROM rows
      UNION ALL SELECT farm_id, CAST(NULL AS BIGINT), {_KEYS}, round(sum(mean * w) / sum(w) FILTER (mean IS NOT NULL), 4), round(sum(std * w) / sum(w) FILTER (std IS NOT NULL), 4), min(min_val), max(max_val), min(p10), max(p90),
      round(sum(coalesce(clear_fraction, 0) * w) / sum(w), 4), CASE max(CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 END) WHEN 2 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END FROM rows GROUP BY farm_id, {_KEYS}""",
    rows="SELECT p.*, f.farm_id, coalesce(g.area_m2, 1.0) AS w FROM pass_stats p JOIN field f ON p.field_id = f.field_id LEFT JOIN field_area g ON g.field_id = p.field_id AND g.geometry_version = p.geometry_version",
)
def publish_rollup(spark, sf_dir):
    """Field rows and farm rows, one of these for each provenance."""
    return rollup.publish_rollup(view(spark, sf_dir, "field"), view(spark, sf_dir, "pass_stats"), view(spark, sf_dir, "field_area"))


@query(
    f"SELECT field_id, pass_date, scene_id, min(clear_fraction) AS clear_fraction, CASE WHEN min(clear_fraction) >= 0.8 THEN 'high' WHEN min(clear_fraction) >= 0.5 THEN 'medium' ELSE 'low' END AS confidence, coalesce(max(band) FILTER (index_name = 'ndvi'), arg_min(band, index_name) FILTER (band IS NOT NULL), 'unknown') AS headline, string_agg(index_name || '=' || coalesce(band, 'no clear pixels'), ';' ORDER BY index_name) AS readings FROM r GROUP BY 1, 2, 3",
    r=f"SELECT p.field_id, pass_date, scene_id, index_name, coalesce(clear_fraction, 0) AS clear_fraction, {_case('index_name', 'mean', 'crop')} AS band FROM pass_stats p JOIN field f ON p.field_id = f.field_id",
)
def pass_evidence(spark, sf_dir):
    """What a pass, one scene of a day, shows: least clear fraction, its confidence, each index's band and the headline."""
    rows = view(spark, sf_dir, "pass_stats").join(view(spark, sf_dir, "field").select("field_id", "crop"), "field_id")
    rows = rows.select("field_id", "pass_date", "scene_id", "index_name", F.coalesce("clear_fraction", F.lit(0)).alias("clear_fraction"), X.classify(F.col("index_name"), F.col("mean"), F.col("crop")).alias("band"))
    clear, band = F.min("clear_fraction"), F.col("band")
    line = F.concat("index_name", F.lit("="), F.coalesce("band", F.lit("no clear pixels")))
    headline = F.coalesce(F.max(F.when(F.col("index_name") == "ndvi", band)), F.min_by(band, F.when(band.isNotNull(), F.col("index_name"))), F.lit("unknown"))
    return rows.groupBy("field_id", "pass_date", "scene_id").agg(clear.alias("clear_fraction"), X.confidence(clear).alias("confidence"), headline.alias("headline"), F.array_join(F.array_sort(F.collect_list(line)), ";").alias("readings"))


@query("SELECT field_id, index_name, pass_date, mean, clear_fraction, CAST(row_number() OVER (PARTITION BY field_id, index_name ORDER BY pass_date, scene_id) AS INT) AS n FROM pass_stats")
def field_series(spark, sf_dir):
    """T1, Q-02: each index of a field in order of its passes (n)."""
    n = F.row_number().over(W.partitionBy("field_id", "index_name").orderBy("pass_date", "scene_id"))
    return view(spark, sf_dir, "pass_stats").select("field_id", "index_name", "pass_date", "mean", "clear_fraction", n.alias("n"))


@query("SELECT field_id, pass_date + CAST(scene_id AS INT) AS created, pass_date, index_name, scene_id, provider, formula_version, CAST(row_number() OVER (PARTITION BY field_id ORDER BY pass_date + CAST(scene_id AS INT) DESC, pass_date DESC, index_name, scene_id) AS INT) AS n FROM pass_stats")
def field_audit(spark, sf_dir):
    """T2, Q-05: a field's stored facts, the latest written first (n). A fact is written as many days after its pass as its scene's number."""
    created = F.date_add("pass_date", F.col("scene_id").cast("int"))
    order = W.partitionBy("field_id").orderBy(F.desc("created"), F.desc("pass_date"), "index_name", "scene_id")
    rows = view(spark, sf_dir, "pass_stats").withColumn("created", created)
    return rows.select("field_id", "created", "pass_date", "index_name", "scene_id", "provider", "formula_version", F.row_number().over(order).alias("n"))


@query("SELECT field_id, pass_date, scene_id, clear_fraction FROM (SELECT *, row_number() OVER (PARTITION BY field_id, pass_date ORDER BY clear_fraction DESC, scene_id) AS n FROM analysis) x WHERE n = 1")
def best_scene(spark, sf_dir):
    """W1, T6, Q-03: clearest scene of each field and date."""
    return series.best_scene(view(spark, sf_dir, "analysis")).select("field_id", "pass_date", "scene_id", "clear_fraction")


@query(
    """SELECT field_id, day, before, CAST(before - day AS INT) AS before_gap, after, CAST(after - day AS INT) AS after_gap,
      CASE WHEN after IS NULL OR abs(before - day) <= abs(after - day) THEN coalesce(before, after) ELSE after END AS resolved FROM
      (SELECT r.field_id, r.day, max(pass_date) FILTER (pass_date <= day) AS before, min(pass_date) FILTER (pass_date > day) AS after FROM requests r LEFT JOIN good g ON r.field_id = g.field_id GROUP BY 1, 2) x""",
    requests="SELECT DISTINCT field_id, day FROM activity",
    good="SELECT field_id, pass_date FROM analysis WHERE clear_fraction >= 0.5 GROUP BY 1, 2",
)
def as_of(spark, sf_dir):
    """J8, J14, Q-04, Q9: pass at or before, after, and nearest to each activity."""
    asked = view(spark, sf_dir, "activity").select("field_id", "day").distinct()
    return series.as_of(asked, view(spark, sf_dir, "analysis"))


@query(
    """SELECT day, scene_date, scene_id, CAST(scene_date - day AS INT) AS gap FROM (SELECT day, scene_date, scene_id, row_number() OVER (PARTITION BY day ORDER BY abs(scene_date - day), scene_date, scene_id) AS n
      FROM asked JOIN scenes ON abs(scene_date - day) <= 7) x WHERE n = 1""",
    asked="SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem",
    scenes="SELECT last_day(CAST(o_orderdate AS DATE)) AS scene_date, max(o_orderkey) AS scene_id FROM orders GROUP BY 1",
)
def snap_dates(spark, sf_dir):
    """Nearest scene within seven days of each requested day. A month's last day has the scene."""
    asked = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.to_date("l_shipdate").alias("day")).distinct()
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return series.snap(asked, orders.groupBy(F.last_day(F.to_date("o_orderdate")).alias("scene_date")).agg(F.max("o_orderkey").alias("scene_id")))


_RANK = "CASE {0}.confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"


@query(
    "SELECT field_id, day, status, CASE WHEN status = 'interpolated' THEN before END AS before, CASE WHEN status = 'interpolated' THEN after END AS after, "
    + ", ".join(f"round(CASE status WHEN 'ok' THEN e.{c} WHEN 'interpolated' THEN coalesce((b.{c} + a.{c}) / 2, b.{c}, a.{c}{', 0' if c == 'clear_fraction' else ''}) END, 6) AS {c}" for c in (*series.STATS, "clear_fraction"))
    + f""", CASE status WHEN 'ok' THEN e.confidence WHEN 'interpolated' THEN CASE WHEN b.confidence IS NULL OR a.confidence IS NULL THEN coalesce(b.confidence, a.confidence) WHEN {_RANK.format("b")} <= {_RANK.format("a")} THEN b.confidence ELSE a.confidence END END AS confidence,
      CASE status WHEN 'ok' THEN e.resolution_m WHEN 'interpolated' THEN greatest(b.resolution_m, a.resolution_m) END AS resolution_m FROM
      (SELECT *, CASE WHEN e IS NOT NULL THEN 'ok' WHEN before IS NOT NULL AND after IS NOT NULL THEN 'interpolated' ELSE 'no_pass' END AS status FROM
       (SELECT r.field_id, r.day, max(v) FILTER (pass_date = day) AS e, arg_max(v, pass_date) FILTER (pass_date < day) AS b, arg_min(v, pass_date) FILTER (pass_date > day) AS a, max(pass_date) FILTER (pass_date < day) AS before, min(pass_date) FILTER (pass_date > day) AS after
        FROM requests r LEFT JOIN rows p ON r.field_id = p.field_id GROUP BY 1, 2) x) y""",
    requests="SELECT DISTINCT field_id, day FROM activity",
    rows=f"SELECT field_id, pass_date, {{{', '.join(repr(c) + ': ' + c for c in (*series.STATS, 'clear_fraction', 'confidence', 'resolution_m'))}}} AS v FROM pass_stats WHERE index_name = 'ndvi'",
)
def interpolated_passes(spark, sf_dir):
    """J13, A20 to A22, Q-07, Q11: statistics at each requested day, of a pass or between two."""
    asked = view(spark, sf_dir, "activity").select("field_id", "day").distinct()
    return series.interpolate(asked, view(spark, sf_dir, "pass_stats").where("index_name = 'ndvi'"))


_RULES = " UNION ALL ".join(
    f"SELECT field_id, index_name, pass_date, '{code}' AS code, {level} AS level, {value} AS value FROM last WHERE {when}"
    for code, level, value, when in (
        ("ndvi_drop_vs_prior", "CASE WHEN fall >= 0.3 THEN 'critical' ELSE 'warning' END", "fall", "index_name = 'ndvi' AND fall >= 0.15"),
        ("ndvi_below_baseline", "'warning'", "under", "index_name = 'ndvi' AND usable >= 3 AND under >= 0.15"),
        ("ndmi_water_stress", "'warning'", "mean", "index_name = 'ndmi' AND mean <= 0.0"),
        ("anomaly", "'warning'", "z", "index_name IN ('ndre', 'ndmi') AND usable >= 5 AND abs(z) >= 2.0"),
    )
)


@query(
    _RULES + " UNION ALL SELECT field_id, NULL, NULL, 'water_deficit', 'warning', precip_mm FROM field_water WHERE et0_mm > 0 AND precip_mm < 0.5 * et0_mm",
    w="""SELECT *, lag(mean) OVER o AS before, quantile_cont(mean, 0.5) OVER (o ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS base,
      avg(mean) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mu, stddev_pop(mean) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sigma,
      count(mean) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS usable, lead(pass_date) OVER o AS nxt
      FROM analysis WHERE clear_fraction >= 0.5 WINDOW o AS (PARTITION BY field_id, index_name ORDER BY pass_date)""",
    last="SELECT *, round(before - mean, 6) AS fall, round(base - mean, 6) AS under, round((mean - mu) / CASE WHEN sigma > 1e-12 THEN sigma END, 4) AS z FROM w WHERE nxt IS NULL",
)
def field_alerts(spark, sf_dir):
    """Q-21, W3 to W6, F1, U5, Q15: drop, baseline, water-stress, z-score and water-deficit alerts."""
    return series.alerts(view(spark, sf_dir, "analysis")).unionByName(series.water_deficit(view(spark, sf_dir, "field_water")))


@query(
    """SELECT field_id, peak_date, round(peak, 6) AS peak_value, round(base, 6) AS base_value, round(peak - base, 6) AS amplitude, start_date, end_date, CAST(end_date - start_date AS INT) AS season_days, integral FROM
      (SELECT field_id, any_value(peak_date) AS peak_date, any_value(peak) AS peak, any_value(base) AS base, min(pass_date) FILTER (pass_date <= peak_date AND low = 1 AND mean >= level) AS start_date,
       min(pass_date) FILTER (pass_date > peak_date AND mean <= level) AS end_date, round(sum(area), 8) AS integral FROM c GROUP BY 1) x""",
    a="SELECT *, min(mean) OVER p AS base, max(mean) OVER p AS peak, count(*) OVER p AS n FROM readings WHERE mean IS NOT NULL AND index_name = 'click' WINDOW p AS (PARTITION BY field_id)",
    b="SELECT *, min(pass_date) FILTER (mean = peak) OVER (PARTITION BY field_id) AS peak_date, base + 0.5 * (peak - base) AS level FROM a WHERE n >= 3",
    c="SELECT *, max(CAST(mean < level AS INT)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low, (lead(pass_date) OVER o - pass_date) * ((lead(mean) OVER o - base) + (mean - base)) / 2 AS area FROM b WINDOW o AS (PARTITION BY field_id ORDER BY pass_date)",
)
def phenology(spark, sf_dir):
    """W7, Q-25, Q20: season start, peak, end and integral."""
    return series.phenology(view(spark, sf_dir, "readings").where("index_name = 'click'"))


@query(
    """SELECT field_id, day, activity, baseline_date, round(b, 10) + 0.0 AS baseline, round(r, 10) + 0.0 AS response, response_date, passes, round(r - b, 10) + 0.0 AS delta FROM
      (SELECT a.field_id, day, activity, max(pass_date) FILTER (pass_date <= day) AS baseline_date, arg_max(mean, pass_date) FILTER (pass_date <= day) AS b, avg(mean) FILTER (pass_date > day AND pass_date <= day + 30) AS r,
       max(pass_date) FILTER (pass_date > day AND pass_date <= day + 30) AS response_date, count(mean) FILTER (pass_date > day AND pass_date <= day + 30) AS passes FROM acts a LEFT JOIN p ON a.field_id = p.field_id GROUP BY 1, 2, 3) x""",
    acts="SELECT DISTINCT * FROM activity",
    p="SELECT field_id, pass_date, mean FROM readings WHERE index_name = 'click' AND mean IS NOT NULL",
)
def activity_response(spark, sf_dir):
    """NDVI before and after each activity."""
    return series.correlate(view(spark, sf_dir, "activity").distinct(), view(spark, sf_dir, "readings").where("index_name = 'click'"))


@query(
    "SELECT field_id, index_name, count(*) AS passes, round(avg(mean) FILTER (i > n // 2) - avg(mean) FILTER (i <= n // 2), 10) + 0.0 AS change FROM r WHERE n >= 4 GROUP BY 1, 2",
    r="SELECT *, row_number() OVER (PARTITION BY field_id, index_name ORDER BY pass_date) AS i, count(*) OVER (PARTITION BY field_id, index_name) AS n FROM analysis WHERE mean IS NOT NULL",
)
def trend(spark, sf_dir):
    """Second half against first half of a series."""
    return series.trend(view(spark, sf_dir, "analysis"))


@query(
    "SELECT field_id, pass_date, scene_id, clear_fraction FROM (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY CASE WHEN clear_fraction >= 0.97 THEN rn END NULLS LAST, clear_fraction DESC, rn) AS p FROM r WHERE rn <= 3) x WHERE p = 1",
    r="SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY pass_date DESC, scene_id) AS rn FROM analysis WHERE index_name = 'ndvi'",
)
def latest_clear_pass(spark, sf_dir):
    """T5, Q-06, Q12: newest of three passes that is clear enough, else the clearest."""
    rows = view(spark, sf_dir, "analysis").where("index_name = 'ndvi'")
    return series.recent(rows, 3, 0.97).select("field_id", "pass_date", "scene_id", "clear_fraction")


@query(
    "SELECT field_id, pass_date, scene_id, rn FROM r WHERE rn <= 60",
    r="SELECT *, CAST(row_number() OVER (PARTITION BY field_id ORDER BY pass_date DESC, scene_id) AS INT) AS rn FROM analysis WHERE index_name = 'ndvi'",
)
def recent_passes(spark, sf_dir):
    """The 60 most recent passes of each field, newest first by rn."""
    return series.recent(view(spark, sf_dir, "analysis").where("index_name = 'ndvi'"), 60).select("field_id", "pass_date", "scene_id", "rn")


@query(
    "SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS events FROM b GROUP BY 1, 2",
    a="SELECT *, CASE WHEN ts - lag(ts) OVER o <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)",
    b="SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a",
)
def sessions(spark, sf_dir):
    """Runs of events with gaps of 30 minutes at most."""
    return series.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", F.col("ts")).select("user_id", "run", "events")
