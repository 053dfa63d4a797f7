"""Domain tables laid over the generic test tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
INDEX = "CASE l_linenumber % 5 WHEN 0 THEN 'ndvi' WHEN 1 THEN 'evi2' WHEN 2 THEN 'savi' WHEN 3 THEN 'ndre' ELSE 'ndmi' END"

VIEWS = {
    "farm": "SELECT n_nationkey AS farm_id, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey",
    "field": """SELECT c_custkey AS field_id, c_nationkey AS farm_id,
      CASE c_mktsegment WHEN 'BUILDING' THEN 'maize' WHEN 'AUTOMOBILE' THEN 'tobacco' WHEN 'MACHINERY' THEN 'sorghum' WHEN 'FURNITURE' THEN 'cotton' END AS crop,
      CASE WHEN c_acctbal > 0 THEN c_acctbal * 100 END AS area_m2, CAST(1 + c_custkey % 3 AS INT) AS geometry_version FROM customer""",
    "analysis": f"""SELECT o_custkey AS field_id, CAST(o_orderdate AS DATE) AS pass_date, {INDEX} AS index_name,
      round(avg((l_quantity - 10) / 50), 6) + 0.0 AS mean, round(min((l_quantity - 10) / 50), 6) + 0.0 AS min_val, round(max((l_quantity - 10) / 50), 6) + 0.0 AS max_val,
      round(max(1 - 10 * l_tax), 6) + 0.0 AS clear_fraction, CAST(min(1 + l_partkey % 3) AS INT) AS geometry_version, max(o_orderkey) AS scene_id
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""",
    "readings": """SELECT user_id AS field_id, CAST(ts AS DATE) AS pass_date, event_type AS index_name, round(avg(value) / 500, 6) AS mean,
      round(0.3 + 0.1 * (count(*) % 8), 6) AS clear_fraction FROM events GROUP BY 1, 2, 3""",
    "pixel": """SELECT l_suppkey AS field_id, CAST(l_orderkey % 64 AS INT) AS px_row, CAST(l_partkey % 64 AS INT) AS px_col,
      1000 + l_quantity * 100 AS b08, 1000 + round(l_discount * 20000) AS b04, 1500 + l_quantity * 40 AS b05, 1200 + l_quantity * 60 AS b11,
      l_linenumber + 3 AS scl, l_returnflag <> 'R' AS inside FROM lineitem""",
    "weather": """SELECT CAST(o_orderdate AS DATE) AS day, CAST(10 + min(o_orderkey) % 9 AS DOUBLE) AS tmin_c, CAST(16 + min(o_orderkey) % 9 + max(o_orderkey) % 9 AS DOUBLE) AS tmax_c,
      CAST(min(o_custkey) % 23 AS DOUBLE) AS precip_mm FROM orders GROUP BY 1""",
    "activity": "SELECT user_id AS field_id, CAST(ts AS DATE) AS day, event_type AS activity FROM events WHERE event_type = 'purchase'",
}

# passes with what publishing needs: two or three scenes of a day, statistics that are missing here and there, provenance
VIEWS["pass_stats"] = f"""SELECT field_id, pass_date, index_name, CASE WHEN scene_id % 13 > 0 THEN mean END AS mean, min_val, max_val,
      CASE WHEN scene_id % 7 > 0 THEN round((max_val - min_val) / 4, 6) + 0.0 END AS std, round(min_val + 0.01, 6) + 0.0 AS p10, CASE WHEN scene_id % 5 > 0 THEN round(max_val - 0.01, 6) + 0.0 END AS p90,
      CASE WHEN scene_id % 17 > 0 THEN clear_fraction END AS clear_fraction, geometry_version, scene_id % 3 AS scene_id,
      CASE WHEN scene_id % 2 = 0 THEN 'server' ELSE 'window' END AS provider, concat('S', CAST(scene_id % 3 AS STRING)) AS provider_scene_id, '1' AS formula_version,
      CASE WHEN scene_id % 4 = 0 THEN 'backfill' ELSE 'live' END AS processing_mode, CAST(CASE WHEN index_name IN ('ndre', 'ndmi') THEN 20 ELSE 10 END AS INT) AS resolution_m,
      CASE WHEN scene_id % 3 = 0 THEN NULL WHEN clear_fraction >= 0.8 THEN 'high' WHEN clear_fraction >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM ({VIEWS["analysis"]}) every_pass"""
# areas of a field's first two geometry versions; the third is unknown
VIEWS["field_area"] = """SELECT c_custkey AS field_id, CAST(1 AS INT) AS geometry_version, CASE WHEN c_acctbal > 0 THEN c_acctbal * 100 END AS area_m2 FROM customer
      UNION ALL SELECT c_custkey, CAST(2 AS INT), CASE WHEN c_acctbal > 0 THEN c_acctbal * 120 END FROM customer"""
VIEWS["readings_by_field"] = """SELECT user_id AS field_id, CASE event_id % 5 WHEN 0 THEN 'ndvi' WHEN 1 THEN 'evi2' WHEN 2 THEN 'savi' WHEN 3 THEN 'ndre' ELSE 'ndmi' END AS index_name,
      round(value * (0.2 + user_id % 7 * 0.15) / 100 - CASE event_id % 5 WHEN 3 THEN 0.2 WHEN 4 THEN 0.3 ELSE 0 END, 6) AS mean FROM events"""
VIEWS["field_water"] = "SELECT c_custkey AS field_id, CAST(c_custkey % 50 AS DOUBLE) AS precip_mm, CAST(c_custkey % 90 AS DOUBLE) AS et0_mm FROM customer"


def needed(sql: str) -> list[str]:
    """The views that a statement names, those that they need first."""
    return [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]


def duck(sql: str, **more: str) -> str:
    """sql with the views that it names, for DuckDB."""
    text = " ".join([sql, *more.values()])
    views = {v: VIEWS[v] for v in needed(text)} | more
    head = ", ".join(f"{k} AS ({v})" for k, v in views.items())
    return f"WITH {head} {sql}" if head else sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table as a DataFrame."""
    sql = VIEWS[name]
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
