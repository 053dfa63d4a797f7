"""Operator 4: mixing sources to target weights by Pfair scheduling.

A source's rows, in an order given by their ids' hashes, form blocks of equal
size. Of a source with weight w (its share of the slots), block j is released
at floor(j / w) and due at ceil((j + 1) / w); in every slot the released block
with the earliest deadline goes next. So after any number of slots each source
is less than one block from its share, as long as no source has run out.

Weights are whole ticks of ``period`` slots, so the schedule repeats: one period
is laid out on the driver, which depends on the weights alone and has ``period``
entries, and every block finds its slot by arithmetic. Rows are numbered within
buckets that are ranges of the hash, so a hot source is spread over many tasks.

Results: every row once, with its source's block, the block's release, deadline
and slot, and its place in the block (both from 0). When a source runs out, its slots stay
empty and the others keep their proportions. Rows whose source has no weight
(null is a source like any other) have null release, deadline and slot: they
come after all others. Rows of equal id and text are interchangeable.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

PERIOD, BLOCK_ROWS = 1000, 8
#: Ticks a source in a period at least; sources that root_weights takes: the schedule, so many ticks, is laid out on the driver.
TICKS, MOST_SOURCES = 4, 1 << 18
#: Ticks of a schedule that is broadcast; a longer one is joined by a shuffle.
BROADCAST_TICKS = 1 << 17
#: Rows of a bucket, at most about this many; fewer where that keeps all tasks busy.
BUCKET_ROWS = 1 << 16
OWN = ["block", "release", "deadline", "slot", "place"]


def schedule(weights: dict[str | None, int]) -> list[tuple[str | None, int, int, int, int]]:
    """(source, block, release, deadline, slot) over one period, earliest deadline first, ties by name."""
    if any(w < 1 for w in weights.values()):
        raise ValueError("a weight is one tick at least")
    period = sum(weights.values())
    names = sorted(weights, key=lambda s: (s is not None, s or ""))
    waiting = [(0, i, 0) for i in range(len(names))]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []  # deadline, source, block, release
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            release, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // weights[names[i]]), i, j, release))
        deadline, i, j, release = heapq.heappop(ready)
        out.append((names[i], j, release, deadline, slot))
        if j + 1 < weights[names[i]]:
            heapq.heappush(waiting, ((j + 1) * period // weights[names[i]], i, j + 1))
    return out


def root_weights(df: DataFrame, source: str = "source", period: int = PERIOD) -> dict[str | None, int]:
    """Ticks in proportion to the root of each source's rows, which lifts small sources; one tick at least.

    Each source has one tick, and the rest of the period is shared out by the
    largest remainder (ties to more rows, then by name). The period has TICKS
    ticks a source at least. More than MOST_SOURCES sources are an error.
    """
    rows = df.groupBy(F.col(source).alias("s")).agg(F.count("*").alias("n")).withColumn("q", F.floor(F.sqrt("n") * 1000)).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    total, spare = sum(r.q for r in rows), max(period, TICKS * len(rows)) - len(rows)
    out = {r.s: 1 + spare * r.q // total for r in rows}
    by_rest = sorted(rows, key=lambda r: (-(spare * r.q % total), -r.n, r.s is not None, r.s or ""))
    for r in by_rest[: spare + len(rows) - sum(out.values())]:
        out[r.s] += 1
    return out


def mix(df: DataFrame, weights: dict[str | None, int], source: str = "source", key: str = "doc_id", text: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key and source of every row, with OWN columns (see above)."""
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("k"), F.col(source).alias("s"), F.xxhash64(text).alias("x")).withColumn("h", F.md5(F.coalesce(F.col("k").cast("string"), F.lit(""))))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # how many buckets a source needs; one row a source, and no more sources than the weights allow without a shuffle
    sizes = rows.groupBy("s").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    per_bucket = max(1, min(BUCKET_ROWS, total // (4 * tasks)))
    sizes = sizes.select(F.col("s").alias("s0"), F.ceil(F.col("n") / per_bucket).cast("long").alias("buckets"))
    first = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    rows = rows.join(sizes, F.col("s").eqNullSafe(F.col("s0"))).withColumn("b", F.floor(first * F.col("buckets") / F.lit(1 << 32)).cast("long")).drop("s0", "buckets")
    before = rows.groupBy("s", "b").agg(F.count("*").alias("n"))
    before = before.select(F.col("s").alias("s1"), F.col("b").alias("b1"), (F.sum("n").over(W.partitionBy("s").orderBy("b").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("start"))
    rows = rows.withColumn("r", F.row_number().over(W.partitionBy("s", "b").orderBy("h", "k", "x")))
    rows = rows.join(before, F.col("s").eqNullSafe(F.col("s1")) & (F.col("b") == F.col("b1"))).withColumn("r", F.col("start") + F.col("r") - 1)
    rows = rows.withColumn("block", F.floor(F.col("r") / block_rows)).withColumn("place", F.col("r") % block_rows)

    period = sum(weights.values())
    kind = df.schema[source].dataType
    plan = spark.createDataFrame(
        [(s, j, r, d, t, weights[s]) for s, j, r, d, t in schedule(weights)],
        T.StructType([T.StructField("s2", kind), *(T.StructField(n, T.LongType()) for n in ("j", "r0", "d0", "t0", "w"))]),
    )
    ticks = plan.groupBy("s2", "w").agg(F.collect_list(F.struct("j", "r0", "d0", "t0")).alias("slots")).withColumn("slots", F.array_sort("slots"))
    ticks = F.broadcast(ticks) if period <= BROADCAST_TICKS else ticks
    rows = rows.join(ticks, F.col("s").eqNullSafe(F.col("s2")), "left")
    turn, at = F.floor(F.col("block") / F.col("w")) * period, F.get("slots", (F.col("block") % F.col("w")).cast("int"))
    return rows.select(
        F.col("k").alias(key),
        F.col("s").alias(source),
        F.col("x").alias("text_hash"),
        "block",
        (turn + at["r0"]).alias("release"),
        (turn + at["d0"]).alias("deadline"),
        (turn + at["t0"]).alias("slot"),
        "place",
    )


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document's slot when the sources are mixed by the roots of their sizes."""
    from verdure.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, root_weights(docs)).drop("text_hash")


OP4_SQL = f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS c FROM documents GROUP BY source),
roots AS (SELECT source, c, CAST(floor(sqrt(c) * 1000) AS BIGINT) AS q FROM sizes),
spare AS (SELECT greatest({PERIOD}, {TICKS} * count(*)) AS period, greatest({PERIOD}, {TICKS} * count(*)) - count(*) AS rest, sum(q) AS total FROM roots),
shares AS (
  SELECT source, 1 + CAST(rest * q // total AS BIGINT) AS w, row_number() OVER (ORDER BY source NULLS FIRST) AS i,
         row_number() OVER (ORDER BY rest * q % total DESC, c DESC, source NULLS FIRST) AS turn
  FROM roots, spare),
weights AS (SELECT source, i, CAST(w + CASE WHEN turn <= (SELECT period FROM spare) - (SELECT sum(w) FROM shares) THEN 1 ELSE 0 END AS BIGINT) AS w FROM shares),
lists AS (SELECT list(w ORDER BY i) AS ws FROM weights),
slots(t, done, pick) AS (
  SELECT 0, list_transform(ws, lambda x: 0), CAST(0 AS BIGINT) FROM lists
  UNION ALL
  SELECT t + 1, list_transform(done, lambda x, i: x + CASE WHEN i = p THEN 1 ELSE 0 END), p
  FROM (SELECT t, done, list_min(list_transform(list_filter(range(1, len(ws) + 1), lambda i: done[i] < ws[i] AND done[i] * period // ws[i] <= t),
                                 lambda i: ((done[i] + 1) * period + ws[i] - 1) // ws[i] * 100000 + i)) % 100000 AS p
        FROM slots, lists, spare WHERE t < period)),
plan AS (SELECT source, w, t - 1 AS slot, done[pick] - 1 AS j FROM slots JOIN weights ON i = pick WHERE t > 0),
rows AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS r FROM documents)
SELECT doc_id, rows.source, r // {BLOCK_ROWS} AS block, r // {BLOCK_ROWS} * period // w AS release,
       ((r // {BLOCK_ROWS} + 1) * period + w - 1) // w AS deadline,
       r // {BLOCK_ROWS} // w * period + slot AS slot, r % {BLOCK_ROWS} AS place
FROM spare, rows JOIN plan ON rows.source IS NOT DISTINCT FROM plan.source AND (r // {BLOCK_ROWS}) % w = j
"""
