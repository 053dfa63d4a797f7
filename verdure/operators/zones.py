"""M1 to M5: productivity zones by k-means over each field's temporal pixel means, and their polygons."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from verdure.operators import planar
from verdure.operators.lineage import checkpointed, components
from verdure.operators.overlay import MULTI, boxes, packed

#: Rows of a raster whose runs one task joins.
BAND_ROWS = 64


def kmeans(x: np.ndarray, k: int, seed: int = 0, rounds: int = 100, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Labels by ascending centre, and the centres, of one-dimensional data; an empty cluster keeps its centre."""
    k = min(k, len(x))
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    while len(centres) < k:
        d = np.min((x[:, None] - np.array(centres)) ** 2, axis=1)
        centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() else x[rng.integers(len(x))])
    c = np.sort(np.array(centres, float))
    for _ in range(rounds):
        label = np.abs(x[:, None] - c).argmin(1)
        new = np.array([x[label == i].mean() if (label == i).any() else c[i] for i in range(k)])
        moved, c = np.abs(new - c).max(), new
        if moved <= tol:
            break
    order = np.argsort(c, kind="stable")
    rank = np.empty(k, int)
    rank[order] = np.arange(k)
    return rank[np.abs(x[:, None] - c).argmin(1)], c[order]


def temporal_means(pixels: DataFrame, min_valid: int = 1) -> DataFrame:
    """M1: (field_id, px_row, px_col, mean) over the valid observations of each pixel; pixels with fewer than min_valid are left out."""
    return pixels.groupBy("field_id", "px_row", "px_col").agg(F.avg("value").alias("mean"), F.count("value").alias("n")).where(F.col("n") >= min_valid).drop("n")


def productivity_zones(pixels: DataFrame, k: int = 3, seed: int = 0, min_valid: int = 1) -> DataFrame:
    """(field_id, px_row, px_col, mean, zone): a field's pixels are averaged over time by Spark; one field, bounded by its size, is clustered in one task."""
    means = temporal_means(pixels, min_valid)

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["px_row", "px_col"]).reset_index(drop=True)
        rows["zone"] = kmeans(rows["mean"].to_numpy(), k, seed)[0].astype("int32")
        return rows

    kinds = dict(means.dtypes)
    return means.groupBy("field_id").applyInPandas(cluster, f"field_id {kinds['field_id']}, px_row {kinds['px_row']}, px_col {kinds['px_col']}, mean double, zone int")


def _joined(rows: list[tuple[int, int, int, int]]) -> list[int]:
    """A code of the part that each run (row, first, last, zone) belongs to, runs of neighbouring rows being one part where they touch: the least of row * 2^31 + first."""
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    order = sorted(range(len(rows)), key=lambda i: rows[i])
    by_row: dict[int, list[int]] = {}
    for i in order:
        by_row.setdefault(rows[i][0], []).append(i)
    for r, own in by_row.items():
        above, j = by_row.get(r - 1, []), 0
        for i in own:
            while j < len(above) and rows[above[j]][2] < rows[i][1]:
                j += 1
            k = j
            while k < len(above) and rows[above[k]][1] <= rows[i][2]:
                if rows[above[k]][3] == rows[i][3]:
                    a, b = root(i), root(above[k])
                    parent[max(a, b, key=lambda x: rows[x])] = min(a, b, key=lambda x: rows[x])
                k += 1
    return [rows[root(i)][0] * (1 << 31) + rows[root(i)][1] for i in range(len(rows))]


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int]]]]:
    """Batches of sorted rows cut anew, so that no group of equal values is cut, each with its groups' first and last places."""
    rest = None
    for more in chain(batches, [None]):
        if more is None:
            rows = rest
        else:
            rows = more if rest is None else pa.concat_batches([rest, more])
        if rows is None or not rows.num_rows:
            continue
        starts = np.zeros(rows.num_rows, bool)
        starts[0] = True
        for k in by:
            v = rows.column(k)
            a, b = v.slice(1), v.slice(0, len(v) - 1)
            differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
            starts[1:] |= differ.to_numpy(zero_copy_only=False)
        at = np.flatnonzero(starts).tolist()
        if more is None:
            at.append(rows.num_rows)
        else:
            # the last group may go on
            rest, rows = rows.slice(at[-1]), rows.slice(0, at[-1])
        if rows.num_rows:
            yield rows, list(pairwise(at))


def zone_polygons(labels: DataFrame, keys: list[str], grids: DataFrame | None = None) -> DataFrame:
    """M5: keys, zone, pixels, geometry of every connected area of one zone (over edges, not corners), with holes.

    labels: keys, px_row, px_col, zone; pixels with a null zone are in none.
    Spark makes runs of equal pixels in a row; runs of BAND_ROWS rows are joined
    in a task, many of them one after the other, bands by connected components over the runs on their borders, and
    each area is traced by itself. With grids (keys, x0, y0, res) coordinates
    are the grid's, else columns and minus rows. A repeated pixel counts once, with its least zone.
    """
    kinds = ", ".join(f"{k} {labels.schema[k].dataType.simpleString()}" for k in keys)
    px = labels.where("zone IS NOT NULL").groupBy(*keys, F.col("px_row").cast("bigint").alias("row"), F.col("px_col").cast("bigint").alias("col")).agg(F.min("zone").cast("bigint").alias("zone"))
    line = W.partitionBy(*keys, "row").orderBy("col")
    fresh = F.coalesce((F.col("col") != F.lag("col").over(line) + 1) | (F.col("zone") != F.lag("zone").over(line)), F.lit(True))
    runs = px.withColumn("run", F.sum(fresh.cast("int")).over(line)).groupBy(*keys, "row", "run").agg(F.min("col").alias("first"), F.max("col").alias("last"), F.min("zone").alias("zone"))
    runs = runs.drop("run").withColumn("band", F.floor(F.col("row") / BAND_ROWS))

    bands = [*keys, "band"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in _groups(batches, bands):
            runs_ = [rows.column(c).to_pylist() for c in ("row", "first", "last", "zone")]
            part = [p for i, j in group for p in _joined(list(zip(*(c[i:j] for c in runs_), strict=True)))]
            yield rows.append_column("part", pa.array(part, pa.int64()))

    runs = runs.select(*bands, "row", "first", "last", "zone").repartition(*bands).sortWithinPartitions(*bands)
    runs = runs.mapInArrow(joined, f"{kinds}, band bigint, row bigint, first bigint, last bigint, zone bigint, part bigint").drop("band")
    # read three times
    named = checkpointed(runs.withColumn("node", F.to_json(F.struct(*keys, "part"), {"ignoreNullFields": "false"})))
    upper = named.where(F.pmod("row", F.lit(BAND_ROWS)) == BAND_ROWS - 1).select(*keys, (F.col("row") + 1).alias("row"), "zone", F.col("first").alias("f"), F.col("last").alias("l"), F.col("node").alias("a"))
    lower = named.where(F.pmod("row", F.lit(BAND_ROWS)) == 0)
    edges = lower.join(upper, [*keys, "row", "zone"]).where("first <= l AND f <= last").select("a", F.col("node").alias("b"))
    whole = named.join(components(edges).withColumnRenamed("id", "node"), "node", "left").withColumn("area", F.coalesce("comp", "node"))

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in _groups(batches, ["area"]):
            names = [*keys, "zone", "pixels", "geometry"]
            # areas of a single run, the most, are boxes
            at = np.array(group)
            alone = at[:, 1] - at[:, 0] == 1
            if alone.any():
                lone = rows.take(pa.array(at[alone, 0]))
                row, first, last = (lone.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("row", "first", "last"))
                x, y = np.stack([first, last + 1, last + 1, first, first], 1), np.stack([-row - 1, -row - 1, -row, -row, -row - 1], 1)
                yield pa.RecordBatch.from_arrays([*(lone.column(k) for k in [*keys, "zone"]), pa.array((last - first + 1).astype(np.int64)), boxes(x, y)], names)
            group = [g for g, one in zip(group, alone, strict=True) if not one]
            if group:
                runs_ = [rows.column(c).to_pylist() for c in ("row", "first", "last")]
                own = [list(zip(*(c[i:j] for c in runs_), strict=True)) for i, j in group]
                sizes = pa.array([sum(b - a + 1 for _, a, b in one) for one in own], pa.int64())
                starts = pa.array([i for i, _ in group], pa.int64())
                yield pa.RecordBatch.from_arrays([*(rows.column(k).take(starts) for k in [*keys, "zone"]), sizes, packed([planar.traced(one) for one in own])], names)

    # each area whole in one task
    whole = whole.select(*keys, "area", "row", "first", "last", "zone").repartition("area").sortWithinPartitions("area", "row", "first")
    out = whole.mapInArrow(trace, f"{kinds}, zone bigint, pixels bigint, geometry {MULTI}")
    if grids is None:
        return out
    place = lambda p: F.struct((F.col("x0") + p["x"] * F.col("res")).alias("x"), (F.col("y0") + p["y"] * F.col("res")).alias("y"))
    moved = F.transform("geometry", lambda g: F.transform(g, lambda r: F.transform(r, place)))
    return out.join(grids.select(*keys, "x0", "y0", "res"), keys).select(*keys, "zone", "pixels", moved.alias("geometry"))
