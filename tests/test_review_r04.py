"""What the fourth review found, in small."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from verdure.functions import columns as X
from verdure.operators import rasters

THREE = [1 / 3, 7 / 15, 0.75]


def test_means_do_not_depend_on_the_order_of_rows(spark):
    """plain sums of these three differ by their order, and a colour with them; pictures of every order are the same."""
    assert len({sum_ / 3 for a, b, c in itertools.permutations(THREE) for sum_ in [(a + b) + c]}) > 1
    orders = list(itertools.permutations(((0, 0), (1, 0), (1, 1)), 3))
    rows = [(k, 2 * i + r, 2 * j + c, THREE[r + c]) for k, order in enumerate(orders) for i in range(8) for j in range(8) for r, c in order]
    px = spark.createDataFrame(rows, "k int, px_row int, px_col int, value double").coalesce(1)
    grids = spark.createDataFrame([(k, 300_000.0, 8_030_000.0, 10.0, 32736, 16, 16) for k in range(6)], "k int, x0 double, y0 double, res double, epsg int, height int, width int")
    for made in (rasters.preview(px, grids, ["k"], longest=8), rasters.preview(px, grids, ["k"], longest=1), rasters.tiles(px, grids, ["k"], [12])):
        got = rasters.painted(made, "ndvi").select("k", "value", F.col("rgba").cast("string").alias("rgba")).collect()
        assert len({(r.value, r.rgba) for r in got}) == 1 and {r.k for r in got} == set(range(6))


def test_steady_mean_of_any_doubles(spark):
    sets = {"none": [None, None], "one": [0.1, None], "small": [1e-30, 3e-30, 2e-30], "huge": [1e300, 1e300, -1e300], "large": [1e17] * 40, "mixed": [1e12, 0.5, 0.25], "plain": [0.1] * 10}
    df = spark.createDataFrame([(k, v) for k, vs in sets.items() for v in vs] + [("nan", float("nan"))] * 3, "k string, v double")
    got = {r.k: r.m for r in df.groupBy("k").agg(X.steady_mean(F.col("v")).alias("m")).collect()}
    assert math.isnan(got["nan"]) and got["none"] is None and got["plain"] == 0.1
    assert {k: got[k] for k in sets if k != "none"} == pytest.approx({k: sum(v for v in vs if v is not None) / sum(v is not None for v in vs) for k, vs in sets.items() if k != "none"}, abs=1e-20)
