"""Cutting lineage where a loop reads its own result."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: what spark.checkpoint.dir names; a temporary one only where that is unset and Spark runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lineage"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of each end of the undirected edges (a, b); comp is the least id of its component.

    Each round links every node to the least node seen by itself and its
    neighbours, and then to that one's own, so chains shorten by half or more.
    """
    e = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo <> hi").distinct()
    while True:
        ends = e.unionAll(e.select(F.col("hi").alias("lo"), F.col("lo").alias("hi"))).select(F.col("lo").alias("id"), F.col("hi").alias("other"))
        least = checkpointed(ends.groupBy("id").agg(F.least("id", F.min("other")).alias("comp")))
        far = least.select(F.col("id").alias("comp"), F.col("comp").alias("further"))
        least = least.join(far, "comp", "left").select("id", F.coalesce("further", "comp").alias("comp"))
        moved = ends.join(least, "id").join(least.select(F.col("id").alias("other"), F.col("comp").alias("its")), "other").where("comp <> its")
        if moved.isEmpty():
            return least
        links = moved.select(F.least("comp", "its").alias("lo"), F.greatest("comp", "its").alias("hi"))
        e = checkpointed(links.unionAll(least.where("id <> comp").select(F.col("comp").alias("lo"), F.col("id").alias("hi"))).distinct())
