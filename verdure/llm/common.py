"""What the training-data operators share: reading, checkpoints, hashed counts, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1024
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 500


def small_batches(spark: SparkSession) -> None:
    """For queries: batches of at most BATCH_ROWS rows in this session, so that long texts don't pile up between Spark and Python."""
    if not 0 < int(spark.conf.get(BATCH_CONF)) <= BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A query's table."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder: what the session's ``spark.checkpoint.dir`` names.

    A temporary one is used only where that setting is absent and Spark runs in
    one process, as in local tests; a cluster without it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read back."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a compressed Parquet table in a new folder of the shared checkpoint folder, so that each later step reads its own columns only."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow; the session's own batch size holds."""
    return df.mapInArrow(function, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def hashed_counts(df: DataFrame, features, bins: int) -> np.ndarray:
    """Exact number of rows of df that have each hashed feature bin.

    features(text) gives a row's distinct bins. Every task adds up its own
    vector of fixed size and emits the non-zero part in chunks of CHUNK bins;
    the driver receives ``bins`` integers, whatever the input's size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bins, np.int64)
        for batch in batches:
            for text in texts_of(batch):
                total[features(text)] += 1
        used = np.flatnonzero(total)
        chunks = np.split(used, np.searchsorted(used, np.arange(CHUNK, bins, CHUNK)))
        chunks = [c for c in chunks if len(c)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(c[0]) // CHUNK for c in chunks], pa.int32()),
                pa.array([(c % CHUNK).astype(np.int16) for c in chunks], pa.list_(pa.int16())),
                pa.array([total[c].astype(np.int32) for c in chunks], pa.list_(pa.int32())),
            ],
            names=["chunk", "bin", "n"],
        )

    def add(key, rows):
        total = np.zeros(CHUNK, np.int64)
        at = rows.column("bin").combine_chunks().flatten().to_numpy().astype(np.int64)
        np.add.at(total, at, rows.column("n").combine_chunks().flatten().to_numpy())
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([total], pa.list_(pa.int64()))})

    parts = map_batches(df.select("text"), count, "chunk int, bin array<short>, n array<int>")
    out = np.zeros(bins, np.int64)
    for row in parts.groupBy("chunk").applyInArrow(add, "chunk int, n array<bigint>").collect():
        out[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = row.n[: bins - row.chunk * CHUNK]
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, comp) for each end of the undirected edges (a, b); comp is the least id of the component.

    Alternates large-star and small-star rounds, so that chains shorten by a
    factor each round; every round ends in a checkpoint. Ends that equal each
    other are no edge. No edges: an empty result.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = checkpointed(e)
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        e = checkpointed(small.distinct())
        # done when each end has one edge to a least id that has none itself
        ups = e.select("u", F.lit(1).alias("up"), F.lit(0).alias("root")).unionAll(e.select("v", F.lit(0), F.lit(1))).groupBy("u").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
        if ups.where("up > 1 or up = 1 and root = 1").limit(1).count() == 0:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionAll(e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
