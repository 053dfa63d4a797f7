"""Incremental collection and publication."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from verdure.operators import store
from verdure.operators.lineage import checkpointed

#: A field's state: the furthest day, its scene, and the scenes that were collected, one a line.
STATE = "cursor date, last_scene string, seen string"


def fresh(scenes: DataFrame) -> DataFrame:
    """The scenes of a stream (field_id, scene_id, sensed_on and more) that were not collected before, with the field's cursor after them.

    Every field keeps its cursor, which only moves forward, and its collected
    scenes. A scene that comes late or out of order is collected like any other;
    one that comes again, in the same batch or a later one, is left out. Scenes
    without an id or a day are dropped. A field's state is as long as its list of scenes.
    """
    schema = T.StructType([*scenes.schema.fields, T.StructField("cursor", T.DateType()), T.StructField("last_scene", T.StringType())])
    names = schema.names

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cursor, last, seen = state.get if state.exists else (None, None, "")
        known = set(seen.split("\n")) if seen else set()
        rows = pd.concat(held) if len(held := list(batches)) > 1 else held[0]
        # plain lists: most fields bring a few rows, for which each call of pandas costs more than all the rest
        ids, days = rows["scene_id"].tolist(), rows["sensed_on"].tolist()
        given = sorted((d, s, i) for i, (d, s) in enumerate(zip(days, ids, strict=True)) if not (pd.isna(d) or pd.isna(s)))
        kept = []
        for d, s, i in given:
            if s not in known:
                known.add(s)
                kept.append((d, s, i))
        if kept:
            if cursor is None or kept[-1][0] > cursor:
                cursor, last = kept[-1][:2]
            state.update((cursor, last, "\n".join([*([seen] if seen else []), *(s for _, s, _ in kept)])))
            out = rows.take([i for *_, i in kept])
            out["cursor"], out["last_scene"] = cursor, last
            yield out[names]

    return scenes.groupBy("field_id").applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def collect(scenes: DataFrame, analyse: Callable[[DataFrame], DataFrame], facts: str, identity: list[str], keep: list[str], checkpoint: str, month: str = "month") -> StreamingQuery:
    """Drains a stream of scenes into the facts table, partitioned by month, and ends.

    analyse turns fresh scenes into facts with identity and month. A batch that is
    done again after a failure finds the state as it was before it, gives the
    same scenes, and merges the same facts: nothing is lost or counted twice.
    """

    def sink(batch: DataFrame, number: int) -> None:
        store.merge(facts, analyse(batch), identity, keep, month)

    return fresh(scenes).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish(payloads: DataFrame, deliver: Callable[[DataFrame], DataFrame], outbox: str, checkpoint: str) -> StreamingQuery:
    """Drains a stream of payloads (key, farm_id, results, at and more) through deliver and keeps the outbox, a Parquet table of attempts.

    deliver gives (key, ok, detail) for what it was given. Keys that the outbox
    holds as published are not delivered again, so a batch that is done again
    delivers only what it had not settled; attempts stand under their batch's number.
    """

    def sink(batch: DataFrame, number: int) -> None:
        log = attempts(batch.sparkSession, outbox)
        todo = checkpointed(store.unpublished(batch, log.select("key", F.when(F.col("ok"), "published").alias("status"))))
        out = deliver(todo).select("key", "ok", "detail").join(todo.select("key", "farm_id", "results", "at"), "key")
        out = out.withColumn("batch", F.lit(number).cast("bigint")).select(*_ATTEMPT)
        checkpointed(out.unionByName(log.where(F.col("batch") == number))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(outbox)

    return payloads.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_ATTEMPT = ["key", "farm_id", "results", "ok", "detail", "at", "batch"]


def attempts(spark, outbox: str) -> DataFrame:
    """The outbox's attempts; none yet: an empty table."""
    schema = "key string, farm_id string, results bigint, ok boolean, detail string, at timestamp, batch bigint"
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(outbox)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
