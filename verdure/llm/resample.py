"""Operator 12: importance resampling towards a target distribution.

Features are runs of 1 to N words, repeats counted, hashed into BUCKETS by the
crc32 of their bytes. A bucket's gain is the log of its share in the target over
its share in the documents, in thousandths; a document's weight is the sum of its
features' gains. Adding Gumbel noise, drawn from the id's sha256, to the weights
and taking the highest scores draws documents without replacement in proportion
to their importance.

Strings are hashed once each: a dictionary of all distinct features, with counts
over all documents, gets the buckets; their sums give the gains, which are joined
back to the documents' feature counts. So that this join does not carry a row
for each document and feature, documents stand in blocks of bounded size: a block
lists its distinct features once, and its documents name them by position.
Blocks are written to the shared folder, so a lost executor can't deal documents
out to other blocks. One very common feature is one row a block.

Results: one row a row of the table: id, n_features, weight, score and rank. Null
and empty texts have no features and weight 0; a null id draws its noise from
``2024:``; rows repeated with equal ids each count, and ties of score go to the
smaller id (null last), then fewer features. Texts are read whole; a text longer
than a block is one of its own. Empty tables, documents or target, are no error.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count as counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from verdure.llm.common import map_batches, written

N, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: Bytes of text in a block.
BLOCK_BYTES = 4 << 20
#: A-Z become small, what is neither a digit, a letter nor beyond ASCII a space.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SOME = 1 << 14


def features(text: bytes, n: int = N) -> tuple[int, Counter]:
    """Words of a text, and how often it has each run of 1 to n of them."""
    words = text.translate(WORDS).split()
    out = Counter(words)
    for k in range(2, n + 1):
        out.update(b" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    return len(words), out


def blocks(docs: DataFrame, key: str, text: str, n: int = N, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A written table with two kinds of rows, by block.

    With a word: a distinct feature, its position in the block and its count.
    Without: a document's key, number of words and features, and, as 32-bit
    integers, the steps between positions of its features and their counts.
    """
    schema = T.StructType.fromDDL("block bigint, word binary, pos int, n bigint, n_words bigint, n_features bigint, steps binary, counts binary")
    schema = T.StructType([*schema.fields, T.StructField("k", docs.schema[key].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = (TaskContext.get().partitionId() << 32) - 1

        def rows(size: int, have: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(have[name], kind) if name in have else pa.nulls(size, kind) for name, kind in kinds], names=[name for name, _ in kinds])

        def words() -> Iterator[pa.RecordBatch]:
            names, n = list(index), np.array([total[i] for i in range(len(index))], np.int64)
            for i in range(0, len(names), _SOME):
                size = len(names[i : i + _SOME])
                yield rows(size, {"block": [block] * size, "word": names[i : i + _SOME], "pos": np.arange(i, i + size, dtype=np.int32), "n": n[i : i + size]})

        index, total, size, kinds = None, None, 0, None
        for batch in batches:
            kinds = [("block", pa.int64()), ("word", pa.binary()), ("pos", pa.int32()), ("n", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("steps", pa.binary()), ("counts", pa.binary()), ("k", batch.column("k").type)]
            docs_of: dict = defaultdict(list)
            for k, t in zip(batch.column("k").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                t = t or b""
                if index is None or size + len(t) > block_bytes and size:
                    if docs_of:
                        yield rows(len(docs_of["k"]), docs_of)
                        docs_of = defaultdict(list)
                    if index is not None:
                        yield from words()
                    block, size, total = block + 1, 0, Counter()
                    index = defaultdict(counter().__next__)
                size += len(t)
                n_words, found = features(t, n)
                at, n_of = np.array(list(map(index.__getitem__, found)), np.int32), np.array(list(found.values()), np.int32)
                for i, m in zip(at.tolist(), found.values(), strict=True):
                    total[i] += m
                order = np.argsort(at)
                for name, value in (("block", block), ("n_words", n_words), ("n_features", int(n_of.sum())), ("steps", np.diff(at[order], prepend=np.int32(0)).tobytes()), ("counts", n_of[order].tobytes()), ("k", k)):
                    docs_of[name].append(value)
            if docs_of:
                yield rows(len(docs_of["k"]), docs_of)
        if index is not None:
            yield from words()

    return written(map_batches(docs.select(F.col(key).alias("k"), F.col(text).alias("text")), run, schema))


def dictionary(table: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(word, n, bucket): each distinct feature of a table of blocks, hashed once."""
    words = table.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    return words.withColumn("bucket", (F.crc32("word") % buckets).cast("int"))


def bucket_counts(words: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Features in each bucket, of all that a dictionary counts; as many numbers as there are buckets."""
    out = [0] * buckets
    for row in words.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(have: list[int], want: list[int]) -> list[int]:
    """Each bucket's gain in thousandths, counts smoothed by one."""
    size, s_all, t_all = len(have), sum(have), sum(want)
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)))) for s, t in zip(have, want, strict=True)]


def weights(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", n: int = N, buckets: int = BUCKETS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(k, n_words, n_features, weight) of every row of docs."""
    spark = docs.sparkSession
    table = blocks(docs, key, text, n, block_bytes)
    words = written(dictionary(table, buckets))
    own = target.select(F.lit(0).alias("k"), F.col(target_text).alias("text"))
    gain = gains(bucket_counts(words, buckets), bucket_counts(dictionary(blocks(own, "k", "text", n, block_bytes), buckets), buckets))
    # one row a bucket, whose number is a parameter
    by_bucket = F.broadcast(spark.createDataFrame(list(enumerate(gain)), "bucket int, gain bigint"))
    back = table.where("word IS NOT NULL").select("block", "pos", "word").join(words.select("word", "bucket"), "word").join(by_bucket, "bucket").select("block", "pos", "gain")
    own = table.where("word IS NULL").select(F.col("block").alias("its"), "n_words", "n_features", "steps", "counts", "k")

    def add(key: tuple[pa.Scalar, ...], gained: pa.Table, rows: pa.Table) -> pa.Table:
        gain = np.zeros(gained.num_rows, np.int64)
        gain[gained.column("pos").to_numpy()] = gained.column("gain").to_numpy()
        out = []
        for steps, counts in zip(rows.column("steps").to_pylist(), rows.column("counts").to_pylist(), strict=True):
            out.append(int(gain[np.cumsum(np.frombuffer(steps, np.int32))] @ np.frombuffer(counts, np.int32).astype(np.int64)))
        return pa.table({"k": rows.column("k"), "n_words": rows.column("n_words"), "n_features": rows.column("n_features"), "weight": pa.array(out, pa.int64())})

    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), *T.StructType.fromDDL("n_words bigint, n_features bigint, weight bigint").fields])
    return back.groupBy("block").cogroup(own.groupBy("its")).applyInArrow(add, schema)


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of sha256 of ``seed:key``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def ranked(df: DataFrame, order: list[Column], parts: int) -> DataFrame:
    """df with rank (from 1) in that order: ranges sorted in tasks of their own, then shifted by the rows before them."""
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = written(placed.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    before = placed.groupBy("part").agg(F.count("*").alias("m"))  # a row a task
    before = before.select("part", (F.sum("m").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("m")).alias("before"))
    return placed.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("at") + 1).drop("part", "at", "before")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, **how) -> DataFrame:
    """key, n_features, weight, score of every row of docs, and rank of the drawn ones: percent of those with least_words words."""
    spark = docs.sparkSession
    scored = weights(docs, target, key, text, **how).withColumn("score", F.col("weight") + noise(F.col("k"), seed))
    scored = written(scored)
    enough = scored.where(F.col("n_words") >= least_words)
    draw = percent * enough.count() // 100
    order = [F.desc("score"), F.asc_nulls_last("k"), F.asc("n_features"), F.asc("weight")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = ranked(enough, order, parts).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return drawn.unionByName(rest).select(F.col("k").alias(key), "n_features", "weight", "score", F.col("rank").cast("bigint").alias("rank"))


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark, and its rank among the drawn tenth."""
    from verdure.llm.common import table

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = rf"""
WITH crcs AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) t(i))),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
wanted AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
each AS (SELECT r, unnest(words) AS w FROM docs),
s AS (SELECT w, count(*) AS n FROM each GROUP BY w), t AS (SELECT w, count(*) AS n FROM wanted GROUP BY w),
hashed AS (
  SELECT w, xor(list_reduce(list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT w FROM s UNION SELECT w FROM t), crcs),
sums AS (SELECT bucket, sum(coalesce(s.n, 0)) AS s, sum(coalesce(t.n, 0)) AS t FROM hashed LEFT JOIN s USING (w) LEFT JOIN t USING (w) GROUP BY bucket),
alls AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM sums),
gain AS (SELECT w, CAST(floor(1000 * ln((t + 1)::DOUBLE * (s_all + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (t_all + {BUCKETS})::DOUBLE))) AS BIGINT) AS g FROM hashed JOIN sums USING (bucket), alls),
weighed AS (SELECT r, sum(g)::BIGINT AS weight FROM each JOIN gain USING (w) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM docs LEFT JOIN weighed USING (r)),
places AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS rank FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= (SELECT {PERCENT} * count(*) // 100 FROM places) THEN rank END AS rank FROM scored LEFT JOIN places USING (r)
"""
