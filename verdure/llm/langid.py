"""Operator 10: language identification.

Features are hashed character n-grams (1 to 3, lower case) in BINS bins, weighted
by (1 + log tf) * idf and scaled to length 1; idf comes from all documents that
may be learned from. A sparse multinomial logistic regression is trained on a
bounded sample of them by follow-the-regularised-leader with an elastic-net
penalty (L1 sets most weights to 0), then a temperature is fitted on a held-back
part of the sample so that scores are calibrated probabilities.

A document may be learned from if its lang is not null and crc32 of its id, as
text, is not 1 modulo 3; a null id is never learned from. Predictions use the
text alone. Results: one row a document; lang_pred is `und` with score 0 where
the text is null or has no letter, or where nothing could be learned.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdure.llm.common import hashed_counts, map_batches, texts_of

BINS_LOG = 14
BINS = 1 << BINS_LOG
#: The sample: about this many rows a language, and at most about SAMPLE_ROWS.
PER_LANGUAGE, SAMPLE_ROWS = 1000, 20_000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 2.0, 1.0, 0.002, 1e-5
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the text's n-grams and how often each occurs."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    shift, total = np.uint64(64 - BINS_LOG), np.zeros(BINS, np.int64)
    gram = code
    for n, mix in enumerate(_MIX):
        if n:
            gram = (gram[:-1] << np.uint64(21)) | code[n:]
        if not len(gram):
            break
        h = gram * mix
        total += np.bincount(((h ^ (h >> np.uint64(29))) * _MIX[0] >> shift).astype(np.int64), minlength=BINS)
    used = np.flatnonzero(total)
    return used, total[used]


def weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    used, n = ngram_counts(text)
    v = (1 + np.log(n)) * idf[used]
    return used, v / (np.sqrt(v @ v) or 1.0)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> tuple[np.ndarray, float]:
    """Weights (BINS + 1, classes; the last row is the bias) and temperature; every fifth row calibrates."""
    z, n = np.zeros((BINS + 1, classes)), np.zeros((BINS + 1, classes))
    fit = [r for i, r in enumerate(rows) if i % 5] or rows
    held = rows[::5]

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zs = z[at]
        w = (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zs) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for used, v, y in fit:
            at, x = np.append(used, BINS), np.append(v, 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(slice(None))
    logits = np.array([v @ w[used] + w[BINS] for used, v, _ in held])
    truth = np.array([y for _, _, y in held])

    def loss(t: float) -> float:
        s = logits / t
        return float((np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(s)), truth]).mean())

    return w, min(np.exp(np.linspace(-3, 3, 121)), key=loss)


def may_learn(key: str, lang: str) -> Column:
    return F.col(lang).isNotNull() & F.coalesce(F.crc32(F.col(key).cast("string")) % 3 != 1, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict:
    """The model: langs, idf, weights, temperature; its size depends on BINS and the languages alone.

    Counts of n-grams cover all documents that may be learned from; the sample
    is a hash range of each language and is trained on in one task.
    """
    known = docs.where(may_learn(key, lang)).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.length("text"), F.lit(0)) > 0).alias("m")).limit(SAMPLE_ROWS + 1).collect()
    if len(sizes) > SAMPLE_ROWS:
        raise ValueError("more languages than sampled rows")
    langs = sorted(r.lang for r in sizes if r.m)
    if not langs:
        return {"langs": []}
    seen = hashed_counts(known, lambda t: ngram_counts(t)[0], BINS)
    idf = np.log((1 + sum(r.n for r in sizes)) / (1 + seen)) + 1
    each = min(PER_LANGUAGE, SAMPLE_ROWS // len(langs))
    share = docs.sparkSession.createDataFrame([(r.lang, min(1.0, each / r.n)) for r in sizes], f"lang {docs.schema[lang].dataType.simpleString()}, share double")
    order = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30))
    sample = known.join(F.broadcast(share), "lang").withColumn("order", order).where(F.col("order") < F.col("share") * (1 << 30)).select("order", "text", "lang")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for order, t, name in zip(batch.column("order").to_pylist(), texts_of(batch), batch.column("lang").to_pylist(), strict=True):
                if t:
                    rows.append((order, *weighted(t, idf), langs.index(name)))
        rows.sort(key=lambda r: (r[0], r[3], len(r[1])))
        if rows:
            weights, temperature = train([r[1:] for r in rows], len(langs))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((weights.astype(np.float32), float(temperature)))], pa.binary())], names=["model"])

    found = map_batches(sample.repartition(1), learn, "model binary").collect()
    if not found:
        return {"langs": []}
    weights, temperature = pickle.loads(found[0].model)
    return {"langs": langs, "idf": idf, "weights": weights, "temperature": temperature}


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with lang_pred and score; columns of those names are replaced. No shuffle; the model is broadcast."""
    rest = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*rest.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names, scores = [], []
            for t in texts_of(batch, text):
                if not m["langs"] or not LETTER.search(t):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                used, v = weighted(t, m["idf"])
                p = _softmax((v @ m["weights"][used] + m["weights"][BINS]).astype(np.float64) / m["temperature"])
                best = int(p.argmax())
                names.append(m["langs"][best])
                scores.append(float(min(1.0, max(0.0, p[best]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return map_batches(rest, run, schema)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document's predicted language."""
    from verdure.llm.common import table

    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))
    found = predict(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
