"""Co-training against a plain version, its cuts, and rounds that reach all documents."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdure.llm import quality

DATA = "/root/testdata/sf0.001"


def learn(w, g, used, values, y):
    """One adaptive step, feature by feature."""
    z = w[-1] + sum(w[f] * v for f, v in zip(used, values))
    d = 1 / (1 + math.exp(-max(-35, min(35, z)))) - y
    for f, v in zip(used, values):
        g[f] += (d * v) ** 2
        w[f] -= 0.1 * (d * v / math.sqrt(g[f]) + 1e-4 * w[f])
    g[-1] += d * d
    w[-1] -= 0.1 * d / math.sqrt(g[-1])


def plain(known, pool):
    """Weights of both views. known, pool: (order, text view, meta view, label or None)."""
    known = sorted(known, key=lambda r: r[0])
    fit = [r for i, r in enumerate(known) if i % 4]
    models = [(np.zeros(bins + 1), np.full(bins + 1, 0.01)) for bins in (quality.TEXT_BINS, quality.META_BINS)]

    def again(times):
        for view, (w, g) in enumerate(models):
            for _ in range(times):
                for r in fit:
                    learn(w, g, *r[1 + view], r[3])

    again(quality.EPOCHS)
    share = sum(r[3] for r in fit) / len(fit)
    for i in range(quality.ROUNDS):
        n = min(max(2, int(len(pool) * quality.CONFIDENT * (i + 1))), len(pool) // 2 * 2)
        good = min(n - 1, max(1, round(n * share)))
        labels = []
        for view, (w, _) in enumerate(models):
            step = [math.floor(quality.STEPS * (w[-1] + sum(w[f] * v for f, v in zip(*r[1 + view])))) for r in pool]
            low, high = sorted(step)[n - good - 1], sorted(step)[-good]
            # of the last step that takes part, the share that is left to take, by hash
            of_low, of_high = ((k - sum(map(before, step))) / step.count(at) for k, at, before in ((n - good, low, low.__gt__), (good, high, high.__lt__)))
            tie = [r[0] * 40503 % 2**30 / 2**30 for r in pool]
            bad = {k for k in range(len(pool)) if step[k] < low or (step[k] == low and tie[k] < of_low)}
            best = {k for k in range(len(pool)) if step[k] > high or (step[k] == high and tie[k] >= 1 - of_high)}
            labels.append((bad - best, best - bad))
        for view, (w, g) in enumerate(models):
            bad, best = labels[1 - view]
            for k, r in enumerate(pool):
                if k in bad or k in best:
                    learn(w, g, *r[1 + view], int(k in best))
        again(1)
    return [w for w, _ in models]


def test_rounds_against_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(quality, "_cut", exact_cut(quality._cut))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 160").coalesce(1)
    labels = spark.read.parquet(f"{DATA}/labels.parquet").where("doc_id < 60")
    model = quality.fit(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = []
    for r in docs.withColumn("o", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))).collect():
        used, v = quality.text_view(r.text or "")
        meta = quality.meta_view(r.source, r.lang, r.n_chars)[0].tolist()
        rows.append((r.o, (used.tolist(), v.astype(np.float32).tolist()), (meta, [1.0] * len(meta)), truth.get(r.doc_id)))
    want = plain([r for r in rows if r[3] is not None], [r for r in rows if r[3] is None])
    for got, weights in zip(model["weights"], want, strict=True):
        assert np.count_nonzero(weights) > 50 and got == pytest.approx(weights, abs=2e-3)


def exact_cut(cut):
    """The cut as it is, checked: its share of the step and all earlier ones are k rows."""

    def checked(steps, n, k):
        step, share = cut(steps, n, k)
        at = steps.tolist().index(step)
        assert n[:at].sum() + share * n[at] == pytest.approx(k) and 0 < share <= 1
        return step, share

    return checked


def test_cuts_take_the_surest_and_grow_with_the_input():
    rng = np.random.default_rng(5)
    for size in (2, 3, 10, 1000, 100_000):
        steps, tie = rng.integers(-20, 20, size), rng.random(size)
        cuts = quality.confident(np.stack(np.unique(steps, return_counts=True), 1), 0.3, 0.1)
        labels = quality.picked(steps, tie, cuts)
        assert not (labels == 0).any() or steps[labels == 0].max() <= np.percentile(steps, 50) + 1
        if size >= 1000:
            assert abs((labels == 1).sum() / size - 0.03) < 0.01 and abs((labels == 0).sum() / size - 0.07) < 0.01
    assert quality.confident(np.zeros((0, 2), np.int64), 0.5, 0.1) is None
    assert quality.confident(np.array([[3, 1]]), 0.5, 0.1) is None
    same = quality.picked(np.full(1000, 7), rng.random(1000), quality.confident(np.array([[7, 1000]]), 0.5, 0.1))
    assert abs((same == 1).sum() - 50) < 30 and abs((same == 0).sum() - 50) < 30


def test_partitions_change_little(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet").where("doc_id % 2 = 0")
    one, many = (quality.score(docs, quality.fit(docs.repartition(n, "doc_id"), labels)).select("doc_id", "quality_pred") for n in (1, 7))
    assert one.exceptAll(many).count() <= 0.02 * docs.count()


def test_labels_beyond_the_sample_stay_out(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"words and more words {i}", "s", "en", 20, i, True, 5) for i in range(40)], "doc_id bigint, text string, source string, lang string, n_chars bigint, y int, learn boolean, truth_key int")
    truth = spark.createDataFrame([(i, i % 2, i < 10) for i in range(25)], "truth_key bigint, y int, learn boolean")
    got = quality.features(docs, truth, "doc_id").collect()
    assert len(got) == 25 and sum(r.y is not None for r in got) == 10
    labels = spark.createDataFrame([(i, i % 2) for i in range(25)], "doc_id bigint, quality int")
    for most in (quality.BROADCAST_LABELS, 0):
        monkeypatch.setattr(quality, "BROADCAST_LABELS", most)
        assert quality.score(docs, quality.fit(docs, labels)).count() == 40
