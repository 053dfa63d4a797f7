"""Dual-tree search: pruning on clustered vectors, exact scores at any size."""

import importlib

import numpy as np

topk = importlib.import_module("verdure.llm.topk")


def _check(points, queries, k=5):
    data, asked = topk.CoverTree(points), topk.CoverTree(queries)
    ids, query_ids = data.order.astype(np.int64), asked.order + 10**6
    best = topk.Best(len(queries), k)
    met, scored = topk.search(asked, query_ids, data, ids, best)
    scores = (queries @ points.T).astype(np.int64)
    for row, q in enumerate(asked.order):
        want = sorted(((-s, i) for i, s in enumerate(scores[q].tolist())))[:k]
        assert list(zip((-best.score[row]).tolist(), best.id[row].tolist(), strict=True)) == want
    return met, scored / scores.size, data, asked


def test_clustered_vectors_are_pruned():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 40_000, (60, 16))
    draw = lambda n: np.floor(centres[rng.integers(60, size=n)] + rng.normal(0, 300, (n, 16)))
    met, share, data, asked = _check(draw(12_000), draw(600))
    assert share < 0.3 and len(data.centre) > 60 and len(asked.centre) > 5 and met > 1


def test_spread_vectors_are_exact_and_every_node_is_covered():
    rng = np.random.default_rng(2)
    _, _, data, _ = _check(np.floor(256 * rng.normal(0, 1, (3000, 32))), np.floor(256 * rng.normal(0, 1, (200, 32))))
    assert len(data.centre) > 30
    for node, (lo, hi) in enumerate(data.span):
        assert np.sqrt(((data.points[lo:hi] - data.centre[node]) ** 2).sum(1)).max() <= data.radius[node]
        assert sum(data.span[c][1] - data.span[c][0] for c in data.children[node]) in (0, hi - lo)


def test_scores_beyond_floating_point(spark):
    big = float(1 << 22)
    rows = [(0, [big, 1.0 / 256]), (1, [big, 1.0 / 256]), (2, [big, 2.0 / 256]), (3, [1e300, 0.0]), (4, [-1e300, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(v, v.where("vec_id = 0")).collect()}
    whole = int(256 * big) ** 2
    assert got[0, 1] == (3, (1 << 63) - 1) and got[0, 4] == (4, -(1 << 63) + 1)
    assert got[0, 2] == (2, whole + 2) and got[0, 3] == (1, whole + 1)
