"""Operator 6: exact top-k inner products by a dual-tree search over cover trees.

Vectors become whole numbers, floor(SCALE * x). They are dealt by hash into
blocks of at most about BLOCK rows; each is indexed in a cover tree: a node's
children are centred on up to FAN of its points, chosen each as far as possible
from those before, so that centres are further apart than the radius within which
they cover the node. The queries, as many copies as there are blocks, reach each
block in batches of at most BATCH, which have such a tree too. A pair of nodes is
skipped if no inner product between them, at most

    <cq, cd> + rq * |cd| + rd * |cq| + rq * rd,

reaches the worst kth score of the query node's queries so far; the best pairs
go first. Each block gives its k best per query, and the best of these are the
result, so the search is exact. A task holds one block and one batch; nothing
goes through the driver but the number of rows.

Results: rank 1 to k by score, ties to the smaller id; a query never finds its
own id. Vectors that are null or hold null or non-finite components take no part;
inner products are taken between vectors of equal length only. Of rows with the
same id each counts. Scores are whole numbers, exact at any size; those beyond 64
bits become the largest or smallest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from verdure.llm.common import map_batches

SCALE, BLOCK, LEAST_BLOCK, BATCH, FAN, LEAF = 256.0, 1 << 16, 1 << 12, 2048, 32, 96
#: Sums of products below this are exact in floating point.
EXACT = float(1 << 53)
NONE = np.iinfo(np.int64).min


class CoverTree:
    """points: (n, d) whole numbers as float64. order: the points' numbers, so that every node is a slice."""

    def __init__(self, points: np.ndarray):
        self.points, self.order = points, np.arange(len(points))
        self.centre, self.radius, self.span, self.children = [], [], [], []
        self._node(points.mean(0), 0, len(points))
        at = 0
        while at < len(self.centre):
            self._split(at)
            at += 1
        self.points = points[self.order]
        self.centre = np.array(self.centre)
        self.radius = np.array(self.radius)
        self.length = np.sqrt((self.centre**2).sum(1))

    def _node(self, centre: np.ndarray, lo: int, hi: int) -> int:
        off = self.points[self.order[lo:hi]] - centre
        self.centre.append(centre)
        self.radius.append(float(np.sqrt((off * off).sum(1).max())) * (1 + 1e-9))
        self.span.append((lo, hi))
        self.children.append([])
        return len(self.centre) - 1

    def _split(self, node: int) -> None:
        lo, hi = self.span[node]
        if hi - lo <= LEAF or not self.radius[node]:
            return
        own = self.order[lo:hi]
        points, reach = self.points[own], self.radius[node] / 2
        off = points - self.centre[node]
        centres = [int((off * off).sum(1).argmin())]
        off = points - points[centres[0]]
        distance, nearest = (off * off).sum(1), np.zeros(len(own), np.int64)
        while len(centres) < FAN and distance.max() > reach * reach:
            c = int(distance.argmax())
            off = points - points[c]
            d = (off * off).sum(1)
            closer = d < distance
            distance[closer], nearest[closer] = d[closer], len(centres)
            centres.append(c)
        if len(centres) == 1:
            return
        by = np.argsort(nearest, kind="stable")
        self.order[lo:hi] = own[by]
        edges = [*np.searchsorted(nearest[by], np.arange(len(centres))).tolist(), len(own)]
        self.children[node] = [self._node(points[c], lo + a, lo + b) for c, a, b in zip(centres, edges, edges[1:], strict=False) if b > a]


class Best:
    """The k best so far of each query, in the order of the query tree."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, lo: int, hi: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: of queries lo to hi with the candidates ids; NONE: no candidate."""
        k = self.score.shape[1]
        least = self.score[lo:hi, -1]
        if scores.shape[1] > k:
            least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
        row, column = np.nonzero((scores >= least[:, None]) & (scores > NONE))
        edges = np.searchsorted(row, np.arange(len(scores) + 1))
        for r in np.unique(row).tolist():
            at = column[edges[r] : edges[r + 1]]
            score, ident = np.append(self.score[lo + r], scores[r, at]), np.append(self.id[lo + r], ids[at])
            by = np.lexsort((ident, ~score))[:k]
            self.score[lo + r], self.id[lo + r] = score[by], ident[by]


def search(queries: CoverTree, query_ids: np.ndarray, data: CoverTree, data_ids: np.ndarray, best: Best) -> tuple[int, int]:
    """Adds the data's best to best; ids are in the trees' order. Returns how many pairs of nodes met, and how many of vectors were scored."""

    def bound(q, d) -> np.ndarray:
        rq, rd = queries.radius[q], data.radius[d]
        return data.centre[d] @ queries.centre[q] + rq * data.length[d] + rd * queries.length[q] + rq * rd

    stack, met, scored = [(0, 0, np.inf)], 0, 0
    while stack:
        q, d, most = stack.pop()
        lo, hi = queries.span[q]
        worst = float(best.score[lo:hi, -1].min())
        slack = 0.5 + 1e-9 * abs(worst)  # bounds are rounded
        if most < worst - slack:
            continue
        met += 1
        q_kids, d_kids = queries.children[q], data.children[d]
        if not q_kids and not d_kids:
            a, b = data.span[d]
            scores = (queries.points[lo:hi] @ data.points[a:b].T).astype(np.int64)
            scores[query_ids[lo:hi, None] == data_ids[None, a:b]] = NONE
            best.add(lo, hi, scores, data_ids[a:b])
            scored += scores.size
        elif not q_kids or (d_kids and data.radius[d] >= queries.radius[q]):
            kids = np.array(d_kids)
            tops = bound(q, kids)
            keep = tops >= worst - slack
            kids, tops = kids[keep], tops[keep]
            stack.extend((q, int(kids[i]), float(tops[i])) for i in np.argsort(tops))
        else:
            stack.extend((c, d, float(bound(c, d))) for c in q_kids)
    return met, scored


def usable(embedding: str) -> Column:
    e = F.col(embedding)
    return e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _whole(rows: pa.Array, length: int) -> np.ndarray:
    return np.floor(SCALE * rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, length)


def _plain(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, best: Best) -> None:
    """For components too large for exact floating point: whole-number products, all of them."""
    q, d = ([[int(x) for x in row] for row in m] for m in (queries, data))
    for i, x in enumerate(q):
        scores = np.array([[min(max(sum(a * b for a, b in zip(x, y, strict=True)), NONE + 1), -NONE - 1) if query_ids[i] != data_ids[j] else NONE for j, y in enumerate(d)]], np.int64)
        best.add(i, i + 1, scores, data_ids)


class _Block:
    """A block's vectors; its tree is built when the first queries come."""

    def __init__(self, length: int, k: int):
        self.length, self.k, self.ids, self.points, self.whole, self.tree = length, k, [], [], None, None

    def add(self, ids: np.ndarray, points: np.ndarray) -> None:
        self.ids.append(ids)
        self.points.append(points)

    def answer(self, ids: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.whole is None:
            self.ids, self.whole = np.concatenate(self.ids), np.concatenate(self.points)
            self.points, self.largest = None, float(np.abs(self.whole).max())
        best = Best(len(ids), self.k)
        if float(np.abs(points).max()) * self.largest >= EXACT / self.length:
            _plain(points, ids, self.whole, self.ids, best)
        else:
            if self.tree is None:
                self.tree = CoverTree(self.whole)
                self.whole, self.ids = self.tree.points, self.ids[self.tree.order]
            tree = CoverTree(points)
            ids = ids[tree.order]
            search(tree, ids, self.tree, self.ids, best)
        at, rank = np.nonzero(best.score > NONE)
        return ids[at], best.id[at, rank], best.score[at, rank]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, <key>, score) of the rows of queries against all rows of vectors; keys are whole numbers, null keys take no part."""
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pick = lambda df: df.where(usable(embedding) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("e"))
    asked, data = pick(queries), pick(vectors)
    n = data.count()
    blocks = max(1, -(-n // BLOCK), min(tasks, n // LEAST_BLOCK))
    rows = data.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asked"), "id", "e")
    copies = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asked"), "id", "e")
    met = rows.unionAll(copies).withColumn("length", F.size("e")).repartition(blocks, "block", "length").sortWithinPartitions("block", "length", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for batch in batches:
            names = [batch.column(c).to_numpy() for c in ("block", "length", "asked")]
            edges = [0, *(np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                own, length = (int(names[0][a]), int(names[1][a])), int(names[1][a])
                if own != at:
                    at, block = own, _Block(length, k)
                for i in range(a, b, BATCH):
                    part = batch.slice(i, min(BATCH, b - i))
                    ids, points = part.column("id").to_numpy(), _whole(part.column("e"), length)
                    if not names[2][a]:
                        block.add(ids, points)
                    elif len(block.ids):
                        found = block.answer(ids, points)
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["query_id", "id", "score"])

    found = map_batches(met, run, "query_id bigint, id bigint, score bigint")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")


def op6_topk(spark, sf_dir: str) -> DataFrame:
    """The 5 best for every vector whose id is divisible by 50."""
    from verdure.llm.common import table

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
