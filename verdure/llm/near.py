"""Operator 9: near-duplicate documents by improved consistent weighted sampling.

A document is the weighted set of its shingles of five lower-case words (all its
words, if fewer): weight = occurrences * idf. Shingles of at least one in COMMON
documents have their exact idf; all rarer ones have that of one in COMMON, so
that weights depend on shares of the documents and not on their number. Each of SAMPLES hash functions draws one shingle
so that two documents draw the same one with probability equal to their weighted
Jaccard similarity; BANDS bands of ROWS draws each are join keys. Pairs that
share a key are verified: they are linked if their weighted Jaccard similarity,
from all shingles of both texts, is THRESHOLD or more. A pair of similarity
THRESHOLD shares a key with probability 1 - (1 - THRESHOLD^ROWS)^BANDS = 0.9998.

Texts of the same words are copies and go through as one. Within a key all texts
are compared with its first. Those that this leaves apart from the first one are dealt
into blocks, as are all the key's texts; a task takes a block of either kind and
returns the links that connect them: no pair is ever a row, and no link between
groups is lost.

Results: one row a document with class_id, the least id of the documents that
links and copies connect, and class_size. Rows are known by 128 bits of their id
and text; rows equal in both are copies. Null texts and texts without words
are in a class of their own each, class_id their own id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdure.llm.common import checkpointed, connected_components, hashed_counts, map_batches, texts_of

WORDS, THRESHOLD = 5, 0.8
#: idf is exact for shingles of one in COMMON documents or more: at most COMMON times as many as a document has on average.
COMMON, BINS_LOG = 256, 18
BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS
#: Texts of a block, when the pairs of a key are made tile by tile.
TILE = 256
#: Random numbers of the sampling: shingles share them by TABLE hash values.
TABLE, SEED, PART = 1 << 14, 9, 4096
#: Ids of 16 bytes that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(words: list[str]) -> np.ndarray:
    """xxh64 of each word; joined digests are read at once, which costs less than a cache of words."""
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64) if words else np.zeros(0, np.uint64)


def shingle_hashes(text: str | list[str]) -> np.ndarray:
    """Hash of each shingle of the text, or of its words, with repetitions."""
    w = word_hashes(text.lower().split() if isinstance(text, str) else text)
    n = len(w)
    size = min(n, WORDS)
    if not size:
        return w
    h = w[: n - size + 1].copy()
    for i in range(1, size):
        h *= _BASE
        h += w[i : n - size + 1 + i]
    h ^= h >> np.uint64(31)
    h *= _MIX
    return h


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and how often each occurs; for the few of a text less costly than np.unique."""
    x = np.sort(x)
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[starts], np.diff(starts, append=len(x))


def bins_of(text: str) -> np.ndarray:
    return distinct((shingle_hashes(text) >> np.uint64(64 - BINS_LOG)).astype(np.int64))[0]


class Idf:
    """idf of shingles: exact for the common ones, one value for all others."""

    def __init__(self, common: np.ndarray, counts: np.ndarray, documents: int):
        by = np.argsort(common)
        self.common = common[by]
        self.values = np.log((1 + documents) / (1 + counts[by])) + 1
        self.other = float(np.log((1 + documents) / (1 + documents / COMMON)) + 1)

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.other)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, h), len(self.common) - 1)
            hit = self.common[at] == h
            out[hit] = self.values[at[hit]]
        return out


def idf_of(docs: DataFrame) -> Idf:
    """docs: column text. Counts by bins tell which shingles may be common; those are counted one by one."""
    total = docs.count()
    full = hashed_counts(docs, bins_of, 1 << BINS_LOG) * COMMON >= max(1, total)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [distinct(shingle_hashes(t))[0] for t in texts_of(batch)]
            h = np.concatenate([np.zeros(0, np.uint64), *(x[full[(x >> np.uint64(64 - BINS_LOG)).astype(np.int64)]] for x in found)])
            h, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    rows = map_batches(docs.select("text"), count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") * COMMON >= total).collect()
    return Idf(np.array([r.h for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], np.float64), total)


def weighted_set(text: str | list[str], idf: Idf) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the text, or of its words, in order, and their weights."""
    h, n = distinct(shingle_hashes(text))
    return h, n * idf.of(h)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: sum of the lesser over sum of the greater weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = float(np.minimum(a[1][i], b[1][j]).sum())
    most = float(a[1].sum() + b[1].sum()) - least
    return least / most if most else 0.0


class Sampler:
    """Draws of the hash functions. Those of a shingle of weight ``usual``, as most have, depend on its place in the table only and are looked up there."""

    def __init__(self, usual: float = 1.0, seed: int = SEED):
        rng = np.random.default_rng(seed)
        shape = (TABLE, SAMPLES)
        self.r = rng.gamma(2.0, 1.0, shape).astype(np.float32)
        self.inverse = 1 / self.r
        self.log_c = np.log(rng.gamma(2.0, 1.0, shape)).astype(np.float32)
        self.beta = rng.random(shape, np.float32)
        self.usual = usual
        self.value, self.step = (np.ascontiguousarray(x.T) for x in self.draws(np.arange(TABLE), np.full(TABLE, usual)))

    def draws(self, row: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, step) of shingles at these rows of the table, by function; the least value is drawn."""
        r, beta = self.r[row], self.beta[row]
        t = np.floor(np.log(weight).astype(np.float32)[:, None] * self.inverse[row] + beta)
        return self.log_c[row] - r * (t - beta) - r, t

    def bands(self, h: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The join keys of a weighted set that isn't empty."""
        best = np.full(SAMPLES, np.inf, np.float32)
        drawn, step = np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.float32)
        every = np.arange(SAMPLES)
        for a in range(0, len(h), PART):
            part, w = h[a : a + PART], weight[a : a + PART]
            row = (part & np.uint64(TABLE - 1)).astype(np.int64)
            value = self.value.take(row, axis=1, mode="clip")
            own = np.flatnonzero(w != self.usual)
            if len(own):
                v, t = self.draws(row[own], w[own])
                value[:, own] = v.T
            at = value.argmin(1)
            least, its = value[every, at], self.step[every, row[at]]
            if len(own):
                place = np.minimum(np.searchsorted(own, at), len(own) - 1)
                is_own = own[place] == at
                its[is_own] = t[place[is_own], every[is_own]]
            better = least < best
            best[better], drawn[better], step[better] = least[better], part[at[better]], its[better]
        x = (drawn ^ step.astype(np.int64).astype(np.uint64) * _BASE).reshape(BANDS, ROWS)
        key = np.arange(BANDS, dtype=np.uint64)
        for i in range(ROWS):
            key = (key + x[:, i]) * _MIX
            key ^= key >> np.uint64(29)
        return key.view(np.int64)


def _rid(key: str, text: str) -> Column:
    """128 bits that name a row by its id and text."""
    halves = F.xxhash64(F.col(key), F.col(text)), F.xxhash64(F.lit(1), F.col(key), F.col(text))
    return F.unhex(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in halves)))


def signatures(docs: DataFrame, idf, key: str, text: str) -> DataFrame:
    """(doc, rid, fp, bands): fp is a 128-bit hash of the words, null where there are none."""
    rows = docs.select(F.col(key).alias("doc"), _rid(key, text).alias("rid"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = idf.value
        sampler = Sampler(weights.other)
        for batch in batches:
            fps, bands = [], []
            for t in texts_of(batch):
                words = t.lower().split()
                fps.append(xxhash.xxh128_digest(" ".join(words)) if words else None)
                bands.append(sampler.bands(*weighted_set(words, weights)) if words else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("rid"), pa.array(fps, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc", "rid", "fp", "bands"])

    return map_batches(rows, run, f"doc {rows.schema['doc'].dataType.simpleString()}, rid binary, fp binary, bands array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """(a, b, ok) of the pairs (a, b) of fps; texts: (fp, text)."""
    both = pairs.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("fp").alias("b"), F.col("text").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, recent = idf.value, {}

        def of(fp: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
            if fp not in recent:
                if len(recent) > 256:
                    recent.clear()
                recent[fp] = weighted_set(text, weights)
            return recent[fp]

        for batch in batches:
            a, b, x, y = (batch.column(c).to_pylist() for c in "abxy")
            ok = [similarity(of(p, s), of(q, t)) >= THRESHOLD for p, q, s, t in zip(a, b, x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return map_batches(both.select("a", "b", "x", "y"), run, "a binary, b binary, ok boolean")


def forest(rows: list[tuple[bytes, str, bytes, bool]], weights: Idf) -> list[tuple[bytes, bytes]]:
    """Links that connect the texts (fp, text, comp, loose) of different comp as all links of the loose ones would.

    An index from shingles to the texts that have them gives a text's
    similarities to all others at once.
    """
    sets = [weighted_set(t, weights) for _, t, _, _ in rows]
    mass = np.array([w.sum() for _, w in sets])
    names, parent = {}, []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for _, _, comp, _ in rows:
        names.setdefault(comp, len(names))
    parent = list(range(len(names)))
    group = [names[c] for _, _, c, _ in rows]
    owner = np.repeat(np.arange(len(rows)), [len(h) for h, _ in sets])
    shingle, weight = np.concatenate([h for h, _ in sets]), np.concatenate([w for _, w in sets])
    by = np.argsort(shingle, kind="stable")
    shingle, weight, owner = shingle[by], weight[by], owner[by]
    out = []
    for i, (h, w) in enumerate(sets):
        if not rows[i][3]:
            continue
        lo, hi = np.searchsorted(shingle, h, "left"), np.searchsorted(shingle, h, "right")
        size = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        least = np.bincount(owner[at], np.minimum(np.repeat(w, size), weight[at]), len(rows))
        for j in np.flatnonzero(least >= THRESHOLD * (mass + mass[i] - least)).tolist():
            p, q = root(group[i]), root(group[j])
            if p != q:
                parent[p] = q
                out.append((rows[i][0], rows[j][0]))
    return out


def tile_links(members: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """(a, b): links between the texts of a key (columns key, n, apart, fp, comp, loose) that connect what its links connect.

    A key's n texts are dealt into blocks of about TILE, and so are the ``apart``
    ones of them that are loose; each block of loose ones meets each of all in
    a tile, so no task holds more than two blocks, however large a key is.
    """
    whole, some = (F.ceil(F.col(c) / TILE).cast("int") for c in ("n", "apart"))
    block = lambda n: F.pmod(F.xxhash64("fp", "key"), n).cast("int")
    every = members.select("key", "fp", "comp", F.lit(False).alias("loose"), block(whole).alias("x"), F.explode(F.sequence(F.lit(0), some - 1)).alias("y"))
    loose = members.where("loose").select("key", "fp", "comp", "loose", F.explode(F.sequence(F.lit(0), whole - 1)).alias("x"), block(some).alias("y"))
    rows = every.unionAll(loose).groupBy("key", "x", "y", "fp", "comp").agg(F.max("loose").alias("loose"))
    rows = rows.select("fp", "comp", "loose", F.xxhash64("key", "x", "y").alias("tile"))
    rows = rows.join(texts, "fp").repartition("tile").sortWithinPartitions("tile", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, tile, held = idf.value, None, []

        def links() -> pa.RecordBatch:
            found = forest(held, weights) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for t, fp, text, comp, loose in zip(*(batch.column(c).to_pylist() for c in ("tile", "fp", "text", "comp", "loose")), strict=True):
                if t != tile:
                    if held:
                        yield links()
                    tile, held = t, []
                held.append((fp, text, comp, loose))
        if held:
            yield links()

    return map_batches(rows, run, "a binary, b binary")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, rid, class_id, class_size, first) of every row; first: whether it stands for its class."""
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(idf_of(docs.select(F.col(text).alias("text"))))
    rows = checkpointed(signatures(docs, idf, key, text))
    texts_once = rows.where("fp is not null").groupBy("fp").agg(F.min("rid").alias("rid"), F.min_by("bands", "rid").alias("bands"))
    keyed = texts_once.select("fp", "rid", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("fp").alias("lead"), F.max("fp").alias("other"), F.count("*").alias("n"), F.min_by("rid", "fp").alias("r1"), F.max_by("rid", "fp").alias("r2")).where("n > 1")
    shared = checkpointed(shared)
    members = keyed.join(shared.where("n > 2").select("key", "lead", "r1"), "key")
    members = checkpointed(members)
    stars = members.where("fp <> lead").select(F.col("lead").alias("a"), F.col("fp").alias("b"))
    pairs = shared.where("n = 2").select(F.col("lead").alias("a"), F.col("other").alias("b")).unionAll(stars).distinct()

    ends = shared.select(F.col("lead").alias("fp"), F.col("r1").alias("rid")).unionAll(shared.select(F.col("other").alias("fp"), F.col("r2").alias("rid"))).unionAll(members.select("fp", "rid")).distinct()
    ends = checkpointed(ends)
    rids = ends.select("rid")
    if rids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rids = F.broadcast(rids)
    source = docs.select(_rid(key, text).alias("rid"), F.col(text).alias("text")).join(rids, "rid", "left_semi")
    texts = checkpointed(source.join(ends, "rid").dropDuplicates(["fp"]).select("fp", "text"))
    checked = checkpointed(verified(pairs, texts, idf))
    comps = checkpointed(connected_components(checked.where("ok").select("a", "b")))
    # keys whose texts are not connected yet, each set of texts once: all their pairs, tile by tile
    named = comps.select(F.col("id").alias("fp"), "comp")
    placed = members.join(named, "fp", "left").select("key", "fp", F.coalesce("comp", "fp").alias("comp"), (F.col("fp") == F.col("lead")).alias("leads"))
    sets = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.when(F.col("leads"), F.col("comp"))).alias("main"), F.sum(F.xxhash64("fp").cast("decimal(38,0)")).alias("mark"))
    sets = sets.where("lo <> hi").groupBy("n", "lo", "hi", "mark").agg(F.min(F.struct("key", "main")).alias("one"))
    open_ = checkpointed(placed.join(sets.select("one.key", "n", "one.main"), "key").select("key", "fp", "comp", "n", (F.col("comp") != F.col("main")).alias("loose")))
    apart = open_.where("loose").groupBy("key").agg(F.count("*").alias("apart"))
    more = tile_links(open_.join(apart, "key"), texts, idf)
    comps = checkpointed(connected_components(comps.select(F.col("id").alias("a"), F.col("comp").alias("b")).unionAll(more)))

    found = rows.select("doc", "rid", "fp").join(comps.withColumnRenamed("id", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    found = checkpointed(found.drop("fp"))
    groups = found.where("comp is not null").groupBy("comp").agg(F.min(F.struct("doc", "rid")).alias("stays"), F.count("*").alias("class_size"))
    out = found.join(groups, "comp", "left")
    own = F.struct("doc", "rid")
    return out.select("doc", "rid", F.coalesce("stays.doc", "doc").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.coalesce(own.eqNullSafe(F.col("stays")), F.lit(False)).alias("first"), F.col("comp").isNull().alias("alone"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stand for their class: its least id (of rows equal in id and text, one)."""
    kept = classes(docs, key, text).where("first or alone").select("rid", "alone")
    repeated = kept.where("not alone").groupBy("rid").count().where("count > 1").limit(1).count()
    # the row travels as one struct, so that no column's name can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _rid(key, text).alias("rid")).join(kept.distinct(), "rid")
    if repeated:
        rows = rows.where("not alone").dropDuplicates(["rid"]).unionByName(rows.where("alone"))
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's class of near copies."""
    from verdure.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classes(docs).select(F.col("doc").alias("doc_id"), "class_id", "class_size")
