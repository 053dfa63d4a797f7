"""Operator 5: quality scores by co-training.

Two views of a document are classified separately: its text (hashed words and
shape: shares of letters, digits, capitals and signs, word and line lengths,
repetition) and its metadata (source, language, length). Both start from the
labelled documents; in each of ROUNDS rounds either classifier labels, of *all*
documents without a label, the part it is most confident of (CONFIDENT of them
in the first round, twice as many in the second and so on), in the labels'
proportion, for the *other* one to learn from; then both go over the labelled
ones again. At the end each view's scores are calibrated on held-back labels and
a logistic combination of both scores all documents.

Labelled rows are a hash range of the ids, about LABELLED rows, which one task
learns from as hashed features. What the rounds learn from grows with the input
and stays where it is: every task trains a copy of the models on its own rows,
and the copies are averaged (at most SHARDS of them). The model's size is fixed.
Features are made once and checkpointed. Of equally confident rows a share is
taken by a hash of their ids. Results: one row a document with quality_score (0 to 1),
quality_pred (1 if it is 0.5 or more), text_score and meta_score. Null texts
count as empty, null metadata as a value of its own. Without labels of both
kinds all scores are the labels' share of 1, or 0.5 if there are none.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdure.llm.common import CHUNK, checkpointed, map_batches

LABELLED, ROUNDS, CONFIDENT, SHARDS = 12_000, 4, 0.02, 4096
#: Labels up to which their ids are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 1 << 18
TEXT_BINS, META_BINS, EPOCHS = 1 << 15, 1 << 12, 3
#: Margins count as equal within 1 / STEPS.
STEPS = 64
FEATURES = "order bigint, y int, used array<short>, v array<float>, meta array<short>"
CACHE_WORDS = 60_000
OWN = ["quality_score", "quality_pred", "text_score", "meta_score"]


class _Bins(dict):
    def __missing__(self, word: str) -> int:
        b = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % TEXT_BINS
        return b


_bins = _Bins()


def _steps(name: str, value: float, step: float) -> str:
    return f"{name}:{int(value / step)}"


def text_view(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature bins and values of a text, scaled so that words and shape weigh about alike."""
    if len(_bins) > CACHE_WORDS:
        _bins.clear()
    words = text.lower().split()
    used, n = np.unique(np.fromiter(map(_bins.__getitem__, words), np.int64, len(words)), return_counts=True)
    v = 1 + np.log(n)
    v = v / (np.sqrt(v @ v) or 1.0) if len(v) else v.astype(np.float64)
    size, lines = max(1, len(text)), text.split("\n")
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    digits = float(((code >= 48) & (code <= 57)).sum())
    capitals = float(((code >= 65) & (code <= 90)).sum())
    signs = float(((code > 32) & (code < 48)).sum() + ((code > 57) & (code < 65)).sum() + ((code > 90) & (code < 97)).sum() + ((code > 122) & (code < 127)).sum())
    shape = [
        _steps("digits", digits / size, 0.02),
        _steps("capitals", capitals / size, 0.05),
        _steps("signs", signs / size, 0.02),
        _steps("word", size / max(1, len(words)), 0.5),
        _steps("line", np.log2(size / len(lines)), 1),
        _steps("variety", len(set(words)) / max(1, len(words)), 0.05),
        _steps("repeats", 1 - len(set(lines)) / len(lines), 0.1),
        _steps("words", np.log2(1 + len(words)), 0.5),
    ]
    extra = np.array([zlib.crc32(f"#{s}".encode()) % TEXT_BINS for s in shape], np.int64)
    used, at = np.unique(np.append(used, extra), return_inverse=True)  # a bin comes once, or a step would count for one of its places only
    return used, np.bincount(at, np.append(v, np.full(len(shape), 0.5)))


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    length = "none" if n_chars is None else str(int(2 * np.log2(1 + max(0, n_chars))))
    names = [f"source:{source}", f"lang:{lang}", f"length:{length}", f"both:{source}:{lang}"]
    used = np.unique(np.array([zlib.crc32(n.encode("utf-8", "surrogatepass")) % META_BINS for n in names], np.int64))
    return used, np.ones(len(used))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Logistic:
    """Sparse logistic regression, trained by adaptive gradient steps; more training goes on from where it was."""

    def __init__(self, bins: int):
        self.w, self.g = np.zeros(bins + 1), np.full(bins + 1, 1e-2)
        self.bins = bins

    def copy(self) -> Logistic:
        other = Logistic(self.bins)
        other.w, other.g = self.w.copy(), self.g.copy()
        return other

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> Logistic:
        for _ in range(epochs):
            for (used, v), y in zip(rows, labels.tolist(), strict=True):
                d = _sigmoid(self.w[used] @ v + self.w[-1]) - y
                g = d * v
                self.g[used] += g * g
                self.w[used] -= 0.1 * (g / np.sqrt(self.g[used]) + 1e-4 * self.w[used])
                self.g[-1] += d * d
                self.w[-1] -= 0.1 * d / np.sqrt(self.g[-1])
        return self

    def margin(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return np.array([self.w[used] @ v + self.w[-1] for used, v in rows])


def _dense_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of (x, 1) by Newton steps with a small ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + 1e-2 * w)
    return w


def trained(known: list[tuple], models: list[Logistic], epochs: int) -> list[Logistic]:
    """models, one a view, after ``epochs`` more over labelled rows (features of each view, label)."""
    y = np.array([r[2] for r in known])
    return [m.fit([r[i] for r in known], y, epochs) for i, m in enumerate(models)]


def calibrated(held: list[tuple], models: list[Logistic]) -> dict:
    """The model to score with: both views' weights, their calibrations on held-back rows and the combination."""
    y = np.array([r[2] for r in held], np.float64)
    margins = np.stack([m.margin([r[i] for r in held]) for i, m in enumerate(models)], 1)
    calibrations = [_dense_logistic(margins[:, [i]], y) for i in (0, 1)]
    each = np.stack([margins[:, i] * c[0] + c[1] for i, c in enumerate(calibrations)], 1)
    return {"weights": [m.w.astype(np.float32) for m in models], "calibrations": calibrations, "mix": _dense_logistic(each, y)}


def _parts(known: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """(rows to fit, rows held back for calibration): three of four and one of four; all for both if a part lacks a label."""
    fit, held = [r for i, r in enumerate(known) if i % 4], known[::4]
    return (fit, held) if min(len({r[2] for r in part}) for part in (fit, held)) == 2 else (known, known)


def _rows(batch: pa.RecordBatch) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """The features of both views of each row of a batch of FEATURES."""
    out = []
    for used, v in (("used", "v"), ("meta", None)):
        column = batch.column(used)
        offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.int64)
        values = np.ones(len(flat)) if v is None else batch.column(v).values.to_numpy(zero_copy_only=False).astype(np.float64)
        out.append([(flat[i:j], values[i:j]) for i, j in zip(offsets[:-1], offsets[1:], strict=True)])
    return out


def _steps_of(batch: pa.RecordBatch, models: list[Logistic]) -> np.ndarray:
    """Both views' margins of a batch of FEATURES, in steps of 1 / STEPS."""
    out = []
    for (used, v), m in zip((("used", "v"), ("meta", None)), models, strict=True):
        column = batch.column(used)
        offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.int64)
        values = m.w[flat] if v is None else m.w[flat] * batch.column(v).values.to_numpy(zero_copy_only=False)
        at = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        sums = np.bincount(at, values[offsets[0] : offsets[-1]], batch.num_rows) + m.w[-1]
        out.append(np.floor(np.clip(sums, -35, 35) * STEPS).astype(np.int64))
    return np.stack(out)


def _tie(batch: pa.RecordBatch) -> np.ndarray:
    """A number from 0 to 1 that decides among equally confident rows."""
    return (batch.column("order").to_numpy() * 40_503 % (1 << 30)) / (1 << 30)


def _cut(steps: np.ndarray, n: np.ndarray, k: int) -> tuple[int, float]:
    """(step, share): the k first rows are those of earlier steps and this share of that step's. steps: in order, with their counts."""
    at = int(np.searchsorted(np.cumsum(n), k))
    return int(steps[at]), float((k - n[:at].sum()) / n[at])


def confident(counts: np.ndarray, share: float, part: float) -> tuple | None:
    """Cuts for the ``part`` of all rows that a view is surest of, ``share`` of them good: (bad cut, good cut).

    counts: rows (step, n) in order of step. None with fewer than two rows.
    """
    total = int(counts[:, 1].sum()) if len(counts) else 0
    if total < 2:
        return None
    n = min(max(2, int(total * part)), total // 2 * 2)
    good = min(n - 1, max(1, round(n * share)))
    return _cut(counts[:, 0], counts[:, 1], n - good), _cut(counts[::-1, 0], counts[::-1, 1], good)


def picked(steps: np.ndarray, tie: np.ndarray, cuts: tuple | None) -> np.ndarray:
    """Pseudo-labels: 0 below the bad cut, 1 above the good one, -1 between."""
    if cuts is None:
        return np.full(len(steps), -1)
    (low, a), (high, b) = cuts
    bad, good = (steps < low) | ((steps == low) & (tie < a)), (steps > high) | ((steps == high) & (1 - tie <= b))
    return np.where(bad & ~good, 0, np.where(good & ~bad, 1, -1))


def _pickled(df: DataFrame, function) -> object:
    """What function makes of all rows of df, which are few, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(function(batches))], pa.binary())], names=["value"])

    found = map_batches(df, run, "value binary").collect()
    return pickle.loads(found[0].value) if found else None


def _exchange(pool: DataFrame, models: list[Logistic], share: float, part: float) -> list[Logistic]:
    """The models after one round over the whole pool.

    One pass counts the rows of each step of both views' margins, which gives
    the cuts; a second trains either view on what the other one is sure of. Its
    tasks all start from the same weights, and what they change is averaged by
    their numbers of rows.
    """
    shared = pool.sparkSession.sparkContext.broadcast(models)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 70 * STEPS + 1), np.int64)
        for batch in batches:
            for view, steps in enumerate(_steps_of(batch, shared.value)):
                total[view] += np.bincount(steps + 35 * STEPS, minlength=total.shape[1])
        view, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(view.astype(np.int32)), pa.array(at - 35 * STEPS), pa.array(total[view, at])], names=["view", "step", "n"])

    counts = map_batches(pool, count, "view int, step bigint, n bigint").groupBy("view", "step").agg(F.sum("n").alias("n")).collect()
    cuts = [confident(np.array(sorted((r.step, r.n) for r in counts if r.view == view), np.int64).reshape(-1, 2), share, part) for view in (0, 1)]

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, n = [m.copy() for m in shared.value], [0, 0]
        for batch in batches:
            steps, tie, rows = _steps_of(batch, shared.value), _tie(batch), None
            for view in (0, 1):
                labels = picked(steps[1 - view], tie, cuts[1 - view])
                at = np.flatnonzero(labels >= 0)
                if len(at):
                    rows = rows or _rows(batch)
                    local[view].fit([rows[view][i] for i in at], labels[at], 1)
                    n[view] += len(at)
        for view in (0, 1):
            changes = np.stack([local[view].w - shared.value[view].w, local[view].g - shared.value[view].g]) * n[view]
            for chunk in range(0, changes.shape[1], CHUNK) if n[view] else ():
                w, g = changes[:, chunk : chunk + CHUNK]
                yield pa.RecordBatch.from_arrays([pa.array([view], pa.int32()), pa.array([chunk], pa.int32()), pa.array([n[view]]), pa.array([w], pa.list_(pa.float64())), pa.array([g], pa.list_(pa.float64()))], names=["view", "chunk", "n", "w", "g"])

    def add(key, rows):
        n = rows.column("n").to_numpy().sum()
        w, g = (np.vstack(rows.column(c).to_numpy()).sum(0) / n for c in ("w", "g"))
        return pa.table({"view": pa.array([key[0].as_py()], pa.int32()), "chunk": pa.array([key[1].as_py()], pa.int32()), "w": pa.array([w], pa.list_(pa.float64())), "g": pa.array([g], pa.list_(pa.float64()))})

    changes = map_batches(pool.coalesce(SHARDS), train, "view int, chunk int, n bigint, w array<double>, g array<double>")
    out = [m.copy() for m in models]
    for r in changes.groupBy("view", "chunk").applyInArrow(add, "view int, chunk int, w array<double>, g array<double>").collect():
        out[r.view].w[r.chunk : r.chunk + CHUNK] += r.w
        out[r.view].g[r.chunk : r.chunk + CHUNK] += r.g
    shared.unpersist()
    return out


def features(docs: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """FEATURES of every document with a key that is not labelled without being learned from: order (a hash of its key), y (its label or null) and both views. truth: (truth_key, y, learn)."""
    own = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("own_key"), "text", "source", "lang", "n_chars")
    rows = own.join(truth, F.col("own_key") == F.col("truth_key"), "left").where("learn IS NULL OR learn")
    rows = rows.select(F.pmod(F.xxhash64("own_key"), F.lit(1 << 30)).alias("order"), "y", "text", "source", "lang", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("text", "source", "lang", "n_chars"))
            text, meta = [], []
            for t, s, lang, n in zip(*columns, strict=True):
                text.append(text_view(t or ""))
                meta.append(meta_view(s, lang, n)[0].astype(np.int16))
            lists = [pa.array([u.astype(np.int16) for u, _ in text], pa.list_(pa.int16())), pa.array([v.astype(np.float32) for _, v in text], pa.list_(pa.float32())), pa.array(meta, pa.list_(pa.int16()))]
            yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("y"), *lists], names=["order", "y", "used", "v", "meta"])

    return map_batches(rows, run, FEATURES)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> dict:
    """The model. docs: key, text, source, lang, n_chars; labels: key, label (repeated labels: the majority, ties to 1).

    A hash sample of about LABELLED labels is learned from; documents with any
    other label are neither learned from nor pseudo-labelled. Null keys have no part in the fit.
    """
    given = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("truth_key"), F.col(label).alias("label"))
    n = given.count()
    learn = F.pmod(F.xxhash64("truth_key"), F.lit(1 << 30)) < min(1.0, LABELLED / max(1, n)) * (1 << 30)
    truth = given.groupBy("truth_key").agg((F.avg("label") >= 0.5).cast("int").alias("y")).withColumn("learn", learn)
    rows = checkpointed(features(docs, F.broadcast(truth) if n <= BROADCAST_LABELS else truth, key))
    known, pool = checkpointed(rows.where("y is not null").repartition(1)), rows.where("y is null")

    def read(batches: Iterator[pa.RecordBatch]) -> list[tuple]:
        out = []
        for batch in batches:
            out += zip(batch.column("order").to_pylist(), *_rows(batch), batch.column("y").to_pylist(), strict=True)
        out.sort(key=lambda r: (r[0], r[3], len(r[1][0])))
        return [r[1:] for r in out]

    def start(batches: Iterator[pa.RecordBatch]) -> tuple:
        rows = read(batches)
        share = float(np.mean([r[2] for r in rows])) if rows else 0.5
        if len({r[2] for r in rows}) < 2:
            return share, None
        part = _parts(rows)[0]
        return float(np.mean([r[2] for r in part])), trained(part, [Logistic(TEXT_BINS), Logistic(META_BINS)], EPOCHS)

    share, models = _pickled(known, start) or (0.5, None)
    if models is None:
        return {"share": share}
    for i in range(ROUNDS):
        models = _exchange(pool, models, share, CONFIDENT * (i + 1))
        models = _pickled(known, lambda batches, m=models: trained(_parts(read(batches))[0], m, 1))
    return _pickled(known, lambda batches: calibrated(_parts(read(batches))[1], models))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with the columns of OWN; columns of those names are replaced. No shuffle; the model is broadcast."""
    rest = docs.drop(*OWN)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [T.DoubleType(), T.IntegerType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([*rest.schema.fields, *(T.StructField(n, k) for n, k in zip(OWN, kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if "share" in m:
                views = np.full((batch.num_rows, 2), m["share"])
                final = np.full(batch.num_rows, m["share"])
            else:
                columns = (batch.column(c).to_pylist() for c in ("text", "source", "lang", "n_chars"))
                margins = []
                for t, s, lang, n in zip(*columns, strict=True):
                    pair = text_view(t or ""), meta_view(s, lang, n)
                    margins.append([w[used] @ v + w[-1] for w, (used, v) in zip(m["weights"], pair, strict=True)])
                margins = np.array(margins, np.float64).reshape(-1, 2)
                logits = np.stack([margins[:, i] * c[0] + c[1] for i, c in enumerate(m["calibrations"])], 1)
                views, final = _sigmoid(logits), _sigmoid(logits @ m["mix"][:2] + m["mix"][2])
            out = [pa.array(final), pa.array((final >= 0.5).astype(np.int32)), pa.array(views[:, 0]), pa.array(views[:, 1])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *OWN])

    return map_batches(rest, run, schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's quality."""
    from verdure.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", *OWN)
