"""Operator 1: SentencePiece encoding and decoding by a batched numpy Viterbi.

A text's words are segmented once each: distinct words of equal length are
stacked into a matrix and advance together, one position at a time. Rolling
hashes give every substring's key; a sorted array of the pieces' keys turns
them into piece ids; the best of all piece lengths that end at a position is a
vectorised maximum, whose choice is the backpointer.

What is maximal depends on the model. In a unigram model it is the sum of the
pieces' scores, ties to the longer last piece. A merge (BPE) model's scores are
ranks, and their sum means nothing: there a path is admissible if its
neighbouring pieces are ones that merging keeps apart, and just one path is
(a word's merged form is the only segmentation whose every neighbouring pair
stays apart when merged by itself). So both kinds give the library's own ids.

Characters without a piece become their UTF-8 byte pieces. Decoding gives the
text back, but U+2581 itself, which comes back as a space. Null and empty texts
have no ids and decode to the empty text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdure.llm.common import map_batches

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "\u2581"
#: Words, cut at spaces, and at line ends where no piece holds one.
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
LINE_UNIT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+")
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words and parts of words in a generation of a worker's cache, cells of one Viterbi matrix, remembered pairs.
CACHE_WORDS, CACHE_PARTS, CELLS, PAIRS = 150_000, 150_000, 1 << 19, 1 << 20
UNIGRAM, BPE = 1, 2
#: Characters that are worked on at once, at least a whole text.
CHARS = 1 << 22


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a serialised message's varint and length-delimited fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            size = varint()
            at += size
            yield tag >> 3, raw[at - size : at]
        else:
            at += 8 if tag & 7 == 1 else 4


class Pieces:
    """A model's pieces, ready to be probed."""

    def __init__(self, names: list[str], scores: list[float], kinds: list[str], unknown: int = 0, kind: int = UNIGRAM):
        """kinds: 'piece', 'byte' or 'other' (controls and the unknown piece, never matched)."""
        self.names, self.unknown, self.kind = names, unknown, kind
        self.byte_ids = {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(names, kinds, strict=True)) if k == "byte"}
        if any(SPACE in n.lstrip(SPACE) for n, k in zip(names, kinds, strict=True) if k == "piece"):
            raise ValueError("a piece spans two words")
        real = [i for i, k in enumerate(kinds) if k == "piece"]
        self.has_line_ends = any("\n" in names[i] for i in real)
        self.longest = max(len(names[i]) for i in real)
        keys = np.array([self._key(names[i]) for i in real], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(real, np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a key")
        self.present = np.zeros(1 << 22, bool)
        self.present[self.keys >> np.uint64(42)] = True
        self.score = np.array(scores, np.float64)
        self.unknown_score = float(self.score[real].min()) - 10.0
        self.powers = np.array([pow(int(BASE), k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        self.bytes_of = [bytes([int(n[3:5], 16)]) if k == "byte" else b"" if k == "other" else n.replace(SPACE, " ").encode() for n, k in zip(names, kinds, strict=True)]
        self.size = np.array([len(n) for n in names], np.int64)
        pairs = {n[i : i + 2] for n in (names[j] for j in real) for i in range(len(n) - 1)}
        self.joined = np.zeros(1 << 22, bool)
        self.joined[self._pair(np.array([ord(p[0]) for p in pairs], np.uint64), np.array([ord(p[1]) for p in pairs], np.uint64))] = True
        if kind == BPE:
            self._learn_merges(real, keys)

    @classmethod
    def load(cls, path: str) -> Pieces:
        """Reads a .model file's vocabulary; only pieces, scores, kinds and the model's kind are used."""
        raw = open(path, "rb").read()
        names, scores, kinds, unknown, kind = [], [], [], 0, UNIGRAM
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        if sp.normalize(" a  B\uff21 ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}B\uff21{SPACE}":
            raise ValueError("only models that keep the text as it is are supported")
        for i in range(sp.get_piece_size()):
            names.append(sp.id_to_piece(i))
            scores.append(sp.get_score(i))
            kinds.append("byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) else "piece")
        for number, value in _fields(raw):
            if number == 2:  # how it was trained
                kind = dict(_fields(value)).get(3, UNIGRAM)
        return cls(names, scores, kinds, sp.unk_id(), kind)

    @staticmethod
    def _key(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(BASE) + ord(c) + 1) % (1 << 64)
        return h

    def _find(self, key: np.ndarray, size) -> np.ndarray:
        """Ids of the pieces with these keys and lengths, -1 where there is none."""
        out = np.full(key.shape, -1, np.int64)
        maybe = self.present[key >> np.uint64(42)]
        some = key[maybe]
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        ids = self.ids[at]
        out[maybe] = np.where((self.keys[at] == some) & (self.size[ids] == (size if np.isscalar(size) else size[maybe])), ids, -1)
        return out

    def _learn_merges(self, real: list[int], keys: np.ndarray) -> None:
        """Of each piece: its rank among merges (-1: a character), and the two pieces that its last merge joins."""
        n = len(self.names)
        self.key_of = np.zeros(n, np.uint64)
        self.key_of[real] = keys
        self.rank = np.full(n, -1, np.int64)
        merged = np.array([i for i in real if self.size[i] > 1], np.int64)
        merged = merged[np.argsort(-self.score[merged], kind="stable")]
        self.rank[merged] = np.arange(len(merged))
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.reached = self.rank < 0
        self.pair_key, self.pair_apart = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        for length in range(2, self.longest + 1):
            ids = merged[self.size[merged] == length]
            code = np.array([[ord(c) + 1 for c in self.names[i]] for i in ids], np.uint64).reshape(len(ids), length)
            for cut in range(1, length):
                key = [np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)]
                for j in range(length):
                    key[j >= cut] = key[j >= cut] * BASE + code[:, j]
                a, b = self._find(key[0], cut), self._find(key[1], length - cut)
                ok = (a >= 0) & (b >= 0) & self.reached[a] & self.reached[b] & (self.rank[a] < self.rank[ids]) & (self.rank[b] < self.rank[ids])
                ok[ok] = self._apart(a[ok], b[ok], self.rank[ids[ok]])
                self.left[ids[ok]], self.right[ids[ok]], self.reached[ids[ok]] = a[ok], b[ok], True

    def _apart(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether merging leaves each a and b apart while only ranks under limit merge.

        Merges are undone from the last to the first; at every step the two
        pieces that meet must not have been joined earlier.
        """
        out, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            size = self.size[a] + self.size[b]
            joined = self._find(self.key_of[a] * self.powers[np.minimum(self.size[b], self.longest)] + self.key_of[b], size)
            early = (joined >= 0) & (size <= self.longest) & (self.rank[joined] < limit)
            out[live[early]] = False
            ra, rb = self.rank[a], self.rank[b]
            more = ~early & ((ra >= 0) | (rb >= 0))
            undo_a = ra > rb
            limit = np.where(undo_a, ra, rb + 1)[more]
            a, b = np.where(undo_a, self.right[a], a)[more], np.where(undo_a, b, self.left[b])[more]
            live = live[more]
        return out

    def _kept_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_apart without a limit, remembering pairs in a table of fixed size; a = -1: a character without a piece."""
        pair = a * len(self.names) + b
        slot = (pair * 0x9E3779B1 >> 7) & (PAIRS - 1)
        known = (a >= 0) & (self.pair_key[slot] == pair)
        out = self.pair_apart[slot] | ~known
        fresh = np.flatnonzero(~known & (a >= 0))
        if len(fresh):
            some, which = np.unique(pair[fresh], return_inverse=True)
            x, y = np.divmod(some, len(self.names))
            apart = self._apart(x, y, np.full(len(some), len(self.names), np.int64))
            out[fresh] = apart[which]
            at = (some * 0x9E3779B1 >> 7) & (PAIRS - 1)
            _, first = np.unique(at, return_index=True)
            self.pair_key[at[first]], self.pair_apart[at[first]] = some[first], apart[first]
        return out

    def spans(self, words: list[str]) -> tuple[list[str], list[int]]:
        """All words' parts in a row, and how many each word has.

        A word is cut wherever no piece holds the two neighbouring characters,
        which changes no result and leaves fewer different parts than words.
        """
        whole = "".join(words)
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        ends = np.cumsum([len(w) for w in words])
        cut = ~self.joined[self._pair(code[:-1], code[1:])]
        cut[ends[:-1] - 1] = True
        edges = np.concatenate([[0], np.flatnonzero(cut) + 1, [len(whole)]])
        parts = np.diff(np.searchsorted(edges, ends), prepend=0)
        at = edges.tolist()
        return [whole[i:j] for i, j in zip(at, at[1:], strict=False)], parts.tolist()

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a << np.uint64(21) | b) * BASE >> np.uint64(42)).astype(np.int64)

    def segment(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as the bytes of 32-bit integers; words of one length are advanced together."""
        out = [b""] * len(words)
        by_length = defaultdict(list)
        for i, w in enumerate(words):
            by_length[len(w)].append(i)
        for length, rows in by_length.items():
            step = max(1, CELLS // (length * min(length, self.longest)))
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                for i, ids in zip(part, self._viterbi([words[i] for i in part], length), strict=True):
                    out[i] = ids
        return out

    def _viterbi(self, words: list[str], length: int) -> list[bytes]:
        n = len(words)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length)
        prefix = np.zeros((length + 1, n), np.uint64)
        for i in range(length):
            prefix[i + 1] = prefix[i] * BASE + code[:, i] + np.uint64(1)
        most = min(length, self.longest)
        # piece[k, start]: the piece of length k + 1 from there
        piece = np.full((most, length, n), -1, np.int64)
        for k in range(1, most + 1):
            piece[k - 1, : length - k + 1] = self._find(prefix[k:] - prefix[:-k] * self.powers[k], k)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        last = np.full((length + 1, n), -1, np.int64)
        back = np.zeros((length + 1, n), np.int16)
        for end in range(1, length + 1):
            for k in range(min(end, most), 0, -1):
                ids = piece[k - 1, end - k]
                rows = np.flatnonzero(ids >= 0)
                found, before = ids[rows], last[end - k, rows]
                if self.kind == BPE:
                    ok = self.reached[found] & (best[end - k, rows] >= 0)
                    ok[ok] = self._kept_apart(before[ok], found[ok])
                    total = np.where(ok, 0.0, -np.inf)
                else:
                    total = best[end - k, rows] + self.score[found]
                better = total > best[end, rows]
                rows, found = rows[better], found[better]
                best[end, rows], last[end, rows], back[end, rows] = total[better], found, k
            odd = np.flatnonzero(piece[0, end - 1] < 0)
            total = best[end - 1, odd] + (0.0 if self.kind == BPE else self.unknown_score)
            odd, total = odd[total > best[end, odd]], total[total > best[end, odd]]
            best[end, odd], last[end, odd], back[end, odd] = total, -1, 1
        if not np.isfinite(best[length]).all():
            raise ValueError("a word has no segmentation")
        # all words walk back together; ids fill each row from its right end
        ids, used = np.full((n, length), -2, np.int32), np.zeros(n, np.int64)
        end, live = np.full(n, length), np.arange(n)
        while len(live):
            at = end[live]
            used[live] += 1
            ids[live, length - used[live]] = last[at, live]
            end[live] = at - back[at, live]
            live = live[end[live] > 0]
        flat, size = ids[ids != -2].tobytes(), (4 * np.cumsum(used)).tolist()
        out = [flat[i:j] for i, j in zip([0, *size], size, strict=False)]
        for i in np.flatnonzero((ids == -1).any(1)).tolist():
            out[i] = self._with_unknown(words[i], np.frombuffer(out[i], np.int32).tolist())
        return out

    def _with_unknown(self, word: str, ids: list[int]) -> bytes:
        """ids with each -1, a character without a piece, replaced by its bytes' pieces."""
        out, at = [], 0
        for i in ids:
            if i >= 0:
                out.append(i)
                at += int(self.size[i])
            else:
                raw = word[at].encode("utf-8", "surrogatepass")
                out.extend([self.byte_ids.get(b, self.unknown) for b in raw] if self.byte_ids else [self.unknown])
                at += 1
        return np.array(out, np.int32).tobytes()

    def encode(self, texts: list[str], cache: Cache) -> list[bytes]:
        """Each text's ids, as the bytes of 32-bit integers."""
        unit = UNIT if self.has_line_ends else LINE_UNIT
        units = [unit.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        words, parts_of = cache.words, cache.parts
        seen = {u for row in units for u in row}
        fresh = words.missing(seen)
        if fresh:
            spans, counts = self.spans(fresh)
            new = parts_of.missing(set(spans))
            parts_of.now.update(zip(new, self.segment(new), strict=True))
            at, own = 0, parts_of.now
            for word, n in zip(fresh, counts, strict=True):
                words.now[word] = own[spans[at]] if n == 1 else b"".join(map(own.__getitem__, spans[at : at + n]))
                at += n
        out = [b"".join(map(words.now.__getitem__, row)) for row in units]
        words.turn(CACHE_WORDS)
        parts_of.turn(CACHE_PARTS)
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


class Kept:
    """Ids by string in two generations: what is asked for moves to the present one, and when that is full the one before goes. So frequent strings stay."""

    def __init__(self):
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def missing(self, wanted: set[str]) -> list[str]:
        """Those that neither generation has; the others are in the present one afterwards."""
        rest = wanted.difference(self.now)
        old = rest.intersection(self.before)
        self.now.update((u, self.before[u]) for u in old)
        return list(rest - old)

    def turn(self, most: int) -> None:
        if len(self.now) > most:
            self.before, self.now = self.now, {}


class Cache:
    """Ids of words seen, and of the parts that words are cut into."""

    def __init__(self):
        self.words, self.parts = Kept(), Kept()


@lru_cache(1)
def _loaded(model: str) -> tuple[Pieces, Cache]:
    """A worker's pieces and cache; a worker that serves several tasks keeps them."""
    return Pieces.load(model), Cache()


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about CHARS bytes of a text column, or elements of a list column."""
    kind = batch.column(column).type
    size = pc.binary_length if pa.types.is_string(kind) or pa.types.is_large_string(kind) else pc.list_value_length
    total, first = np.cumsum(pc.fill_null(size(batch.column(column)), 0).to_numpy(zero_copy_only=False)), 0
    while first < batch.num_rows:
        done = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, done + CHARS, side="right")))
        yield batch.slice(first, last - first)
        first = last


def _grown(df: DataFrame, **more: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(k, v) for k, v in more.items())])


def encode(df: DataFrame, text: str = "text", to: str = "ids", model: str = DEFAULT_MODEL, decoded: str | None = None) -> DataFrame:
    """df with array column ``to``: the piece ids of column ``text``; and, if named, column ``decoded``: their text.

    Any columns may be there; those named like the new ones are replaced. Null
    and empty texts give an empty array. Needs no shuffle; a task keeps the
    segmentations of a bounded number of words, and one batch.
    """
    own = [to, *([decoded] if decoded else [])]
    rest = df.drop(*(c for c in own if c != text))
    kinds = {to: T.ArrayType(T.IntegerType()), **({decoded: T.StringType()} if decoded else {})}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, cache = _loaded(model)
        for batch in batches:
            for part in _slices(batch, text):
                ids = pieces.encode([t or "" for t in part.column(text).to_pylist()], cache)
                offsets = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                more = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))]
                if decoded:
                    more.append(pa.array([pieces.decode(np.frombuffer(x, np.int32).tolist()) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, *own])

    return map_batches(rest, run, _grown(rest, **kinds))


def decode(df: DataFrame, ids: str = "ids", to: str = "decoded", model: str = DEFAULT_MODEL) -> DataFrame:
    """df with string column ``to``: the text of array column ``ids``; null ids give null."""
    rest = df.drop(to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, _ = _loaded(model)
        for batch in batches:
            for part in _slices(batch, ids):
                texts = [None if x is None else pieces.decode(x) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, to])

    return map_batches(rest, run, _grown(rest, **{to: T.StringType()}))


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document's ids and whether decoding them gives the text back."""
    from verdure.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = encode(docs, decoded="decoded")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))
