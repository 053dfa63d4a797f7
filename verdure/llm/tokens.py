"""Operator 3: token counts that survive edits.

A text is cut into pre-tokens, whose tokens are counted one by one; a segment
tree over blocks of pre-tokens keeps the sums. An edit re-cuts the text only
from a few characters before the edit until the new cuts meet the old ones
again, re-encodes the pre-tokens in between, replaces the touched leaves and
renews the sums above them. The total after any edits is the tree's root.

Results: counts equal those of encoding the edited text anew. Null counts as
the empty text: no pre-tokens, no tokens. Edits apply in their order, each to
the text that the one before left; positions beyond the text's end are moved
to it, negative ones to 0.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdure.llm.common import map_batches

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: How many characters past its end a pre-token's match may have looked at.
LOOK = 2
#: Pre-tokens in a leaf when built; a leaf of twice as many is split.
LEAF = 64
CACHE_WORDS = 250_000
EDITS = "array<struct<at:bigint,remove:bigint,insert:string>>"


class Counter:
    """Token counts of pre-tokens, each counted once."""

    def __init__(self, ranks: str = DEFAULT_RANKS):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(ranks, "rb") if line.strip())}
        self._encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.cut = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def counts(self, words: list[str]) -> list[int]:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = len(self._encoding.encode_ordinary(w))
        return [known[w] for w in words]


class Tree:
    """A text's pre-tokens in leaves, and the sums of tokens and characters above them."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter, self.recounted = text, counter, 0
        words = counter.cut.findall(text)
        tokens = counter.counts(words)
        self.leaves = [([len(w) for w in words[a : a + LEAF]], tokens[a : a + LEAF]) for a in range(0, len(words), LEAF)] or [([], [])]
        self._build()

    def _build(self) -> None:
        """Sums in heap order: node i has children 2i and 2i + 1, leaves come last."""
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (sizes, tokens) in enumerate(self.leaves):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(sizes), sum(tokens)
        for i in range(self.width - 1, 0, -1):
            self._add(i)

    def _add(self, i: int) -> None:
        self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _renew(self, leaf: int) -> None:
        i = self.width + leaf
        sizes, tokens = self.leaves[leaf]
        self.chars[i], self.tokens[i] = sum(sizes), sum(tokens)
        while i := i // 2:
            self._add(i)

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def words(self) -> int:
        return sum(len(sizes) for sizes, _ in self.leaves)

    def _find(self, at: int) -> tuple[int, int, int]:
        """Leaf, place in it and start of the pre-token that holds character at, or of the last one."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if at - start >= self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        leaf = i - self.width
        sizes = self.leaves[leaf][0]
        for place, size in enumerate(sizes):
            if at < start + size or place == len(sizes) - 1:
                return leaf, place, start
            start += size
        return leaf, 0, start

    def edit(self, at: int, remove: int, insert: str) -> None:
        at = min(max(at or 0, 0), len(self.text))
        remove = min(max(remove or 0, 0), len(self.text) - at)
        insert = insert or ""
        first, place, start = self._find(max(0, at - LOOK - 1))
        if place or first:  # one more, as a match may have looked ahead into the edit
            first, place, start = self._find(max(0, start - 1))
        new = self.text[:at] + insert + self.text[at + remove :]
        shift = len(insert) - remove
        # old cuts past the edit, one by one
        leaf, spot, old = first, place, start
        words, sizes, cut = [], self.leaves[leaf][0], start
        for m in self.counter.cut.finditer(new, start):
            while old + shift < cut or old < at + remove:
                if spot == len(sizes):
                    if leaf + 1 == len(self.leaves):
                        break
                    leaf, spot = leaf + 1, 0
                    sizes = self.leaves[leaf][0]
                    continue
                old += sizes[spot]
                spot += 1
            if old >= at + remove and old + shift == cut and cut >= at + len(insert):
                break
            words.append(m[0])
            cut = m.end()
        else:
            leaf, spot = len(self.leaves) - 1, len(self.leaves[-1][0])
        self.recounted += len(words)
        (head, head_n), (tail, tail_n) = self.leaves[first], self.leaves[leaf]
        sizes = [*head[:place], *map(len, words), *tail[spot:]]
        tokens = [*head_n[:place], *self.counter.counts(words), *tail_n[spot:]]
        self.text = new
        if first == leaf and 0 < len(sizes) < 2 * LEAF:
            self.leaves[first] = (sizes, tokens)
            self._renew(first)
        else:
            fresh = [(sizes[a : a + LEAF], tokens[a : a + LEAF]) for a in range(0, len(sizes), LEAF)]
            self.leaves[first : leaf + 1] = fresh
            self.leaves = self.leaves or [([], [])]
            self._build()


@lru_cache(1)
def _counter(ranks: str) -> Counter:
    return Counter(ranks)


def count(df: DataFrame, text: str = "text", edits: str | None = None, ranks: str = DEFAULT_RANKS) -> DataFrame:
    """df with n_pretokens, n_tokens of the text and, if ``edits`` names an array<struct<at,remove,insert>>
    column, of the text after these edits: edited, n_tokens_edited and n_recounted, the pre-tokens encoded anew.

    Columns of those names are replaced. No shuffle; a task holds one batch and a bounded word cache.
    """
    own = ["n_pretokens", "n_tokens", *(["edited", "n_tokens_edited", "n_recounted"] if edits else [])]
    rest = df.drop(*own)
    kinds = [T.StringType() if n == "edited" else T.LongType() for n in own]
    schema = T.StructType([*rest.schema.fields, *(T.StructField(n, k) for n, k in zip(own, kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(ranks)
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                rows = []
                changes = batch.column(edits).to_pylist() if edits else [None] * batch.num_rows
                for t, change in zip(batch.column(text).to_pylist(), changes, strict=True):
                    tree = Tree(t or "", counter)
                    row = [tree.words, tree.total]
                    for e in change or []:
                        if e:
                            tree.edit(e["at"], e["remove"], e["insert"])
                    rows.append([*row, *([tree.text, tree.total, tree.recounted] if edits else [])])
                more = [pa.array(c, pa.string() if n == "edited" else pa.int64()) for n, c in zip(own, zip(*rows, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *own])

    return map_batches(rest, run, schema)


def redactions(text: Column) -> Column:
    """The edits of the query: a mark a third into the text, a cut of 20 characters in the middle, a line at the end."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    third, half = F.floor(n / 3), F.floor(n / 2)
    return F.array(*(F.struct(at.cast("long").alias("at"), F.lit(k).cast("long").alias("remove"), F.lit(s).alias("insert")) for at, k, s in ((third, 0, "[redacted]"), (half, 20, ""), (n, 0, "\n--"))))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every document's tokens, before and after three edits."""
    from verdure.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("edits", redactions(F.col("text")))
    return count(docs, edits="edits").select("doc_id", "n_pretokens", "n_tokens", "n_tokens_edited", "n_recounted")
