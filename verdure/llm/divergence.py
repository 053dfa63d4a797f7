"""Operator 13: how the sources of a language differ in their use of terms.

Terms are runs of letters (A-Z lower-cased, and all beyond ASCII). A language
keeps those in at least LEAST_DOCS of its documents, V in number. Every (lang,
source) group, and each language, gives each kept term p = 1 + floor(SCALE *
(count + 2) / (N + 2 V)); two of them differ in it by f = floor((p - q)^2 / (p +
q)), all in whole numbers. A pair of a language's sources is worth the sum of f
over all its kept terms. A group's own terms are those it has and uses more than
its language (p > q), worth f; the TOP highest are given.

The sums over pairs are split. Terms in at least HEAVY of a language's groups are
heavy, the others light. A group that lacks a term has its base value p(0), so each
pair gets V times f of the two bases, corrected for the terms that one of the two
has. Heavy terms stand in tiles as dense numpy arrays, every two sources of a block
of sources against another. Light ones are corrected by each group's histogram of
their shares (one sided, against the other's base) and, for terms that both have, by
the postings: f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0), added up per task before
any shuffle. All parts are whole numbers, so their sum is exact.

Results: the rows of part `pair` (item: each other source, ranks over all) and of
part `term` (item: the term, ranks to TOP), ties by the item's UTF-8 bytes. Null
text, lang and source count as ''. Groups without terms have pair rows; a language
without kept terms has pairs worth 0; one source alone has none. Repeated rows
count each time, texts are read whole, other columns, whatever their names, are
ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from verdure.llm.common import map_batches, written

LEAST_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: A term in at least one of HEAVY of its language's groups is dense.
HEAVY = 4
#: Terms of a tile; sources of a block; terms that a task counts before it passes them on; pairs of postings at once.
TILE_TERMS, BLOCK_SOURCES, TASK_TERMS, PAIRS = 2048, 32, 1 << 18, 1 << 18
#: A-Z become small, what is neither a letter nor beyond ASCII a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _share(count: Column, whole: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / whole), null if whole is 0; by long division, three digits at a time, so that no product leaves 64 bits."""
    rest, out, whole = count + F.lit(2), F.lit(0), F.nullif(whole, F.lit(0))
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + _div(rest, whole), rest % whole
    return (out + 1).cast("bigint")


def _differ(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, df) of parts of the table: occurrences, and documents with the term; a group's row without a term stands for the group."""
    own = docs.select(F.col(text).alias("text"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df, size, known = defaultdict(Counter), defaultdict(Counter), 0, set()

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in n.items():
                names, of = list(terms), df[lang, source]
                for i in range(0, len(names), 1 << 14):
                    part = names[i : i + (1 << 14)]
                    columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()), pa.array([terms[t] for t in part], pa.int64()), pa.array([of[t] for t in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "df"])

        for batch in batches:
            for t, lang, source in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True):
                known.add((lang, source))
                found = Counter((t or b"").translate(LETTERS).split())
                terms, of = n[lang, source], df[lang, source]
                before = len(terms)
                terms.update(found)
                of.update(found.keys())
                size += len(terms) - before
                if size > TASK_TERMS:
                    yield from out()
                    n.clear()
                    df.clear()
                    size = 0
        yield from out()
        groups = sorted(known)
        columns = [pa.array([g[0] for g in groups], pa.string()), pa.array([g[1] for g in groups], pa.string()), pa.nulls(len(groups), pa.binary()), pa.array([0] * len(groups), pa.int64()), pa.array([0] * len(groups), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "df"])

    return map_batches(own, run, "lang string, source string, term binary, n bigint, df bigint")


def postings(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, have, of_lang), written: the groups' counts of kept terms, with the number of groups that have the term and the language's count; and of every group a row without a term.

    All is grouped on (lang, term), so one shuffle serves; every task has added up its own rows before.
    """
    each = counts(docs, text, lang, source).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    of = W.partitionBy("lang", "term")
    each = each.withColumns({"docs": F.sum("df").over(of), "have": F.count("*").over(of), "of_lang": F.sum("n").over(of)})
    return written(each.where(F.col("term").isNull() | (F.col("docs") >= least_docs)).select("lang", "source", "term", "n", "have", "of_lang"))


def groups(posts: DataFrame) -> DataFrame:
    """(lang, source, i, sources, v, heavies, whole, lang_whole, base), written, a row a group: its place among its language's sources, what shares divide by, and the share of a term that it lacks."""
    own = posts.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    of = W.partitionBy("lang")
    own = own.withColumns({"i": (F.row_number().over(of.orderBy("source")) - 1).cast("bigint"), "sources": F.count("*").over(of), "lang_size": F.sum("size").over(of)})
    terms = posts.where("term IS NOT NULL").select("lang", "term", "have").distinct().groupBy("lang", "have").agg(F.count("*").alias("m"))
    terms = terms.join(own.select("lang", "sources").distinct(), "lang").groupBy("lang").agg(F.sum("m").alias("v"), F.sum(F.when(_heavy(), F.col("m")).otherwise(0)).alias("heavies"))
    own = own.join(terms, "lang", "left").fillna(0, ["v", "heavies"])
    own = own.withColumns({"whole": F.col("size") + 2 * F.col("v"), "lang_whole": F.col("lang_size") + 2 * F.col("v")}).drop("size", "lang_size")
    return written(own.withColumn("base", _share(F.lit(0).cast("bigint"), F.col("whole"))))


def _heavy() -> Column:
    return F.col("have") * HEAVY >= F.col("sources")


def _dense(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Sums, over a tile's terms, of f less that of the bases, for every two sources of its two blocks. Rows without a term hold the sources' base values."""
    terms = rows.column("term").combine_chunks().dictionary_encode()
    named = terms.is_valid().to_numpy(zero_copy_only=False)
    block, i, p = (rows.column(c).to_numpy() for c in ("block", "i", "p"))
    t, size = terms.indices.fill_null(0).to_numpy(), len(terms.dictionary)
    sides = []
    for side in (key[2].as_py(), key[3].as_py()):
        here = block == side
        names, first = np.unique(i[here & ~named], return_index=True)
        base = p[here & ~named][first]
        values = np.repeat(base[:, None], size, axis=1)
        values[np.searchsorted(names, i[here & named]), t[here & named]] = p[here & named]
        sides.append((names, values, base))
    (left, u, own), (right, v, other) = sides
    found = [(a, right[right > a], _f(x, v[right > a]).sum(1) - size * _f(b, other[right > a])) for a, x, b in zip(left.tolist(), u, own, strict=True)]
    return _sums(key, np.concatenate([np.full(len(b), a) for a, b, _ in found]), np.concatenate([b for _, b, _ in found]), np.concatenate([n for *_, n in found]))


def _sums(key: tuple[pa.Scalar, ...], a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.Table:
    return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), **{c: pa.array(x, pa.int64()) for c, x in (("a", a), ("b", b), ("value", n))}})


def _sparse(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Corrections of a tile's light terms for every two sources that both have one, added up by pair."""
    terms, i, p, base = rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy(), *(rows.column(c).to_numpy() for c in ("i", "p", "base"))
    order = np.lexsort((i, terms))
    terms, i, p, base = terms[order], i[order], p[order], base[order]
    ends = np.searchsorted(terms, terms, side="right")
    later = ends - np.arange(len(terms)) - 1
    codes, sums, width = np.zeros(0, np.int64), np.zeros(0, np.int64), int(i.max()) + 1
    at = 0
    while at < len(terms):  # rows whose pairs come to about PAIRS; one row at least
        stop = max(at + 1, int(np.searchsorted(np.cumsum(later[at:]), PAIRS, side="right")) + at)
        m = later[at:stop]
        x = np.repeat(np.arange(at, stop), m)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m)
        value = _f(p[x], p[y]) - _f(p[x], base[y]) - _f(base[x], p[y]) + _f(base[x], base[y])
        codes, back = np.unique(np.concatenate([codes, i[x] * width + i[y]]), return_inverse=True)
        added = np.zeros(len(codes), np.int64)
        np.add.at(added, back, np.concatenate([sums, value]))
        sums, at = added, stop
    return _sums(key, codes // width, codes % width, sums)


def pair_sums(posts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, a, b, value) for each two places a < b among a language's sources."""
    kept = posts.where("term IS NOT NULL").join(_small(sizes), ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("whole")))
    tiles = F.greatest(F.lit(1).cast("bigint"), _div(F.col("v"), F.lit(TILE_TERMS)))
    kept = kept.withColumns({"tile": F.pmod(F.xxhash64("term"), tiles), "block": _div(F.col("i"), F.lit(BLOCK_SOURCES))})
    blocks = F.sequence(F.lit(0).cast("bigint"), _div(F.col("sources") - 1, F.lit(BLOCK_SOURCES)))
    meets = F.explode(F.transform(blocks, lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y"))))
    out = "lang string, a bigint, b bigint, value bigint"

    heavy = kept.where(_heavy()).select("lang", "tile", "sources", "term", "i", "p", "block")
    every = sizes.where("heavies > 0").select("lang", F.explode(F.sequence(F.lit(0).cast("bigint"), tiles - 1)).alias("tile"), "sources", F.lit(None).cast("binary").alias("term"), "i", F.col("base").alias("p"), _div(F.col("i"), F.lit(BLOCK_SOURCES)).alias("block"))
    dense = heavy.unionByName(every).select("lang", "tile", meets.alias("at"), "term", "i", "p", "block").select("lang", "tile", "at.x", "at.y", "term", "i", "p", "block")
    dense = dense.groupBy("lang", "tile", "x", "y").applyInArrow(_dense, out)

    light = kept.where(~_heavy())
    sparse = light.where("have > 1").select("lang", "tile", "term", "i", "p", "base").groupBy("lang", "tile").applyInArrow(_sparse, out)

    # one side has the term: a group's light terms by their share, against the base of each other group
    shares = light.groupBy("lang", "i", "p").agg(F.count("*").alias("m")).groupBy("lang", "i").agg(F.collect_list(F.struct("p", "m")).alias("shares"))
    one = sizes.select("lang", "i", "sources", "base").join(shares, ["lang", "i"], "left").select("lang", F.col("i").alias("own"), F.col("base").alias("own_base"), "shares", F.explode(blocks).alias("block"))
    other = sizes.select(F.col("lang").alias("its"), F.col("i").alias("o"), "base", "v", _div(F.col("i"), F.lit(BLOCK_SOURCES)).alias("its_block"))
    one = one.join(other, (F.col("lang") == F.col("its")) & (F.col("block") == F.col("its_block")) & (F.col("own") != F.col("o")))
    both = _differ(F.col("own_base"), F.col("base"))
    mine = F.aggregate(F.coalesce("shares", F.array().cast("array<struct<p:bigint,m:bigint>>")), F.lit(0).cast("bigint"), lambda n, s: n + s["m"] * (_differ(s["p"], F.col("base")) - both))
    value = F.coalesce(mine + F.when(F.col("own") < F.col("o"), F.col("v") * both).otherwise(0), F.lit(0))
    sided = one.select("lang", F.least("own", "o").alias("a"), F.greatest("own", "o").alias("b"), value.alias("value"))
    return dense.unionByName(sparse).unionByName(sided).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _small(sizes: DataFrame) -> DataFrame:
    """Marked for broadcast if there are at most 65,536 groups."""
    return F.broadcast(sizes) if sizes.count() <= 1 << 16 else sizes


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank (see above)."""
    posts = postings(docs, text, lang, source, least_docs)
    sizes = groups(posts)
    pairs = pair_sums(posts, sizes)
    both = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("at"), "value").select("lang", "at.x", "at.y", "value")
    names = sizes.select("lang", "i", "source")
    both = both.join(names.select("lang", F.col("i").alias("x"), "source"), ["lang", "x"]).join(names.select("lang", F.col("i").alias("y"), F.col("source").alias("item")), ["lang", "y"])
    own = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    both = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(own))
    p, q = _share(F.col("n"), F.col("whole")), _share(F.col("of_lang"), F.col("lang_whole"))
    terms = posts.where("term IS NOT NULL").join(_small(sizes), ["lang", "source"]).withColumns({"p": p, "q": q}).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _differ(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top).withColumn("item", F.decode("item", "UTF-8"))
    return both.unionByName(terms)


def op13_divergence(spark, sf_dir: str) -> DataFrame:
    """Every two sources of a language, and every source's own terms."""
    from verdure.llm.common import table

    return divergence(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
each AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM each GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM docs),
n AS (SELECT lang, source, term, count(*) AS n FROM each JOIN kept USING (lang, term) GROUP BY ALL),
whole AS (SELECT lang, source, coalesce(sum(n), 0) + 2 * coalesce(any_value(v), 0) AS d FROM grp LEFT JOIN n USING (lang, source) LEFT JOIN sizes USING (lang) GROUP BY lang, source),
lang_whole AS (SELECT lang, sum(n) + 2 * any_value(v) AS d FROM n JOIN sizes USING (lang) GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, (1 + {SCALE} * (coalesce(n, 0) + 2)::HUGEINT // d)::BIGINT AS p
      FROM grp g JOIN kept k ON g.lang = k.lang JOIN whole w ON w.lang = g.lang AND w.source = g.source LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
q AS (SELECT lang, term, any_value((1 + {SCALE} * (m + 2)::HUGEINT // d)::BIGINT) AS q FROM (SELECT lang, term, sum(n) AS m FROM n GROUP BY ALL) JOIN lang_whole USING (lang) GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
all_pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM all_pairs
UNION ALL SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM terms
QUALIFY rank <= {TOP}
"""
