"""Operator 7: fuzzy line dedup by pigeonhole blocks of words, SimHash, edit similarity and connected groups.

A line is normalised to its lower-case words; lines of equal words are copies of
one *distinct line*. A line's words are dealt by their hashes into BLOCKS blocks
that lie on a ring. By the pigeonhole principle a few changed words leave some
blocks as they were, so lines are joined on what begins each block: its first
words and those that follow it on the ring, TAKE of them for short and for long
lines. Candidates whose SimHashes (64 bits, each the majority vote of the
different words' hashes) differ in more than BITS bits, or that differ in more
than half of their words, are dropped; the others are linked if the edit similarity of their words (1 - Levenshtein distance / the
longer one's length) is MIN_SIMILARITY or more. Of each connected group of lines
the first occurrence stays, in order of doc_id, document hash and line number.

Why not blocks of the SimHash's own bits: similar lines differ in up to 10 of
its 64 bits, and no choice of blocks that ten bits leave alone is selective; the
README has the figures. The words are the votes, and a block of words is a block
of votes that a change elsewhere doesn't touch.

No key's pairs are all made. Its lines are first compared with its least one;
where that leaves some apart, with the least one of the same key that has the
same quarter of the SimHash; only what then is neither connected nor too far
apart by length and SimHash is compared line by line, within the join: pairs
that are no links are never made.

Results: every row of the documents, its text without the lines that repeat an
earlier one, and its line counts n_lines and n_removed (columns of these two
names are replaced, any others stay). However short, lines take part: those
without a letter or digit as they are, without spaces at their ends. Blank lines
always stay. Null texts stay null with 0 lines. Rows equal in doc_id and text
are treated alike: a line keeps its place in each. Of lines that differ over
more than LONG letters the words are compared instead of the letters, part by
part, which links none whose words are less similar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdure.llm.common import checkpointed, connected_components

BLOCKS_LOG = 3
#: (words that a key takes, least and most words of lines that have such keys); lines of a length that has both have both.
TAKE = [(3, 0, 16), (4, 14, 1 << 30)]
#: The second kind of keys takes words of this many letters or more only, if there are at least so many.
LETTERS, ENOUGH = 4, 8
#: A line with more characters a word than this counts pairs of characters as its words.
UNSPACED = 16
BITS, MIN_SIMILARITY = 16, 0.8
#: Lines that differ over more letters than LONG are compared word by word, in parts of PART words; a word is one of CODES.
LONG, PART, CODES = 640, 4096, 20_480
#: The lines of a key that are compared one by one stand in shares of SHARE, in MOST_SHARES at most.
SHARE, MOST_SHARES = 256, 64
#: Bytes of rows that may be broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 1 << 25
#: (counts in a long, bits of each): a line takes the first whose half of the range holds its number of different words.
LAYOUTS = [(7, 9), (3, 21), (2, 31)]
#: Steps by which the common ends of two lines are found.
STEPS = [1 << i for i in range(14, -1, -1)]


def row_id(text: str, key: str) -> list[Column]:
    """r1, r2: 128 bits that name a row by its key and text."""
    return [F.xxhash64(F.col(key), F.col(text)).alias("r1"), F.xxhash64(F.lit(1), F.col(key), F.col(text)).alias("r2")]


def line_rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(doc, r1, r2, pos, norm, w) of each line that may be removed: norm is its normal form, w the words of that, letters and digits in lower case."""
    rows = docs.select(F.col(key).alias("doc"), *row_id(text, key), F.lower(text).alias("raw"))
    lines = rows.select("doc", "r1", "r2", F.posexplode(F.split("raw", "\n")).alias("pos", "line")).where(F.col("line").rlike(r"[^\s\p{Z}]"))
    lines = lines.select("doc", "r1", "r2", "pos", "line", F.array_remove(F.split("line", r"[^\p{L}\p{N}]+"), "").alias("w"))
    norm = F.when(F.size("w") > 0, F.array_join("w", " ")).otherwise(F.regexp_replace("line", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    lines = lines.select("doc", "r1", "r2", "pos", norm.alias("norm"), "w")
    return lines.withColumn("w", F.when(F.size("w") > 0, F.col("w")).otherwise(F.split("norm", " ")))


def with_keys(lines: DataFrame) -> DataFrame:
    """lines (.., norm, w) with norm's hashes h and h2 and its join keys (array ``keys``) in their place."""
    own = [c for c in lines.columns if c not in ("norm", "w")]
    names = [*own, "h", "h2"]
    letters = F.split("norm", "")
    pairs = F.transform(letters, lambda c, i: F.concat(c, F.coalesce(F.get(letters, i + 1), F.lit(""))))
    words = F.when(F.length("norm") > UNSPACED * F.size("w"), pairs).otherwise(F.col("w"))
    lines = lines.select(*own, F.xxhash64("norm").alias("h"), F.xxhash64(F.lit(1), "norm").alias("h2"), words.alias("w"))
    takes = [F.size("w").between(least, most) for _, least, most in TAKE]
    lines = lines.select(*names, "w", F.when(takes[1], F.filter("w", lambda w: F.length(w) >= LETTERS)).alias("long"))
    chosen = [F.col("w"), F.when(F.size("long") >= ENOUGH, F.col("long")).otherwise(F.col("w"))]
    rings = [F.when(taken, F.sort_array(F.array_distinct(F.transform(c, lambda w: F.xxhash64(w))))) for c, taken in zip(chosen, takes, strict=True)]
    lines = lines.select(*names, *(r.alias(f"x{i}") for i, r in enumerate(rings)))
    # where the blocks begin: their least hashes, sorted in among the words' (a block's place less the blocks before it is its first word's)
    starts = [(k << (64 - BLOCKS_LOG)) - (1 << 63) for k in range(1 << BLOCKS_LOG)]
    both = range(len(rings))
    lines = lines.select(*names, *(f"x{i}" for i in both), *(F.sort_array(F.concat(f"x{i}", F.array(*map(F.lit, starts)))).alias(f"y{i}") for i in both))
    at = [F.array(*(F.array_position(f"y{i}", F.lit(a)).cast("int") - 1 - k for k, a in enumerate(starts)), F.size(f"x{i}")) for i in both]
    lines = lines.select(*names, *(f"x{i}" for i in both), *(F.when(F.col(f"x{i}").isNotNull(), a).alias(f"p{i}") for i, a in enumerate(at)))

    def keys(i: int, take: int) -> Column:
        full = F.filter(F.sequence(F.lit(0), F.lit(len(starts) - 1)), lambda k: F.get(f"p{i}", k) < F.get(f"p{i}", k + 1))
        found = F.transform(full, lambda k: F.xxhash64(F.lit(take), *(F.get(f"x{i}", (F.get(f"p{i}", k) + j) % F.size(f"x{i}")) for j in range(take))))
        return F.when(F.col(f"x{i}").isNotNull(), found).otherwise(F.array().cast("array<bigint>"))

    return lines.select(*names, F.concat(*(keys(i, take) for i, (take, *_) in enumerate(TAKE))).alias("keys"))


def _votes(hashes: Column, lanes: int, width: int) -> Column:
    """How many of the hashes have each bit: longs v0, v1 ... of ``lanes`` counts of ``width`` bits each.

    Count i of long k is that of bit k + width * i; each bit beyond these has a long of its own.
    """
    mask = F.lit(sum(1 << (width * i) for i in range(lanes)))

    def struct(values) -> Column:
        return F.struct(*(v.alias(f"v{k}") for k, v in enumerate(values)))

    def add(votes: Column, x: Column) -> Column:
        more = [F.shiftrightunsigned(x, k).bitwiseAND(mask) for k in range(width)] + [F.shiftrightunsigned(x, k).bitwiseAND(F.lit(1)) for k in range(lanes * width, 64)]
        return struct(votes[f"v{k}"] + m for k, m in enumerate(more))

    return F.aggregate(hashes, struct([F.lit(0).cast("long")] * (width + 64 - lanes * width)), add)


def _majority(votes: str, n: Column, lanes: int, width: int) -> Column:
    """The 64-bit long whose set bits are those that more than half of n hashes have.

    All counts of a long are compared at once: what is added lifts just those above n / 2 to their lane's highest bit.
    """
    mask, top = F.lit(sum(1 << (width * i) for i in range(lanes))), 1 << (width - 1)
    least = F.floor(n / 2) + 1
    lift, out = F.greatest(top - least, F.lit(0)) * mask, F.lit(0).cast("long")  # rows of other layouts must not overflow
    for k in range(width):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col(f"{votes}.v{k}") + lift, width - 1).bitwiseAND(mask), k))
    for k in range(width, width + 64 - lanes * width):
        out = out.bitwiseOR(F.shiftleft((F.col(f"{votes}.v{k}") >= least).cast("long"), lanes * width + k - width))
    return out


def simhashes(lines: DataFrame) -> DataFrame:
    """lines (.., norm) with sim, the 64-bit SimHash of norm's different words. A line's votes are added up within its row, several in a long."""
    own, hashes = lines.columns, F.array_distinct(F.transform(F.split("norm", " "), lambda word: F.xxhash64(word)))
    x = lines.select(*own, hashes.alias("x"))
    n, below, votes, sim = F.size("x"), 0, [], None
    for k, (lanes, width) in enumerate(LAYOUTS):
        most = (1 << (width - 1)) - 1
        votes.append(F.when((n > below) & (n <= most), _votes(F.col("x"), lanes, width)).alias(f"votes{k}"))
        each = _majority(f"votes{k}", F.col("n"), lanes, width)
        sim, below = each if sim is None else F.coalesce(sim, each), most
    return x.select(*own, n.cast("long").alias("n"), *votes).select(*own, sim.alias("sim"))


def bounded(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, marked for broadcast if its rows of about ``row_bytes`` each are counted and no more than BROADCAST_BYTES."""
    most = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _without_common_start(df: DataFrame, x: str, y: str) -> DataFrame:
    """df with x and y cut after what they have in common at their start, which leaves their edit distance as it is."""
    a, b, n = F.col(x), F.col(y), F.least(F.length(x), F.length(y))
    start = F.aggregate(F.array(*map(F.lit, STEPS)), F.lit(0), lambda p, step: F.when((p + step <= n) & (a.substr(p + 1, step) == b.substr(p + 1, step)), p + step).otherwise(p))
    rest = F.greatest(F.length(x), F.length(y))
    cut = df.withColumn("_p", start + 1)
    return cut.withColumn(x, F.when(F.col("_p") > 1, a.substr(F.col("_p"), rest)).otherwise(a)).withColumn(y, F.when(F.col("_p") > 1, b.substr(F.col("_p"), rest)).otherwise(b)).drop("_p")


def _near(x: str, y: str) -> Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= BITS


def _coded(text: str) -> Column:
    """The text with each word as one character, of CODES: its edit distance is that of the words."""
    code = F.transform(F.split(text, " "), lambda w: F.hex(F.pmod(F.xxhash64(w), F.lit(CODES)) + 0x4E00))
    return F.decode(F.unhex(F.array_join(code, "")), "UTF-16BE")


def _longest(text: str) -> Column:
    return F.array_max(F.transform(F.split(text, " "), lambda w: F.length(w)))


def may_link() -> Column:
    """Whether lines x and y, coded as p and q, may be a link: true for all that ``verified`` keeps, false for nearly all that it drops.

    Here the ends that two lines share are not cut off. That leaves the distance
    of the letters as it is and adds four at most to that of the words. A pair
    with more differing words than this allows is a link only if all its letters
    that differ stand in a part with short words; then much of one end is shared.
    """
    share = lambda size: f"cast(floor({size} * {1 - MIN_SIMILARITY} + 1e-9) as int)"
    size, n = "greatest(length(x), length(y))", "greatest(length(p), length(q))"
    half = f"cast({share(n)} / {1 - MIN_SIMILARITY} / 2 as int) + 6"
    near, same_end = f"levenshtein(x, y, {share(size)}) >= 0", lambda h: f"(left(x, {h}) = left(y, {h}) OR right(x, {h}) = right(y, {h}))"
    short = f"(levenshtein(p, q, {half}) >= 0 OR {same_end(f'cast({size} / 4 as int)')}) AND {near}"
    end = same_end(f"cast(least(8 * {size} / ({n} + 16), ({size} - {LONG}) / 2) as int)")
    long = f"levenshtein(p, q, {share(n)} + 8) >= 0 OR {end} AND ({size} > {4 * LONG} OR {near})"
    return F.expr(f"CASE WHEN {size} <= {LONG} THEN {short} ELSE {long} END")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of line ids that are links; texts: (id, norm, sim), and perhaps what ``described`` adds.

    Where so few words differ that their letters can't be too many, the edit
    distance of the words is enough; else that of the letters is taken, without
    what the two lines share at their ends.
    """
    texts = texts if "code" in texts.columns else described(texts)
    names = {"id": "ab", "norm": "xy", "sim": "st", "code": "pq", "longest": "mn"}
    one, other = (texts.select(*(F.col(c).alias(n[i]) for c, n in names.items())) for i in (0, 1))
    share = lambda size: F.floor(size * (1 - MIN_SIMILARITY) + 1e-9).cast("int")
    both = pairs.join(one, "a").join(other, "b").where(_near("s", "t") & (F.abs(F.length("x") - F.length("y")) <= share(F.greatest(F.length("x"), F.length("y")))))
    both = both.select("a", "b", "x", "y", "p", "q", share(F.greatest(F.length("x"), F.length("y"))).alias("most"), share(F.greatest(F.length("p"), F.length("q"))).alias("words"), F.greatest("m", "n").alias("longest"))
    both = both.withColumn("few", F.floor(F.col("most") / (F.col("longest") + 1)).cast("int"))
    both = both.select("a", "b", "x", "y", "most", "words", F.expr("levenshtein(p, q, few) >= 0").alias("sure"))
    # the rest is for pairs that are not sure: of the others the texts are null
    unsure = [F.when(~F.col("sure"), F.col(c)).alias(c) for c in ("x", "y")]
    both = _without_common_start(both.select("a", "b", *unsure, "most", "words", "sure"), "x", "y").select("a", "b", F.reverse("x").alias("x"), F.reverse("y").alias("y"), "most", "words", "sure")
    both = _without_common_start(both, "x", "y")
    both = both.select("a", "b", "x", "y", "most", "words", "sure", _coded("x").alias("p"), _coded("y").alias("q"), F.greatest(_longest("x"), _longest("y")).alias("longest"))
    few = F.floor(F.col("most") / (F.col("longest") + 1)).cast("int")
    half = F.floor(F.col("words") / (1 - MIN_SIMILARITY) / 2).cast("int") + 1
    both = both.select("a", "b", "x", "y", "most", "words", "sure", "p", "q", few.alias("few"), half.alias("half"), (F.greatest(F.length("x"), F.length("y")) > LONG).alias("long"))
    parts = F.sequence(F.lit(0), F.floor(F.greatest(F.length("p"), F.length("q")) / PART).cast("int"))
    far = F.aggregate(parts, F.lit(0), lambda sum_, i: sum_ + F.levenshtein(F.col("p").substr(i * PART + 1, F.lit(PART)), F.col("q").substr(i * PART + 1, F.lit(PART))))
    ok = F.when(F.col("sure"), True).when(F.expr("levenshtein(p, q, few)") >= 0, True).when(F.col("long"), far <= F.col("words")).when(F.expr("levenshtein(p, q, half)") < 0, False).otherwise(F.expr("levenshtein(x, y, most)") >= 0)
    return checkpointed(both.select("a", "b", ok.alias("ok"))).where("ok").select("a", "b")


def described(texts: DataFrame) -> DataFrame:
    """texts (id, norm, ..) with their words as characters (code) and the letters of their longest word."""
    return texts.withColumns({"code": _coded("norm"), "longest": _longest("norm")})


def _some(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def _met(apart: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of lines of one key, in different components, that may be links. apart: (key, id, sim, size, comp); texts: (id, norm, code)."""
    step = F.floor(F.log(F.col("size") + 1) / F.log(F.lit(1 / MIN_SIMILARITY))).cast("int")
    # large groups are dealt out: each line has one share of those that it is compared with
    groups = apart.groupBy("key").agg(F.least(F.lit(MOST_SHARES), F.ceil(F.count("*") / SHARE)).cast("int").alias("shares"))
    own = apart.groupBy("id").agg(F.collect_set("key").alias("keys")).join(texts.select("id", "norm", "code"), "id")
    rows = apart.join(groups, "key").join(own, "id").withColumn("step", step)
    # lines of one step meet once, and those of a step the ones of the next
    one = rows.select("key", F.explode(F.array("step", F.col("step") + 1)).alias("step"), F.pmod(F.xxhash64("id"), F.col("shares")).alias("share"), F.col("id").alias("a"), F.col("step").alias("own"), F.col("sim").alias("s"), F.col("size").alias("m"), F.col("comp").alias("c"), "keys", F.col("norm").alias("x"), F.col("code").alias("p"))
    other = rows.select("key", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares").cast("long") - 1)).alias("share"), F.col("id").alias("b"), F.col("sim").alias("t"), "size", "comp", F.col("keys").alias("its"), F.col("norm").alias("y"), F.col("code").alias("q"))
    fits = ((F.col("own") < F.col("step")) | (F.col("a") < F.col("b"))) & (F.col("c") != F.col("comp")) & _near("s", "t") & (F.least("m", "size") >= MIN_SIMILARITY * F.greatest("m", "size") - 1e-9)
    once = F.col("key") == F.array_min(F.array_intersect("keys", "its"))
    return one.join(other, ["key", "step", "share"]).where(fits & once & may_link()).select("a", "b")


def line_groups(lines: DataFrame, distinct: DataFrame, docs: DataFrame, text: str, key: str) -> DataFrame:
    """(h, h2, comp) of the distinct lines that are linked to others. lines: (h, keys); distinct: (h, r1, r2), one row or more a line.

    Here h names a line. Of lines that differ but share h, one takes part.
    """
    keyed = lines.select("h", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("h").alias("lead"), F.max("h").alias("other"), F.count("*").alias("n")).where("lead <> other")
    shared = checkpointed(shared)
    members = checkpointed(keyed.join(bounded(shared.where("n > 2").select("key", "lead"), 24), "key").distinct())
    stars = shared.where("n = 2").select(F.col("lead").alias("a"), F.col("other").alias("b")).unionAll(members.where("h <> lead").select(F.col("lead").alias("a"), F.col("h").alias("b")))
    # the candidates' words, from the documents where they come first
    ends = checkpointed(stars.select(F.explode(F.array("a", "b")).alias("h")).distinct())
    ends = bounded(ends, 16)
    rows = distinct.join(ends, "h", "left_semi").select("r1", "r2").distinct()
    source = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).withColumns(dict(zip(("r1", "r2"), row_id("_text", "_key"), strict=True)))
    source = source.join(bounded(checkpointed(rows), 24), ["r1", "r2"], "left_semi")
    words = line_rows(source, "_text", "_key").select(F.xxhash64("norm").alias("h"), F.xxhash64(F.lit(1), "norm").alias("h2"), "norm")
    words = words.join(ends, "h", "left_semi").dropDuplicates(["h"]).withColumnRenamed("h", "id")
    texts = checkpointed(simhashes(described(words)))
    tried = members.join(texts.select(F.col("id").alias("h"), "sim", F.length("norm").alias("size")), "h")
    tried = checkpointed(tried.select("key", F.col("h").alias("id"), "sim", "size", (F.col("h") == F.col("lead")).alias("first")))
    # a key's lines meet its least one, and the least of those that have the same quarter of the SimHash
    quarters = F.array(*(F.xxhash64("key", F.lit(q), F.shiftrightunsigned("sim", 16 * q).bitwiseAND(F.lit(0xFFFF))) for q in range(4)))
    parts = tried.select("id", F.explode(quarters).alias("part"))
    leads = parts.groupBy("part").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").drop("b")
    near = parts.join(leads, "part").where("a <> id").select("a", F.col("id").alias("b"))
    comps = connected_components(verified(stars.unionAll(near).distinct(), texts))
    # what is open still: lines of a key in different components, near by length and SimHash; the least one has met all
    apart = tried.where("not first").join(bounded(comps, 16), "id", "left").select("key", "id", "sim", "size", F.coalesce("comp", "id").alias("comp"))
    open_keys = apart.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    apart = checkpointed(apart.join(open_keys.select("key"), "key", "left_semi"))
    met = checkpointed(_met(apart, texts))
    if _some(met):
        comps = _merged(comps, verified(met, texts))
    return comps.join(texts.select("id", "h2"), "id").select(F.col("id").alias("h"), "h2", "comp")


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components of the old ones and new links, which join old components or lines that have none."""
    if not _some(links):
        return comps
    for end in ("a", "b"):
        links = links.join(comps.withColumnRenamed("id", end), end, "left").withColumn(end, F.coalesce("comp", end)).drop("comp")
    joined = connected_components(links.select("a", "b"))
    old = comps.join(joined.select(F.col("id").alias("comp"), F.col("comp").alias("whole")), "comp", "left").select("id", F.coalesce("whole", "comp").alias("comp"))
    return old.unionAll(joined.join(comps, "id", "left_anti"))


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with ``text`` replaced by the text without repeated lines, and columns n_lines, n_removed (see above)."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    lines = checkpointed(with_keys(line_rows(docs, text, key)))
    place = F.struct("doc", "r1", "r2", "pos")
    distinct = checkpointed(lines.groupBy("h", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    linked = checkpointed(line_groups(lines, distinct.select("h", "first.r1", "first.r2"), docs, text, key))
    found = distinct.join(bounded(linked, 48), ["h", "h2"])
    firsts = found.groupBy("comp").agg(F.min("first").alias("stay"))
    moved = checkpointed(found.join(firsts, "comp").select("h", "h2", "stay"))
    stay = distinct.join(bounded(moved, 80), ["h", "h2"], "left").where("n > 1 or stay is not null").select("h", "h2", F.coalesce("stay", "first").alias("stay"))
    gone = lines.join(bounded(checkpointed(stay), 80), ["h", "h2"]).where(~place.eqNullSafe(F.col("stay")))
    gone = checkpointed(gone.groupBy("r1", "r2").agg(F.collect_set("pos").alias("gone")))
    size = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    if 48 * size[0] + 4 * size[1] <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    # the row travels as one struct, so that no column's name can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), *row_id(text, key)).join(gone, ["r1", "r2"], "left")
    body = F.col("row").getField(text)
    kept = F.filter(F.split(body, "\n"), lambda line, i: ~F.array_contains("gone", i))
    n_lines = F.when(body.isNull(), 0).otherwise(F.size(F.split(body, "\n"))).cast("long")
    left = F.when(F.col("gone").isNull(), body).otherwise(F.array_join(kept, "\n"))
    return rows.select(*(left.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in own), n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat earlier ones."""
    from verdure.llm.common import table

    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
