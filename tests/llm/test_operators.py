"""Operators against brute force, library results, round trips and held-out labels; and on odd tables."""

import collections
import importlib
import random

import duckdb
import numpy as np
import pytest
import xxhash

DATA, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
html, langid, lines, mixing, near, ogg, pieces, quality, tokens, topk = (importlib.import_module(f"verdure.llm.{m}") for m in ("html", "langid", "lines", "mixing", "near", "ogg", "pieces", "quality", "tokens", "topk"))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, score string, _rid string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()
ODD = [
    (1, "The quick brown fox jumps over the lazy dog again and again.\nA second line that stands alone here.", "en", "a", 10, "x", "y", "z"),
    (2, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 10, None, None, None),
    (2, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 10, None, None, None),
    (3, None, "en", None, None, None, None, None),
    (4, "", None, "b", 0, None, None, None),
    (5, " \n\t\n", "fr", "b", 3, None, None, None),
    (None, "Un texte sans numéro, bien à part des autres lignes.", "fr", "b", 5, None, None, None),
    (7, "日本語 😀 ▁ \x00 ok", "ja", "c", 9, None, None, None),
    (8, " ".join(random.Random(1).choices(WORDS, k=30000)), "en", "c", 9, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    return [r[0] for r in duckdb.sql(f"SELECT text FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()] + ["", " ", "  a  b ", "日本語\n\n x\t😀", "aaaa" * 500]


def test_pieces_equal_the_library(texts):
    import sentencepiece

    p, cache = pieces.Pieces.load(pieces.DEFAULT_MODEL), pieces.Cache()
    got = [np.frombuffer(x, np.int32).tolist() for x in p.encode(texts, cache)]
    assert got == sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL).encode(texts)
    assert [p.decode(x) for x in got] == texts


def test_unigram_viterbi_is_the_best_path():
    names, scores = ["<unk>", "a", "b", "ab", "ba", "aba", "bb"], [0, -1.0, -1.5, -1.8, -2.1, -3.9, -2.0]
    p = pieces.Pieces(names, scores, ["other"] + ["piece"] * 6)

    def best(w):
        if not w:
            return 0.0
        return max(best(w[: -len(n)]) + s for n, s in zip(names[1:], scores[1:], strict=True) if w.endswith(n))

    words = ["".join(random.Random(i).choices("ab", k=1 + i % 9)) for i in range(60)]
    for w, raw in zip(words, p.segment(words), strict=True):
        ids = np.frombuffer(raw, np.int32).tolist()
        assert "".join(names[i] for i in ids) == w and sum(scores[i] for i in ids) == pytest.approx(best(w))


def test_html():
    page = "<html><body><nav><a href=x>Menu</a></nav><div class='cookie-notice'>We use</div><article><h1>T &amp; U</h1><p>One  <b>two</b>\n three<p>Four<script>x('</p>')</script><div class=comments>nice</div></article><footer>f</footer>"
    assert html.main_text(page) == "T & U\nOne two three\nFour"
    assert [html.main_text(x) for x in (None, "", "<nav><a>m</a></nav>", "<")] == ["", "", "", "<"]
    plain = "<body><div id=menu><a>x</a><a>y</a></div><div><p>Some long text that is the content of this page.</p><p>And a second part.</p></div><div class=footer>z</div></body>"
    assert html.main_text(plain) == "Some long text that is the content of this page.\nAnd a second part."


def test_token_trees_under_edits():
    counter, rng, alphabet = tokens.Counter(), random.Random(3), list("ab'sl  \n\t1.é,$%")
    for _ in range(300):
        tree = tokens.Tree("".join(rng.choices(alphabet, k=rng.randint(0, 700))), counter)
        for _ in range(4):
            tree.edit(rng.randint(-1, len(tree.text) + 2), rng.choice([0, 1, 3, 200]), "".join(rng.choices(alphabet, k=rng.choice([0, 1, 5, 300]))))
            assert tree.total == len(counter._encoding.encode_ordinary(tree.text))
            assert [s for leaf in tree.leaves for s in leaf[0]] == [len(w) for w in counter.cut.findall(tree.text)]


def test_schedule_keeps_every_source_within_a_block():
    weights = {"a": 333, "b": 1, "c": 166, "d": 250, None: 250}
    done = dict.fromkeys(weights, 0)
    for t, (s, j, release, deadline, slot) in enumerate(mixing.schedule(weights)):
        assert slot == t and release <= t < deadline and j == done[s]
        done[s] += 1
        assert all(abs(done[n] - w * (t + 1) / 1000) < 1 for n, w in weights.items())
    assert done == weights


@pytest.mark.parametrize(("name", "module", "sql"), [("op4_mixing", mixing, "OP4_SQL"), ("op6_topk", topk, "OP6_SQL")])
def test_against_sql(spark, name, module, sql):
    import pandas as pd

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want, got = con.sql(getattr(module, sql)).df(), getattr(module, name)(spark, DATA).toPandas()
    order = list(want.columns)
    pd.testing.assert_frame_equal(got[order].sort_values(order, ignore_index=True), want.sort_values(order, ignore_index=True))


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 3 <> 0"))
    got = quality.score(docs, model).join(labels.withColumnRenamed("quality", "truth"), "doc_id").where("doc_id % 3 = 0").toPandas()
    assert (got.quality_pred == got.truth).mean() > 0.95 and got.quality_score.between(0, 1).all()


def test_topk_odd_vectors(spark):
    big, nan = [3e8] * 3, float("nan")
    rows = [(0, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (2, None), (3, [1.0, None, 0.0]), (4, [nan, 0.0, 1.0]), (5, big), (6, [0.5, 0.5, 0.5]), (50, [1.0, 0.0, -1.0]), (7, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(v, v.where("vec_id % 50 = 0")).collect()}
    assert got[0, 1][0] == 5 and got[0, 2] == (1, 256 * 256 * 14) and got[50, 1][0] in (5, 6) and max(k[1] for k in got) == 4
    assert topk.top_k(v.where("false"), v.where("false")).count() == 0


def test_simhash_is_the_majority_of_the_words_hashes(spark):
    """Each layout of the counts at both ends of its range, repeated words among them."""
    norms = [" ".join([*(f"w{k}" for k in range(n)), "w0"]) for n in (1, 2, 254, 255, 256, 257, 3000)]
    rows = spark.createDataFrame([(k, k, 0, norm) for k, norm in enumerate(norms)], "rid long, doc long, pos int, norm string")
    for row in lines.simhashes(rows).collect():
        hashes = [xxhash.xxh64(word, seed=42).intdigest() for word in set(norms[row.rid].split())]
        sim = sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))
        assert row.sim % (1 << 64) == sim


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _repeated(docs):
    """Places of the lines that edit similarity alone, without SimHashes or keys, connects to an earlier one."""
    import regex

    seen = {}
    for d, t in docs:
        for p, line in enumerate(t.split("\n")):
            if n := regex.sub(r"[^\p{L}\p{N}]+", " ", line.lower()).strip(" "):
                seen.setdefault(n, []).append((d, p))
    norms = list(seen)
    parent = list(range(len(norms)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(norms):
        for j in range(i):
            most = int(max(len(a), len(norms[j])) * 0.2 + 1e-9)
            bags = collections.Counter(a), collections.Counter(norms[j])
            if max((bags[0] - bags[1]).total(), (bags[1] - bags[0]).total()) <= most and _distance(a, norms[j]) <= most:
                parent[root(i)] = root(j)
    first = {}
    for i, n in enumerate(norms):
        first[root(i)] = min(first.get(root(i), (1 << 60, 0)), min(seen[n]))
    return {o for i, n in enumerate(norms) for o in seen[n] if o != first[root(i)]}


@pytest.mark.parametrize(("words", "changes"), [((8, 15), 1), ((16, 30), 2), ((31, 80), 4)])
def test_lines_against_edit_similarity_alone(spark, words, changes):
    """No line goes that edit similarity doesn't connect to an earlier one, and at least 0.9 of those that it does go."""
    rng = random.Random(words[0])
    base = [" ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(rng.randint(*words))) for _ in range(40)]
    docs = []
    for d in range(90):
        own = []
        for _ in range(2):
            line = rng.choice(base).split()
            for _ in range(rng.randint(0, changes)):
                line[rng.randrange(len(line))] = rng.choice(["New", "word!", "x1"])
            own.append(" ".join(line))
        docs.append((d, "\n".join(own)))
    want = _repeated(docs)
    got = {r.doc_id: r for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    gone = 0
    for d, t in docs:
        left, row = t.split("\n"), got[d].text.split("\n") if got[d].n_removed < 2 else []
        kept = [p for p in range(2) if (d, p) not in want]
        assert got[d].n_lines == 2 and got[d].n_removed == 2 - len(row) and all(left[p] in row for p in kept)
        gone += got[d].n_removed
    assert gone >= 0.9 * len(want)


def test_long_lines_are_compared_by_words(spark):
    rng = random.Random(8)
    long = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(30_000)]
    near, far = list(long), list(long)
    for i in range(0, 30_000, 12):
        near[i] = "changed"
    for i in range(0, 30_000, 3):
        far[i] = f"other{i}"
    docs = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(far))]
    assert [r.n_removed for r in sorted(lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect())] == [0, 1, 0]


def test_a_group_of_near_copies_with_outliers(spark):
    """Lines that share a key, in several clusters; all but one of each cluster go, and lines like none stay."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    shared, rows = [word() for _ in range(12)], []
    for c in range(4):
        own = [word() for _ in range(10)]
        for k in range(25):
            line = shared + own
            if k:
                line[12 + k % 10] = word()
            rows.append((c * 100 + k, " ".join(line)))
    got = {r.doc_id: r.n_removed for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, n in got.items() if not n} == {0, 100, 200, 300}


def test_ogg():
    crc = 0
    for b in b"OggS test":
        crc = _crc(crc, b)
    assert ogg.checksum(b"OggS test") == crc
    rng = random.Random(2)
    for n in (0, 1, 255, 960, 65025, 65280, 300_000):
        for packet in (255, 510, 960, 70_000):
            raw = rng.randbytes(n)
            back, found = ogg.payload_of(ogg.write(raw, packet))
            assert back == raw and not found["bad"]
            for lane in found["streams"].values():
                assert [t for t, _ in lane] == np.cumsum([len(p) for _, p in lane]).tolist()
    stored = bytearray(ogg.write(rng.randbytes(300_000)))
    stored[100_000] ^= 1
    assert ogg.read(bytes(stored))["bad"] == 1


def _crc(c, b):
    c ^= b << 24
    for _ in range(8):
        c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else (c << 1) & 0xFFFFFFFF
    return c


def test_near_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").toPandas()
    counts = collections.Counter(x for t in docs.text for x in set(near.shingle_hashes(t).tolist()))
    common = {x: n for x, n in counts.items() if n * near.COMMON >= len(docs)}
    idf = near.Idf(np.array(list(common), np.uint64), np.array(list(common.values()), float), len(docs))
    sets = [near.weighted_set(t, idf) for t in docs.text]
    owners = {}
    for i, (h, _) in enumerate(sets):
        for x in h.tolist():
            owners.setdefault(x, []).append(i)
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in {(a, b) for v in owners.values() for k, a in enumerate(v) for b in v[k + 1 :]}:
        if near.similarity(sets[a], sets[b]) >= near.THRESHOLD:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    want = {int(d): int(docs.doc_id[root(i)]) for i, d in enumerate(docs.doc_id)}
    assert {r.doc_id: r.class_id for r in near.op9_near_dedup(spark, DATA).collect()} == want


def test_tiles_split_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(near, "TILE", 3)
    rng = random.Random(4)
    base = rng.choices(WORDS, k=120)
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(120)] = f"w{i}x{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    small = near.classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc", "class_id").collect()
    monkeypatch.setattr(near, "TILE", 256)
    assert sorted(small) == sorted(near.classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc", "class_id").collect())


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    got = langid.op10_language_id(spark, DATA).join(docs, "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def test_odd_rows(spark, odd):
    n = len(ODD)
    got = {r.doc_id: r for r in pieces.encode(odd, decoded="decoded").collect()}
    assert got[3].ids == [] and got[8].decoded == ODD[8][1] and got[7].decoded == ODD[7][1].replace("▁", " ")
    got = tokens.count(odd.withColumn("edits", tokens.redactions(odd.text)), edits="edits").collect()
    assert len(got) == n and {r.doc_id: r.n_tokens for r in got}[3] == 0
    assert mixing.mix(odd, mixing.root_weights(odd)).count() == n
    labels = spark.createDataFrame([(1, 1), (2, 0), (8, None)], "doc_id long, quality int")
    assert quality.score(odd, quality.fit(odd, labels)).count() == n
    got = lines.dedup(odd).collect()
    assert len(got) == n and {r.doc_id: r.text for r in got}[3] is None and [r.text for r in got if r.doc_id == 2] == ["", ""]
    assert ogg.digests(odd).count() == n and {r.doc_id: r.payload_bytes for r in ogg.digests(odd).collect()}[3] == 192
    got = near.classes(odd).collect()
    assert len(got) == n and sum(r.alone for r in got) == 3 and [r.class_id for r in got if r.doc == 2] == [2, 2]
    kept = near.dedup(odd)
    assert kept.columns == odd.columns and sorted(map(str, kept.distinct().collect())) == sorted(map(str, odd.distinct().collect())) and kept.count() == n - 1
    got = {r.doc_id: r for r in langid.predict(odd, langid.fit(odd)).collect()}
    assert len(got) == n - 1 and got[3].lang_pred == got[4].lang_pred == "und" and got[5].score == 0


def test_empty_tables(spark, odd):
    none = odd.where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (pieces.encode(none), tokens.count(none), ogg.digests(none), lines.dedup(none), near.classes(none), near.dedup(none), langid.predict(none, langid.fit(none)), quality.score(none, quality.fit(none, labels)), mixing.mix(none, mixing.root_weights(none))):
        assert df.count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        assert i == 4 or out.columns == docs.columns
        docs = out.checkpoint() if i < 4 else out
    rows = docs.collect()
    assert rows and all(r.round_trip for r in rows) and len({r.doc_id for r in rows}) == len(rows)


def test_short_lines_are_copies_too(spark):
    docs = [(1, "Menu\nfirst text that stays\n----\n\n¶ ¶"), (2, "menu!\nsecond text, another one\n ---- \n\n***"), (3, "你好\nMENU\n***"), (4, "你好。")]
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (docs[0][1], 0), 2: ("second text, another one\n\n***", 2), 3: ("你好", 2), 4: ("", 1)}


def test_pipeline_gives_each_row_its_slot_after_a_reread(spark, tmp_path):
    import corpus_pipeline

    docs = [(i, f"words of text {i}", "en", "ab"[i % 3 == 0], 9) for i in range(40)] + [(99, "twice the same", "en", "a", 9)] * 2
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    corpus_pipeline.mixed_sources(spark, docs, SMALL).repartition(7).write.parquet(f"{tmp_path}/mixed")
    rows = corpus_pipeline.sentencepiece(spark, spark.read.parquet(f"{tmp_path}/mixed"), SMALL).collect()
    want = mixing.mix(docs, mixing.root_weights(docs)).collect()
    assert sorted((r.doc_id, r.slot, r.place) for r in rows) == sorted((r.doc_id, r.slot, r.place) for r in want)
    assert len({(r.slot, r.place) for r in rows}) == len(rows) == 42
