"""Url filters, importance resampling and source divergence against brute force and DuckDB, and on odd tables."""

import collections
import math
import random
import re
import zlib
from hashlib import sha256

import duckdb
import pytest

from verdure.llm import divergence, resample, urls

SMALL = "/root/testdata/sf0.001"
PAGES = "page_id bigint, url string, html string, host string, node string, k string"
DOCS = "doc_id bigint, text string, lang string, source string, k string, word string, block string, rank string, n string"


def head(*tags):
    return f"<html><head><title>canonical <link rel=canonical href='http://no.net/'></title>{''.join(tags)}</head><body><link rel=canonical href='http://no.net/'></body></html>"


def canonical(to):
    return f'<link rel="shortlink canonical" href="{to}">'


def test_targets():
    page = head("<!-- <link rel=canonical href=http://a.com/1> -->", "<script>'<link rel=canonical href=http://a.com/2>'</script>", "<BASE href='/dir/'>", "<link href=up?x=1&amp;y=2 rel=CANONICAL>", '<meta http-equiv="Refresh" content="0; URL=\'//b.org/z\'">', "<meta http-equiv=refresh content=5>", canonical("mailto:x@y"), canonical("http://[bad"))
    assert urls.targets("http://h.net/q/w", page) == ["http://h.net/dir/up?x=1&y=2", "http://b.org/z"]
    assert urls.targets("http://h.net/", "<link rel=canonical href='" + "x" * 100_000) == []
    assert urls.targets("http://h.net/", "<!--" * 20_000 + "<link" * 20_000) == []


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "http://WWW.Example.org/es/1?a#b", None),
        (2, "http://example.org/en/12", ""),
        (3, "http://example.org/en/2", "plain"),
        (4, "http://notexample.org/es/", None),
        (5, "https://x.com/de", None),
        (6, "https://x.com/de/", head(canonical("http://alias.net/1"))),
        (7, "http://alias.net/1#top", None),
        (8, "http://alias.net/2", head(canonical("https://ALIAS.net/1"))),
        (9, "http://far.net", head('<meta http-equiv=refresh content="0;url=http://alias.net/2">')),
        (10, "http://x.com/fr/1", head(canonical("/de/never-crawled"))),
        (11, "http://free.net/1", head(canonical("http://x.com/fr/2"))),
        (12, None, head(canonical("http://x.com/de/3"))),
        (13, "no scheme/de/", head(canonical("http://x.com/de/3"))),
        (14, "a://b://c/d", None),
        (15, "http://far.net/", None),
        (15, "http://far.net/", None),
        (None, "http://example.org", None),
        (17, "http://moved.net/?q=1", None),
        (18, "http://moved.net/", None),
        (19, "http://weiß.ORG/É", None),
    ]
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES)


def brute(rows, rules, moved=()):
    def split(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(\??[^#]*)", u or "")
        return ("".join(c.lower() if c < "\x80" else c for c in m[1]), m[2], m[3]) if m else ("", "", "")

    def name(u):
        return split(u)[0] + (split(u)[1] or "/") + split(u)[2]

    def rule(host, path):
        fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        return max(fits, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "allow"), default=None)

    edges = [(name(u), name(t)) for _, u, h in rows if "://" in (u or "") for t in urls.targets(u, h or "")] + [(name(a), name(b)) for a, b in moved]
    comp = {n: n for e in edges for n in e}
    for _ in comp:
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    bad = {comp[n] for n in comp if (r := rule(re.match("[^/?]*", n)[0], re.match("[^/?]*([^?]*)", n)[1])) and r[0] == "block"}
    out = []
    for k, u, _ in rows:
        host, path, _ = split(u)
        r = rule(host, path)
        out.append((k, host, path, r and r[1] + r[2], r[0] if r else "block" if "://" in (u or "") and comp.get(name(u)) in bad else "allow"))
    return collections.Counter(out)


def test_urls(spark, pages):
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    moved = [("http://moved.net/?q=1", "http://example.org/es/"), (None, "http://moved.net/"), ("http://x", "http://x")]
    for extra in ([], moved):
        got = urls.judge(pages, urls.RULES, spark.createDataFrame(extra, "src string, dst string"))
        assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
        found = collections.Counter(map(tuple, got.collect()))
        assert found == brute(rows, urls.RULES, [m for m in extra if m[0]])
    by_id = {r[0]: r[4] for r in found}
    assert [by_id[i] for i in (6, 7, 8, 9, 10, 11, 12, 13, 15, 17, 18)] == ["block", "block", "block", "block", "allow", "allow", "allow", "allow", "block", "block", "allow"]
    assert urls.judge(pages.limit(0), urls.RULES).count() == 0


def test_many_rules_equal_few(spark, pages, monkeypatch):
    rng = random.Random(5)
    rules = [*urls.RULES, ("block", "net", "/1"), ("allow", "net", "/1"), ("block", "com", ""), *((rng.choice(["allow", "block"]), rng.choice(["org", "x.com", "alias.net", "example.org"]), "/" + "".join(rng.choices("de/fr12", k=rng.randint(0, 4)))) for _ in range(40))]
    rules = list({r[1:]: r for r in rules}.values())
    few = collections.Counter(map(tuple, urls.judge(pages, rules).collect()))
    monkeypatch.setattr(urls, "FEW_RULES", 3)
    assert collections.Counter(map(tuple, urls.judge(pages, rules).collect())) == few
    assert collections.Counter(map(tuple, urls.judge(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).collect())) == few == brute([(r.page_id, r.url, r.html) for r in pages.collect()], rules)


def odd_docs(spark):
    rng = random.Random(2)
    words = [a + b for a in "ab cé dd Éx zq x9 日本".split() for b in "ab cde f gh i jk".split()]
    rows = [(i, " ".join(rng.choices(words[: 5 + i], k=rng.choice([3, 19, 20, 60]))).title(), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d", "é", "f", None])) for i in range(60)]
    rows += [(60, None, "en", "a"), (61, "", "xx", "only"), (62, "!!  \n", "xx", "other"), (62, "!!  \n", "xx", "other"), (None, "cab cab " * 15, "en", "b"), (None, "cab cab " * 15, "en", "b"), (63, " ".join(rng.choices(words, k=20_000)), None, "a")]
    return spark.createDataFrame([(*r, *"kwbrn") for r in rows], DOCS)


@pytest.mark.parametrize(("n", "block"), [(1, 4 << 20), (3, 1), (2, 300)])
def test_resampling(spark, n, block):
    docs = odd_docs(spark)
    target = spark.createDataFrame([("Abab cab", 1), (None, 2), ("", 3), ("ddi ddi xab 7", 4)], "text string, doc_id int")
    got = resample.resample(docs, target, n=n, buckets=50, percent=37, block_bytes=block)

    def runs(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
        return w, [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % 50

    rows = [(r.doc_id, *runs(r.text)) for r in docs.collect()]
    s = collections.Counter(bucket(f) for _, _, fs in rows for f in fs)
    t = collections.Counter(bucket(f) for r in target.collect() for f in runs(r.text)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 50) / ((s[b] + 1) * (t.total() + 50)))) for b in range(50)]
    out = []
    for k, words, fs in rows:
        h = int(sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append((k, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    enough = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = collections.Counter((*r[:4], i + 1) for i, r in enumerate(enough[: 37 * len(enough) // 100]))
    undrawn = collections.Counter((*r[:4], None) for r in enough[37 * len(enough) // 100 :] + [r for r in out if r[4] < 20])
    assert collections.Counter(map(tuple, got.collect())) == drawn + undrawn and drawn


def test_resampling_of_nothing(spark):
    docs = odd_docs(spark)
    assert resample.resample(docs.limit(0), docs.select("text")).count() == 0
    assert {r.weight for r in resample.resample(docs.where("doc_id = 60"), docs.limit(0).select("text")).collect()} == {0}


def spread(docs, least, top):
    """Divergence by its definition."""
    n, df, groups = collections.Counter(), collections.Counter(), set()
    for r in docs.collect():
        lang, source = r.lang or "", r.source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in r.text or ""))
        n.update((lang, source, w) for w in found)
        df.update((lang, w) for w in set(found))
    kept = {lang: [w for (x, w), m in df.items() if x == lang and m >= least] for lang, _ in groups}
    size = {g: sum(n[*g, w] for w in kept[g[0]]) for g in groups}
    out = []

    def share(m, total, v):
        return 1 + 1_000_000_000 * (m + 2) // (total + 2 * v)

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    for lang, source in groups:
        words, v = kept[lang], len(kept[lang])
        of = {g: {w: share(n[*g, w], size[g], v) for w in words} for g in groups if g[0] == lang}
        whole = sum(size[g] for g in of)
        mine = of[lang, source]
        rows = [("pair", g[1], sum(f(mine[w], of[g][w]) for w in words)) for g in of if g[1] != source]
        every = {w: share(sum(n[*g, w] for g in of), whole, v) for w in words}
        terms = [("term", w, f(mine[w], every[w])) for w in words if n[lang, source, w] and mine[w] > every[w]]
        for part, limit in ((rows, len(rows)), (terms, top)):
            out += [(lang, source, *r, i + 1) for i, r in enumerate(sorted(part, key=lambda r: (-r[2], r[1].encode()))[:limit])]
    return collections.Counter(out)


@pytest.mark.parametrize(("heavy", "sources", "tile", "least"), [(4, 32, 2048, 10), (1, 2, 3, 2), (10_000, 2, 5, 1), (2, 3, 4, 3), (4, 32, 2048, 10_000)])
def test_divergence(spark, monkeypatch, heavy, sources, tile, least):
    for name, value in (("HEAVY", heavy), ("BLOCK_SOURCES", sources), ("TILE_TERMS", tile), ("PAIRS", 7), ("TASK_TERMS", 50)):
        monkeypatch.setattr(divergence, name, value)
    docs = odd_docs(spark)
    assert collections.Counter(map(tuple, divergence.divergence(docs, least_docs=least, top=3).collect())) == spread(docs, least, 3)
    if least == 1:
        assert divergence.divergence(docs.limit(0)).count() == 0


def test_shares_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    count, whole = 7 * 10**14 + 1, 9 * 10**14
    got = spark.range(1).select(divergence._share(F.lit(count), F.lit(whole)), divergence._share(F.lit(1), F.lit(0))).first()
    assert tuple(got) == (1 + 10**9 * (count + 2) // whole, None)


@pytest.mark.parametrize("name", ["op11_url_filters", "op12_importance_resampling", "op13_divergence"])
def test_against_sql(spark, name):
    from verdure.llm.queries import QUERIES, SQL

    got = QUERIES[name](spark, SMALL)
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(con.sql(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})").fetchall())
