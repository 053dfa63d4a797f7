"""Main text of odd and broken pages, every piece of the public model, and mixing of many sources."""

import importlib
import math
import re
import time

import duckdb
import numpy as np
import pytest

html, mixing, pieces = (importlib.import_module(f"verdure.llm.{m}") for m in ("html", "mixing", "pieces"))
TEXT = "Some long text that is the content of this page, with many words in it. " * 5


def test_every_piece_equals_the_library():
    import sentencepiece

    p, sp = pieces.Pieces.load(pieces.DEFAULT_MODEL), sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    names = [n.replace(pieces.SPACE, " ") for n, size in zip(p.names, p.size.tolist(), strict=True) if size]
    names = [n for n in names if not re.fullmatch(r"<0x..>|<.*>", n)]
    texts = [t for n in names for t in (n, n + n, f"a{n}", f"{n} b", f"x {n} y")]
    got = [np.frombuffer(x, np.int32).tolist() for x in p.encode(texts, pieces.Cache())]
    assert got == sp.encode(texts)
    assert [p.decode(x) for x in got] == texts


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<body><div class="content no-sidebar"><p>{TEXT}</p></div></body>', TEXT),
        (f'<body><div class="social-science-article"><p>{TEXT}</p></div></body>', TEXT),
        (f'<body><div id="side-by-side"><p>{TEXT}</p></div></body>', TEXT),
        (f'<body><article><div class="article-header"><h1>Title</h1></div><p>{TEXT}</p></article></body>', f"Title\n{TEXT}"),
        (f'<body><article><p>{TEXT}</p><section id="responses"><p>I agree with all that.</p></section></article></body>', TEXT),
        (f'<body><article><p>{TEXT}</p><div style="DISPLAY:NONE"><p>hidden</p></div></article></body>', TEXT),
        (f'<body><div class="widget"><p>{TEXT}</p></div></body>', TEXT),
        (f'<body><div class="ad"><p>{TEXT}</p></div><p>Short.</p></body>', "Short."),
        (f"<body><article data-class='ad' title='a > b'><p>{TEXT}</p></article><p class=x", TEXT),
    ],
)
def test_what_is_content(page, want):
    assert html.main_text(page) == want.strip()


@pytest.mark.parametrize("page", ["<a " * 340_000, "<a '" * 250_000, "<div>" * 90_000 + "</i>" * 120_000, "<div>" * 50_000 + "<td></td>" * 50_000, "<i>" * 100_000 + "<div></div>" * 50_000, '<a b=">' * 150_000, "<a " + "= " * 400_000 + ">"])
def test_broken_pages_take_linear_time(page):
    began = time.perf_counter()
    html.main_text(page)
    assert time.perf_counter() - began < 5  # about half a second here


def _brute(page):
    """Densities by definition, each from a walk of its own; the chosen subtrees' blocks."""
    root = html.parse(page)

    def kids(n):
        return [c for c in n.children if not isinstance(c, str) and not bare(c)]

    def bare(n):
        return n.bare or n.tag == "header"

    def chars(n):
        return sum(len("".join(c.split())) for c in n.children if isinstance(c, str)) + sum(map(chars, kids(n)))

    def tags(n):
        return sum(1 + tags(c) for c in kids(n))

    def link_chars(n):
        return chars(n) if n.tag == "a" else sum(map(link_chars, kids(n)))

    def link_tags(n):
        return (n.tag == "a") + sum(map(link_tags, kids(n)))

    def walk(n):
        yield n
        for c in kids(n):
            yield from walk(c)

    body = next(n for n in walk(root) if n.tag == "body")
    share = link_chars(body) / chars(body) if chars(body) else 0

    def density(n):
        c, t, lc, lt = chars(n), tags(n) or 1, link_chars(n), link_tags(n)
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        return c / t * max(0.0, math.log(c / (lc or 1) * t / (lt or 1)) / base)

    return body, walk, density, chars, kids


def test_text_is_that_of_the_densest_subtree():
    """On all pages: the part with the greatest sum of its children's densities, by definition, is in the text, and adverts aren't."""
    pages = [r[0] for r in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall() if r[0]]
    checked = 0
    for page in pages:
        if "<body" not in page:
            continue
        body, walk, density, chars, kids = _brute(page)
        nodes = [n for n in walk(body) if chars(n) and n.tag not in html.INLINE_FORMAT and n.tag != "p"]
        if not nodes:
            continue
        core = max(nodes, key=lambda n: sum(map(density, kids(n))))
        got = html.main_text(page)
        own = ["".join(c.split()) for n in walk(core) for c in n.children if isinstance(c, str)]
        assert all(piece in "".join(got.split()) for piece in own)
        advert = re.search(r'<div class="?ad"?>(.*?)</div>', page, re.S)
        if advert and len(advert[1]) > 20 and "<" not in advert[1] and page.count(advert[1]) == 1:
            assert " ".join(advert[1].split()) not in got.split("\n")
        checked += 1
    assert checked > 100


def test_pages_in_spark(spark):
    rows = [(1, "u", None, "a"), (2, "u", "", "b"), (2, "u", "", "b"), (3, None, f"<p>{TEXT}</p>", None), (None, "x", "<p>caf&eacute;  &#x263A;\n</p>", "c"), (5, "y", f"<div>{'word ' * 300_000}</div>", "d")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = html.extract(pages).collect()
    assert len(got) == 6 and {r.page_id: r.text for r in got if r.page_id != 2} == {1: "", 3: TEXT.strip(), None: "café ☺", 5: ("word " * 300_000).strip()}
    assert html.extract(pages.where("false")).collect() == []


@pytest.mark.parametrize(("large", "small"), [(400, 600), (1, 3000), (0, 1), (20, 0)])
def test_weights_of_many_sources(spark, large, small):
    rows = [(f"l{i}",) for i in range(large) for _ in range(40)] + [(f"s{i}",) for i in range(small)]
    got = mixing.root_weights(spark.createDataFrame(rows, "source string"))
    assert len(got) == large + small and min(got.values()) >= 1 and sum(got.values()) == max(mixing.PERIOD, mixing.TICKS * len(got))
    assert len(mixing.schedule(got)) == sum(got.values())
    if large and small:
        assert got["l0"] >= got["s0"]


def test_mixing_odd_tables(spark):
    assert mixing.root_weights(spark.createDataFrame([], "source string")) == {}
    rows = [(1, None, "t", 5), (1, None, "t", 5), (None, "a", None, 6), (2, "a", "", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, slot bigint")
    got = mixing.mix(docs, mixing.root_weights(docs)).collect()
    assert len(got) == 4 and len({(r.slot, r.place) for r in got}) == 4
