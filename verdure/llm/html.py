"""Operator 2: main text of web pages by composite text density.

A page's tags are read into a tree; script, style and the like have no text.
Each node has its characters C, tags T, and those inside links, LC and LT; its
composite density is

    C / T * log(C / LC * T / LT, base ln(C / notLC * LC + LC_body / C_body * C + e))

so that text thick in links weighs little. The subtree whose children's
densities have the greatest sum is the main content's core; the least density
on the path from there to body is the threshold that other subtrees of the
content's parent need. Navigation, headers, footers, asides, forms, adverts,
notices and comments take no part, wherever they stand: by tag, role or hidden
style, or because a whole class or id consists of words for them and the node
holds no more than half of the text (adverts: however much).

Results: one row a page. Null or empty html, or a page without content, gives
the empty text. Unclosed tags end where an enclosing tag or the page ends; a
cut-off page is read as far as it goes.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from verdure.llm.common import map_batches

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<", re.S)
#: What ends a tag, or begins a quoted value in it.
STOP = re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template noembed noframes".split())
RAW_END = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
INLINE_FORMAT = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: A tag that ends an open one of the same family.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "thead": {"tbody"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}, "option": {"select"}}
# What is never main content, by tag, role, and words of class or id.
NO_CONTENT_TAGS = frozenset("nav aside footer form button select input textarea script style noscript iframe template svg canvas object embed applet head title dialog menu label fieldset".split())
NO_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
NO_CONTENT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar comment comments disqus reply replies respond response responses discussion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login share sharing social related recommended pagination pager toolbar widget widgets copyright disclaimer".split()
)
#: What these name is no content, however much of the text it holds.
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored cookie cookies consent gdpr".split())
#: Words that may stand beside these in a class or id without changing what it says.
BESIDE_WORDS = frozenset("site page main top bottom left right block box area section container wrapper wrap list item bar inner outer global primary secondary user reader post and the".split())
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("bare", "children", "links", "named", "parent", "size", "tag", "tags", "text_links")

    def __init__(self, tag: str, parent: Node | None, bare: bool, named: bool):
        """bare: takes no part; named: only because of its class or id."""
        self.tag, self.parent, self.bare, self.named, self.children = tag, parent, bare, named, []
        self.size = self.tags = self.links = self.text_links = 0


def _names_no_content(value: str) -> tuple[bool, bool]:
    """Whether a class or id consists, in one of its names, of words for what is no content; and whether these may err."""
    for name in value.split():
        words = {w.lower() for w in PART.findall(name)}
        if words & NO_CONTENT_WORDS and words <= NO_CONTENT_WORDS | BESIDE_WORDS:
            return True, not words & ADVERT_WORDS
    return False, False


def _no_content(tag: str, attributes: str) -> tuple[bool, bool]:
    """Node's bare and named."""
    if tag in NO_CONTENT_TAGS:
        return True, False
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, False
    bare = named = False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True, False
        if name == "role" and value.lower() in NO_CONTENT_ROLES:
            return True, False
        if name in ("class", "id") and not bare:
            bare, named = _names_no_content(value)
    return bare, named


class _Path:
    """The open elements, and where those of each tag, blocks, and elements that aren't inline stand among them.

    Every element is opened and closed once and looked up without a walk, so
    that broken pages take time in proportion to their length.
    """

    def __init__(self, root: Node):
        self.nodes, self.at, self.blocks, self.solid = [root], defaultdict(list), [], [0]

    def open(self, node: Node) -> None:
        k = len(self.nodes)
        self.nodes.append(node)
        self.at[node.tag].append(k)
        if node.tag in BLOCK:
            self.blocks.append(k)
        if node.tag not in INLINE_FORMAT and node.tag != "span":
            self.solid.append(k)

    def close(self, k: int) -> None:
        """Closes the k-th element and all in it."""
        while len(self.nodes) > k:
            self.at[self.nodes.pop().tag].pop()
        for places in (self.blocks, self.solid):
            while places and places[-1] >= k:
                places.pop()

    def last(self, tags) -> int:
        """Where the innermost open element of these tags stands; 0: none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)


def parse(page: str) -> Node:
    """The page's tree; text leaves are strings, character references decoded. An unfinished tag at the end is no text."""
    root = Node("#root", None, False, False)
    path, at, end = _Path(root), 0, len(page)
    last_end, last_quote = page.rfind(">"), {q: page.rfind(q) for q in "\"'"}
    while at < end:
        node = path.nodes[-1]
        if page[at] != "<":
            stop = page.find("<", at)
            stop = end if stop < 0 else stop
            node.children.append(html.unescape(page[at:stop]))
            at = stop
            continue
        m = NAME.match(page, at)
        if m is None:
            piece = OTHER.match(page, at)[0]
            at += len(piece)
            if piece == "<":
                node.children.append("<")
            elif piece.startswith("<![CDATA["):
                node.children.append(piece[9:].removesuffix("]]>"))
            continue
        begin = stop = m.end()
        while stop <= last_end:
            found = STOP.search(page, stop)
            if found is None or found[1] is None:
                break
            stop = found.end()
            if stop <= last_quote[found[1]]:  # else the quote is never closed and counts as any sign
                stop = page.find(found[1], stop) + 1
        if stop > last_end or found is None:
            break
        tag, attributes, at = m[1].lower(), page[begin : found.start()], found.end()
        if page[m.start() + 1] == "/":
            k = path.last((tag,))
            if k and not (tag in INLINE_FORMAT and path.blocks and path.blocks[-1] > k):
                path.close(k)
            continue
        if tag in ENDS_P and path.nodes[path.solid[-1]].tag == "p":
            path.close(path.solid[-1])
        if tag in SIBLINGS:
            while (k := path.last(SIBLINGS[tag])) > path.last(SCOPE[tag]):
                path.close(k)
        child = Node(tag, path.nodes[-1], *_no_content(tag, attributes))
        child.parent.children.append(child)
        if tag in RAW:
            close = RAW_END[tag].search(page, at)
            stop = close.start() if close else end
            if tag in ("textarea", "title"):
                child.children.append(html.unescape(page[at:stop]))
            at = page.find(">", stop) + 1 if close else end
            at = at or end
        elif tag not in VOID and not attributes.endswith("/"):
            path.open(child)
    return root


def _nodes(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(c for c in reversed(n.children) if isinstance(c, Node))
    return out


def main_text(page: str | None) -> str:
    """The page's main content: its blocks in order, one to a line."""
    if not page:
        return ""
    root = parse(page)
    nodes = _nodes(root)
    # a header, unless it is inside an article and so the article's own title
    inside = {id(None): False}
    for n in nodes:
        inside[id(n)] = inside[id(n.parent)] or n.tag in ("article", "main")
        if inside[id(n)] and n.tag == "header":
            n.bare = n.named = False
        elif n.tag == "header":
            n.bare, n.named = True, False
    # what a class or id calls no content, unless it holds most of the text
    for n in reversed(nodes):
        n.size += sum(len("".join(c.split())) for c in n.children if isinstance(c, str))
        if n.parent is not None and (n.named or not n.bare):
            n.parent.size += n.size
    for n in nodes:
        if n.named and 2 * n.size > root.size:
            n.bare = False
        if n.parent is not None and n.parent.bare:
            n.bare = True
    for n in nodes:
        n.size = 0
    for n in reversed(nodes):
        if n.bare:
            continue
        for c in n.children:
            if isinstance(c, str):
                n.size += len("".join(c.split()))
            elif not c.bare:
                n.size, n.tags = n.size + c.size, n.tags + c.tags + 1
                n.text_links, n.links = n.text_links + c.text_links, n.links + c.links
        if n.tag == "a":
            n.text_links, n.links = n.size, n.links + 1
    body = next((n for n in nodes if n.tag == "body" and not n.bare), root)
    if not body.size:
        return ""
    ratio = body.text_links / body.size

    def density(n: Node) -> float:
        if n.bare or not n.size:
            return 0.0
        tags = n.tags or 1
        plain = max(n.size - n.text_links, 1)
        base = math.log(n.size / plain * n.text_links + ratio * n.size + math.e)
        return n.size / tags * max(0.0, math.log(n.size / (n.text_links or 1) * tags / (n.links or 1)) / base)

    dense = {id(n): density(n) for n in nodes}

    def inner(n: Node) -> float:
        loose = sum(len(c) for c in n.children if isinstance(c, str))
        return sum(dense[id(c)] for c in n.children if isinstance(c, Node)) + (loose if n.tag not in BLOCK else 0)

    blocks = [n for n in _nodes(body) if not n.bare and n.size and n.tag not in INLINE_FORMAT and n.tag != "p"]
    core = max(blocks, key=inner, default=body)
    # the whole article or main part that holds the core, if there is one
    up = core
    while up is not None and up is not body:
        if up.tag in ("article", "main"):
            core = up
        up = up.parent
    threshold, up = dense[id(core)], core
    while up is not body and up.parent is not None:
        up = up.parent
        threshold = min(threshold, dense[id(up)])
    chosen = {id(core)}
    if core.tag not in ("article", "main") and core.parent is not None:
        for c in core.parent.children:
            if isinstance(c, Node) and not c.bare and c.size and dense[id(c)] >= threshold:
                chosen.add(id(c))
    for n in nodes:
        if n.tag in ("article", "main") and not n.bare and dense[id(n)] >= threshold:
            chosen.add(id(n))
    return "\n".join(_blocks(body if body in nodes else root, chosen))


def _blocks(root: Node, chosen: set[int]) -> Iterator[str]:
    parts: list[str] = []
    # (node or text, inside chosen); None ends a block
    stack: list[tuple[Node | str | None, bool]] = [(root, id(root) in chosen)]
    while stack:
        item, inside = stack.pop()
        if isinstance(item, Node) and item.tag == "br":
            parts.append(" ")
        elif item is None or isinstance(item, Node) and item.tag in BLOCK:
            if text := " ".join("".join(parts).split()):
                yield text
            parts = []
        if isinstance(item, str):
            if inside:
                parts.append(item)
        elif item is not None and not item.bare:
            if item.tag in BLOCK:
                stack.append((None, inside))
            stack.extend((c, inside or isinstance(c, Node) and id(c) in chosen) for c in reversed(item.children))
    if text := " ".join("".join(parts).split()):
        yield text


def extract(df: DataFrame, html_column: str = "html", to: str = "text") -> DataFrame:
    """df without its html, with string column ``to``: the page's main text. No shuffle; a task holds one batch."""
    rest = df.drop(to)
    fields = [f for f in rest.schema.fields if f.name != html_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(html_column)
            texts = pa.array([main_text(p) for p in batch.column(at).to_pylist()], pa.string())
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), texts], names=[*(batch.schema.names[i] for i in kept), to])

    return map_batches(rest, run, T.StructType([*fields, T.StructField(to, T.StringType())]))


def op2_html(spark, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    from pyspark.sql import functions as F

    from verdure.llm.common import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
