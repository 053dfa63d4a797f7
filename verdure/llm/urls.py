"""Operator 11: URL filters, with decisions that follow redirects and canonical links.

A rule has a verdict, a host and a path; it fits its host and all subdomains of
it where the url's path starts with the rule's. Of the rules that fit, the
longest (characters of host and path together; then the longer host; then allow
before block) decides.

Urls that no rule fits go by their aliases. Redirects (a table of them, and
refreshes in a page's head) and canonical links are edges between urls;
connected components of these edges, found by distributed star rounds, are one
page under several names. A component with a url that a rule blocks, whether or
not that url was crawled, is blocked, all but the urls that a rule allows: an
explicit allow goes before what aliases say. Every other url is allowed.

For edges, urls are the same if they differ only in scheme, fragment, capitals
of the host, or an empty path for ``/``.

Results: one row a row of the table: key, host, path, rule, verdict. A null url,
or one without ``://``, has an empty host and path, no rule, no alias, and is
allowed. Null and empty html have no links, very long html is read up to the end
of its head, repeated rows and ties each get the same verdict, an empty table
gives an empty result, and other columns, whatever their names, are left out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdure.llm.common import checkpointed, connected_components, map_batches, texts_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
#: Rules up to which they are one expression over a row; more are joined by host and start of path.
FEW_RULES = 64
#: Production rules of the query: (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|title)\b.*?(?:</\1\s*>|\Z)|<(link|meta|base)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|(</head\b|<body\b)", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_REFRESH = re.compile(r"^[\s\d.]*[;,]?\s*url\s*=\s*['\"]?([^'\"]*)", re.I)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, its A-Z lower-cased, and the path."""
    part = [F.coalesce(F.regexp_extract(url, PARTS, i), F.lit("")) for i in (1, 2)]
    return F.translate(part[0], UPPER, LOWER), part[1]


def node(url: Column) -> Column:
    """What a url is called among edges: host, path and query; null without ``://``."""
    host, path = host_and_path(url)
    return F.when(url.contains("://"), F.concat(host, F.when(path == "", "/").otherwise(path), F.regexp_extract(url, PARTS, 3)))


def _ranked(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    return sorted(set(rules), key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "allow"))


def decided(df: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """df with the columns rule and ruled (the rule's verdict), null where no rule fits.

    rules are (verdict, host, path) rows. Up to FEW_RULES of them are an
    expression without a shuffle. Of more, each different host and path of df
    meets them in an equi-join on the host's suffixes and the path's starts of
    the lengths that rules have, so that no host's rules multiply its urls.
    """
    if isinstance(rules, DataFrame):
        few = rules.select("verdict", "host", "path").distinct().limit(FEW_RULES + 1).collect()
        if len(few) <= FEW_RULES:
            rules = [tuple(r) for r in few]
    if isinstance(rules, list) and len(rules) <= FEW_RULES:
        rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
        for verdict, h, p in reversed(_ranked(rules)):
            fits = ((F.col(host) == h) | F.col(host).endswith(f".{h}")) & F.col(path).startswith(p)
            rule, ruled = F.when(fits, h + p).otherwise(rule), F.when(fits, verdict).otherwise(ruled)
        return df.withColumns({"rule": rule, "ruled": ruled})
    if isinstance(rules, list):
        rules = df.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
    rules = rules.groupBy(F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).agg(F.min("verdict").alias("verdict"))  # allow before block
    lengths = sorted(r[0] for r in rules.select(F.length("rule_path")).distinct().collect())  # as many as the longest path has characters at most
    urls = df.select(F.col(host).alias("h"), F.col(path).alias("p")).distinct()
    labels = F.split("h", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("p")), lambda n: F.substring(F.col("p"), F.lit(1), n))
    keys = urls.select("h", "p", F.explode(tails).alias("rule_host"), starts.alias("starts")).select("h", "p", "rule_host", F.explode("starts").alias("rule_path"))
    best = F.max(F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"), F.length("rule_host").alias("m"), F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict").alias("ruled")))
    found = keys.join(rules, ["rule_host", "rule_path"]).groupBy("h", "p").agg(best.alias("best")).select("h", "p", "best.rule", "best.ruled")
    return df.join(found, (F.col(host) == F.col("h")) & (F.col(path) == F.col("p")), "left").drop("h", "p")


def targets(url: str, page: str) -> list[str]:
    """Absolute urls that a page's head names as its canonical one or refreshes to."""
    base, found = url, []
    for m in _PIECE.finditer(page):
        if m.group(4):
            break
        if not m.group(2):
            continue
        have = {k.lower(): html.unescape(a or b or c or "").strip() for k, a, b, c in reversed(_ATTRIBUTE.findall(m.group(3)))}
        tag, to = m.group(2).lower(), ""
        if tag == "base" and base is url and have.get("href"):
            base = have["href"]
        elif tag == "link" and "canonical" in have.get("rel", "").lower().split():
            to = have.get("href", "")
        elif tag == "meta" and have.get("http-equiv", "").lower() == "refresh" and (r := _REFRESH.match(have.get("content", ""))):
            to = r.group(1).strip()
        if to:
            found.append(to)
    out = []
    for to in found:
        try:
            to = urljoin(urljoin(url, base), to)
        except ValueError:  # no url
            continue
        if to.lower().startswith(("http://", "https://")):
            out.append(to)
    return out


def links(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(src, dst) urls of the canonical links and refreshes in pages; only pages that can hold one reach Python."""
    some = pages.select(F.col(url).alias("url"), F.col(page).alias("html")).where(F.col("url").contains("://") & F.col("html").rlike("(?i)canonical|refresh|&#"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(u, to) for u, t in zip(texts_of(batch, "url"), texts_of(batch, "html"), strict=True) for to in targets(u, t)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], names=["src", "dst"])

    return map_batches(some, run, "src string, dst string")


def blocked_aliases(edges: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """(node) of all urls on the edges (src, dst) that stand in a component with a url that a rule blocks."""
    members = checkpointed(connected_components(edges.select(node(F.col("src")).alias("a"), node(F.col("dst")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")))
    named = members.select("id", "comp", F.regexp_extract("id", "^[^/?]*", 0).alias("host"), F.regexp_extract("id", "^[^/?]*([^?]*)", 1).alias("path"))
    bad = decided(named, rules).where("ruled = 'block'").select("comp").distinct()
    return members.join(bad, "comp", "left_semi").select(F.col("id").alias("node")).distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, redirects: DataFrame | None = None, key: str = "page_id", url: str = "url", page: str | None = "html") -> DataFrame:
    """key, host, path, rule and verdict of every row of pages; redirects: (src, dst) urls, besides those in the pages' html."""
    edges = [] if page is None else [links(pages, url, page)]
    edges += [] if redirects is None else [redirects.select("src", "dst")]
    own = pages.select(F.col(key).alias("k"), F.col(url).alias("u"))
    host, path = host_and_path(F.col("u"))
    out = decided(own.withColumns({"host": host, "path": path}), rules)
    verdict = F.coalesce("ruled", F.lit("allow"))
    if edges:
        bad = blocked_aliases(edges[0] if len(edges) == 1 else edges[0].unionByName(edges[1]), rules)
        out = out.withColumn("own_node", node(F.col("u"))).join(bad, F.col("own_node") == F.col("node"), "left")
        verdict = F.coalesce("ruled", F.when(F.col("node").isNotNull(), "block"), F.lit("allow"))
    return out.select(F.col("k").alias(key), "host", "path", "rule", verdict.alias("verdict"))


def op11_url_filters(spark, sf_dir: str) -> DataFrame:
    """Every page's verdict."""
    from verdure.llm.common import table

    return judge(table(spark, sf_dir, "pages"), RULES)


#: Its edges are links and refreshes in plain form (quoted absolute urls); tests hold the other forms against brute force.
OP11_SQL = rf"""
WITH RECURSIVE rules(verdict, h, p) AS (VALUES {", ".join(map(str, RULES))}),
urls AS (
  SELECT page_id, url, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
tags AS (SELECT url, unnest(regexp_extract_all(regexp_extract(html, '(?is)^.*?(</head|<body|$)'), '(?i)<(?:link|meta)\b[^>]*(?:canonical|refresh)[^>]*>')) AS tag FROM urls WHERE url LIKE '%://%'),
edges AS (SELECT url AS src, unnest(regexp_extract_all(tag, 'https?://[^"''>]*')) AS dst FROM tags),
nodes AS (
  SELECT src, dst, list_transform([src, dst], lambda u: lower(regexp_extract(u, '://([^/?#]*)', 1)) || CASE WHEN regexp_extract(u, '://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(u, '://[^/?#]*([^?#]*)', 1) END
         || regexp_extract(u, '://[^/?#]*[^?#]*(\??[^#]*)', 1)) AS n FROM edges),
sides AS (SELECT n[1] AS a, n[2] AS b FROM nodes UNION SELECT n[2], n[1] FROM nodes),
fits AS (
  SELECT host, path, arg_max(r.h || r.p, length(r.h || r.p) * 1000 + length(r.h)) AS rule, arg_max(verdict, length(r.h || r.p) * 1000 + length(r.h)) AS ruled
  FROM (SELECT DISTINCT host, path FROM urls UNION SELECT regexp_extract(a, '^[^/?]*'), regexp_extract(a, '^[^/?]*([^?]*)', 1) FROM sides) u
  JOIN rules r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1, 2),
bad(node) AS (
  SELECT a FROM sides JOIN fits ON fits.host = regexp_extract(a, '^[^/?]*') AND fits.path = regexp_extract(a, '^[^/?]*([^?]*)', 1) WHERE ruled = 'block'
  UNION SELECT b FROM bad JOIN sides ON a = node)
SELECT page_id, u.host, u.path, rule,
       coalesce(ruled, CASE WHEN u.host || CASE WHEN u.path = '' THEN '/' ELSE u.path END || regexp_extract(url, '://[^/?#]*[^?#]*(\??[^#]*)', 1) IN (SELECT node FROM bad) THEN 'block' END, 'allow') AS verdict
FROM urls u LEFT JOIN fits f ON u.host = f.host AND u.path = f.path
"""
