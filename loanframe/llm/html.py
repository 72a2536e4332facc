"""Main text of web pages by nearest-URL page differencing (operator 4).

1. Every page is cut into lines (blocks of text) with what its markup says:
   ``MAIN`` inside an article (or main) element, ``CHROME`` inside menus,
   headers, footers, sidebars, notices, adverts, forms or comments, ``PLAIN``
   otherwise.  Scripts, styles and markup leave no lines.
2. Pages of one host are ordered by URL path and each is paired with its
   nearest neighbours; equal pages count once.  Their lines are aligned by
   longest common subsequence.  A plain line that the nearest page shares is
   template and is deleted.  On a page of several article elements (teasers, promoted stories)
   one that the nearest page shares whole is template, if another has lines of its own.  A neighbour with nearly the same text is a copy and says
   nothing about the template: then the other neighbour counts.
3. The text is the main lines; a page without a main element keeps its plain
   lines that are not shared.  Of an article that has lines of its own no line is
   deleted: articles quote one another.

Hosts of any size: pages are dealt by range of (host, path), so neighbours are
found inside equal ranges and, for their ends, in a table of one row a range.
Only hashes of lines are shuffled for the pairing.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loanframe.llm.common import map_batches, stored

CHROME, PLAIN, MAIN = 0, 1, 2
#: A neighbour that shares more than this part of a page's plain text is a copy of it.
COPY = 0.8

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)/?>", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
NAME = re.compile(r"[a-z0-9]+")

#: Elements whose content is no text.
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "textarea"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that belong to a line; all others end one.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "img", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong",
          "sub", "sup", "time", "tt", "u", "var", "wbr"}
AWAY = {"head", "title", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "fieldset"}
AWAY_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu",
              "menubar", "toolbar", "form", "note", "status"}
#: Words in class or id that mark what isn't main text.
AWAY_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs",
    "comment", "comments", "consent", "cookie", "cookies", "disclaimer", "disqus", "footer", "gdpr", "masthead", "menu",
    "menus", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo",
    "promotion", "related", "recommended", "replies", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor",
    "sponsored", "subscribe", "subscription", "toolbar", "widget", "alert", "header", "login", "search", "reader"}
#: Such a word says that the element is around the page and only names what else is in it.
WRAPPERS = {"with", "no", "has", "without", "wrapper", "container", "layout"}
HEAD = {"title", "meta", "link", "base"}
#: Elements that an opening tag of the same group closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(raw)} if "=" in raw else {}


def _zone(tag: str, raw: str, zone: int, in_article: int) -> int:
    """Zone of an element from its tag and attributes, inside ``zone``."""
    if tag in ("html", "body"):
        return zone
    if zone == CHROME or tag in AWAY or (tag == "header" and not in_article):
        return CHROME
    attrs = _attributes(raw)
    role = attrs.get("role", "").lower()
    if "hidden" in raw.lower().split() or attrs.get("aria-hidden") == "true" or role in AWAY_ROLES:
        return CHROME
    words = set(NAME.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()))
    if in_article:
        words.discard("header")
    if words & AWAY_WORDS and not words & WRAPPERS:
        return CHROME
    return MAIN if tag in ("article", "main") or role in ("main", "article") else zone


def lines_of(page: str | None) -> list[tuple[int, int, str]]:
    """(zone, article, text) of every line of a page, in order.  ``article``: the number of the outermost article element
    that the line is in, from 1; 0 outside.

    Unclosed and wrongly nested elements are mended as browsers do: a closing
    tag closes everything inside its element, one without an element is
    ignored, a paragraph ends where a block begins, a list item where the next
    one does.  A line break inside a paragraph is white space.
    """
    out: list[tuple[int, int, str]] = []
    if not page:
        return out
    stack: list[tuple[str, int, int]] = []              # open elements with the zone and the article inside them
    articles = 0
    buffer: list[str] = []
    at = 0

    def inside() -> tuple[int, int]:
        return stack[-1][1:] if stack else (PLAIN, 0)

    def flush():
        text = " ".join(entities.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            out.append((*inside(), text))

    while m := TOKEN.search(page, at):
        if m.start() > at:
            buffer.append(page[at:m.start()])
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        opening, alone = not m.group(1), tag in VOID or m.group(0).endswith("/>")
        if tag in RAW:
            if opening and not alone:
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif tag == "br":
            buffer.append(" ")
        elif not opening:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is None or tag in INLINE and any(x[0] not in INLINE for x in stack[depth:]):
                continue
            if tag not in INLINE or (stack[depth - 1][1:] if depth else (PLAIN, 0)) != inside():
                flush()
            del stack[depth:]
        elif tag in INLINE:
            if not alone:
                zone, article = inside()
                new = _zone(tag, m.group(3), zone, article) if m.group(3) else zone
                if new != zone:
                    flush()
                stack.append((tag, new, article))
        else:
            flush()
            if tag == "body":
                del stack[:]
            ends = CLOSES.get(tag, set()) | {"p"}
            low = None
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    low = i
                elif stack[i][0] not in INLINE:
                    break
            if low is not None:
                del stack[low:]
            if stack and stack[-1][0] == "head" and tag not in HEAD:
                stack.pop()
            if not alone:
                zone, article = inside()
                new = _zone(tag, m.group(3), zone, article)
                if tag == "article" and not article:
                    articles += 1
                    article = articles
                stack.append((tag, new, article))
    buffer.append(page[at:])
    flush()
    return out


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of two lists (Hunt and Szymanski)."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    where: dict[int, list[int]] = {}
    for j in range(len(b) - tail - 1, head - 1, -1):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i in range(head, len(a) - tail):
        for j in where.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k] = j
                links[k] = link
    middle, link = [], links[-1] if links else None
    while link is not None:
        middle.append(link[0])
        link = link[1]
    return [*range(head), *reversed(middle), *range(len(a) - tail, len(a))]


def _kept(lines: list[tuple[int, int, str]]) -> list[tuple[int, str]]:
    """(zone, text) with one zone MAIN: that of article elements, else of main elements."""
    best = any(z == MAIN and art for z, art, _ in lines)
    return [(z if z != MAIN or art or not best else PLAIN, t) for z, art, t in lines]


def _judged(lines: list[tuple[int, int, str]]) -> list[int]:
    """What differencing judges: 0 for a plain line of a page without a main element, the article's number for its lines
    on a page of several articles, -1 for other lines."""
    kept = _kept(lines)
    if not any(z == MAIN for z, _ in kept):
        return [0 if z == PLAIN else -1 for z, _ in kept]
    several = len({art for (_, art, _), (z, _) in zip(lines, kept) if z == MAIN and art}) > 1
    return [art if several and z == MAIN else -1 for (_, art, _), (z, _) in zip(lines, kept)]


def _template(judged: list[int], shared: list[int]) -> list[int]:
    """Of the judged lines that a page shares with its neighbour, those that are template: plain ones, and articles all
    of whose lines are shared, if another article has lines of its own."""
    hit, articles = set(shared), {a for a in judged if a > 0}
    whole = articles - {a for i, a in enumerate(judged) if i not in hit}
    return [i for i in shared if judged[i] == 0 or judged[i] in whole and whole != articles]


def _site(url: Column) -> tuple[Column, Column]:
    """Host (lower case, without ``www.``) and path of a URL; both empty where there is none."""
    u = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(u, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", "")


def _neighbours(pages: DataFrame) -> DataFrame:
    """(key, near, far): each page's neighbours by (path, key) in its host, the nearer by edit distance first."""
    spark = pages.sparkSession
    ranged = stored(pages.select("host", "path", "key").repartitionByRange("host", "path", "key")
                    .withColumn("part", F.spark_partition_id()), "html-order")
    me = F.struct("host", "path", "key")
    w = W.partitionBy("part").orderBy("host", "path", "key")
    ends = ranged.groupBy("part").agg(F.min(me).alias("first"), F.max(me).alias("last")).orderBy("part").collect()
    edges = [(r["part"], ends[i - 1]["last"] if i else None, ends[i + 1]["first"] if i + 1 < len(ends) else None)
             for i, r in enumerate(ends)]                                           # one row a partition
    kind = "struct<host:string,path:string,key:long>"
    small = spark.createDataFrame(edges, f"part int, before {kind}, after {kind}")
    n = ranged.select("part", "host", "path", "key", F.lag(me).over(w).alias("p"), F.lead(me).over(w).alias("q"))
    n = n.join(F.broadcast(small), "part")
    p, q = F.coalesce("p", "before"), F.coalesce("q", "after")
    n = n.select("key", "host", "path", F.when(p["host"] == F.col("host"), p).alias("p"),
                 F.when(q["host"] == F.col("host"), q).alias("q"))
    first = F.col("q").isNull() | (F.col("p").isNotNull()
                                   & (F.levenshtein("path", F.col("p.path")) <= F.levenshtein("path", F.col("q.path"))))
    return n.select("key", F.when(first, F.col("p.key")).otherwise(F.col("q.key")).alias("near"),
                    F.when(first, F.col("q.key")).otherwise(F.col("p.key")).alias("far"))


def shared_lines(pages: DataFrame) -> DataFrame:
    """(key, gone): line numbers that a page shares with its nearest page, for pages that have any.

    ``pages``: (host, path, key, lines, sizes, judged), lines as hashes.
    """
    n = _neighbours(pages).where("near IS NOT NULL")
    a = pages.select("key", "lines", "sizes", "judged")
    other = pages.select(F.col("key").alias("k"), F.col("lines").alias("l"))
    # lines go out to the pages that need them, by key: one row for each neighbour
    t = (n.join(a, "key").join(other.withColumnsRenamed({"k": "near", "l": "l1"}), "near")
         .join(other.withColumnsRenamed({"k": "far", "l": "l2"}), "far", "left")
         .select("key", "lines", "sizes", "judged", "l1", "l2"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keys, gone = [], []
        for key, lines, sizes, judged, *others in zip(*(c.to_pylist() for c in b.columns), strict=True):
            open_ = {i for i, a in enumerate(judged) if a >= 0}
            whole = sum(sizes[i] for i in open_)
            for near in others:
                hit = [i for i in common_lines(lines, near) if i in open_] if near else []
                if hit and sum(sizes[i] for i in hit) <= COPY * whole:
                    if away := _template(judged, hit):
                        keys.append(key)
                        gone.append(away)
                    break
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(gone, pa.list_(pa.int32()))],
                                          names=["key", "gone"])

    return map_batches(t, run, "key long, gone array<int>")


def _key(host: str, lines: list[tuple[int, str]], judged: list[int]) -> int:
    return xxhash.xxh64_intdigest("\x00".join([host, *(f"{z}{a}:{t}" for (z, t), a in zip(lines, judged, strict=True))]).encode("utf-8", "replace")) - (1 << 63)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every row of ``pages``: its main lines, joined by blank lines.

    White space inside a line is one space, character references are decoded;
    nothing is dropped but what the zones and the differencing say.  NULL or
    empty html gives the empty text; pages without a URL share one empty host;
    equal and repeated pages are answered alike; other columns are ignored; an
    empty table gives an empty result.
    """
    host, path = _site(F.col(url_col))
    src = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"),
                       host.alias("host"), path.alias("path"))

    def hashed(b: pa.RecordBatch) -> pa.RecordBatch:
        cols = {k: [] for k in ("key", "lines", "sizes", "judged")}
        for host_, page in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            found_ = lines_of(page)
            lines, judged = _kept(found_), _judged(found_)
            cols["key"].append(_key(host_, lines, judged))
            cols["lines"].append([xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) - (1 << 63) for _, t in lines])
            cols["sizes"].append([len(t) for _, t in lines])
            cols["judged"].append(judged)
        return pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(cols["key"], pa.int64()), pa.array(cols["lines"], pa.list_(pa.int64())),
             pa.array(cols["sizes"], pa.list_(pa.int32())), pa.array(cols["judged"], pa.list_(pa.int32()))],
            names=["host", "path", "key", "lines", "sizes", "judged"])

    found = map_batches(src.select("host", "path", "_html"), hashed,
                        "host string, path string, key long, lines array<long>, sizes array<int>, judged array<int>")
    once = stored(found.groupBy("key").agg(F.min("host").alias("host"), F.min("path").alias("path"), F.first("lines").alias(
        "lines"), F.first("sizes").alias("sizes"), F.first("judged").alias("judged")), "html-lines")
    gone = stored(shared_lines(once), "html-gone")     # its size tells Spark how to join it

    def texts(b: pa.RecordBatch) -> pa.RecordBatch:
        keys, kept, at = [], [], []
        for host_, page in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            found_ = lines_of(page)
            lines = _kept(found_)
            zone = MAIN if any(z == MAIN for z, _ in lines) else PLAIN
            keys.append(_key(host_, lines, _judged(found_)))
            kept.append([t for z, t in lines if z == zone])
            at.append([i for i, (z, _) in enumerate(lines) if z == zone])
        return pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(keys, pa.int64()), pa.array(kept, pa.list_(pa.string())),
             pa.array(at, pa.list_(pa.int32()))], names=["_id", "_url", "key", "kept", "at"])

    kind = src.schema["_id"].dataType.simpleString()
    t = map_batches(src.select("_id", "_url", "host", "_html"), texts,
                    f"_id {kind}, _url string, key long, kept array<string>, at array<int>")
    t = t.join(gone, "key", "left")
    left = F.filter("kept", lambda x, i: ~F.array_contains("gone", F.get("at", i)))
    text = F.array_join(F.when(F.col("gone").isNull(), F.col("kept")).otherwise(left), "\n\n")
    return t.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), text.alias("text"))


def report(pages: DataFrame) -> DataFrame:
    return main_text(pages).withColumn("n_chars", F.length("text").cast("long"))
