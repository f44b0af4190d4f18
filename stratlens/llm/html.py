"""Main text of web pages by site style trees.

The pages of one host are merged into a style tree: a node is a path of element signatures (tag, class and id
without digits). For each node the host's pages give the distribution of its presentation (the
sequence of its children) and of its contents (its text blocks). Importance is the chance that two pages differ
there: a fixed set of wordings keeps it as a host grows, and equal pages of a host count once. A branch's composite
importance mixes the presentation of its root with the importance of what hangs below. Branches of low importance are
removed from each page, besides elements that are page furniture by their tag, role, class or id. On pages
with an article or main element only what it holds is text; there a branch goes only if nearly all pages carry the
same blocks in it while the rest of what the element holds differs.

Counts are summed before they move; a host's tree has one row per node, never one per page.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratlens.llm import shared

# Below this importance a branch is noise; hosts with fewer pages at a node say nothing about it.
IMPORTANCE, LEAST_PAGES, GAMMA = 0.35, 5, 0.9
# The same below an article or main: about 94 % of the pages carry the same block.
INSIDE = 0.1
# Rows of the table of low branches that may be broadcast, and the salts of a join with a larger one.
BROADCAST, SALTS = 50_000, 32

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.DOTALL
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|\Z)", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")

# The vocabulary of HTML and of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
FURNITURE = frozenset(
    "head nav aside footer form script style noscript template svg iframe object button select option textarea "
    "dialog menu canvas audio video map".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation "
    "menu breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices comment comments disqus respond replies "
    "share sharing social related recommended newsletter subscribe signup popup modal overlay widget toolbar pagination pager "
    "masthead skip".split()
)
HOLDERS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# A start tag of the first kind ends an open element of the second kind.
_P_ENDERS = frozenset(
    "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav "
    "ol p pre section table ul".split()
)
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
         "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
_LIMITS = frozenset("table ul ol dl body html article section div td th main".split())


@dataclass(slots=True)
class Node:
    tag: str
    path: int
    parent: int
    furniture: bool
    in_holder: bool
    children: list[int] = field(default_factory=list)


@dataclass(slots=True)
class Page:
    """Nodes by index, with their parents' indexes, and text blocks with the node that each belongs to."""

    nodes: list[Node]
    blocks: list[tuple[int, str]]


@lru_cache(maxsize=20_000)
def _attributes(tag: str, raw: str) -> tuple[str, bool, bool]:
    """Signature of an element, and whether its attributes make it furniture: anywhere, and outside an article only.

    Inside an article a class or id counts only if it is one of NAMES as a whole, as ``related-work`` there is text;
    a heading's class or id never counts.
    """
    names, low, outside = [], False, False
    for m in _ATTRIBUTE.finditer(raw) if raw else ():
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            low = True
        elif name == "role":
            low |= value in ROLES
        elif name in ("class", "id"):
            words = _WORD.findall(value)
            names.append(f"{name[0]}:{' '.join(words)}")
            if tag not in HEADINGS:
                low |= not NAMES.isdisjoint(value.split())
                outside |= not NAMES.isdisjoint(words)
    return f"{tag} {' '.join(names)}", low, outside


def parse(source: str) -> Page:
    """A forgiving reading: unclosed elements end with their parents, stray end tags are ignored."""
    root = Node("", 0, -1, False, False)
    nodes, blocks, stack = [root], [], [0]
    text: list[str] = []
    owner, at, n = 0, 0, len(source)

    def close_block() -> None:
        if text:
            words = unescape("".join(text)).split()
            if words:
                blocks.append((owner, " ".join(words)))
            text.clear()

    def close(index: int) -> None:
        if any(nodes[k].tag not in INLINE for k in stack[index:]):
            close_block()
        del stack[index:]

    while at < n:
        m = _TOKEN.search(source, at)
        end = m.start() if m else n
        if end > at:
            if not text:
                # A block belongs to the innermost element that is not inline.
                owner = next(k for k in reversed(stack) if nodes[k].tag not in INLINE)
            text.append(source[at:end])
        if not m:
            break
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            for index in range(len(stack) - 1, 0, -1):
                if nodes[stack[index]].tag == name:
                    close(index)
                    break
            continue
        if name in _P_ENDERS or name in _ENDS:
            ended = _ENDS.get(name) or {"p"}
            for index in range(len(stack) - 1, 0, -1):
                tag = nodes[stack[index]].tag
                if tag in ended:
                    close(index)
                    if name not in ("tr", "tbody", "tfoot"):
                        break
                elif tag in _LIMITS:
                    break
        if name == "br" or name == "wbr":
            text.append(" " if name == "br" else "")
            continue
        if name not in INLINE:
            close_block()
        signature, low, outside = _attributes(name, m[3])
        parent = nodes[stack[-1]]
        low |= outside and not parent.in_holder
        path = xxhash.xxh64_intdigest(signature, parent.path)
        holder = parent.in_holder or name in HOLDERS
        structural = name in ("html", "body") or name in HOLDERS
        low = parent.furniture or name in FURNITURE or (name == "header" and not parent.in_holder) or (low and not structural)
        nodes.append(Node(name, path, stack[-1], low, holder))
        parent.children.append(path)
        if name in RAW:
            end = re.compile(f"</{name}", re.IGNORECASE).search(source, at)
            at = source.find(">", end.end()) + 1 if end else n
            at = at or n
        elif name not in VOID and not m[3].endswith("/"):
            stack.append(len(nodes) - 1)
    close_block()
    return Page(nodes, blocks)


def main_text(page: Page, low: frozenset[int] = frozenset()) -> str:
    """Blocks outside furniture and outside branches whose path is in low, joined by spaces."""
    kept, held = [], []
    noise: list[bool] = []
    for node in page.nodes:
        noise.append(node.furniture or (node.parent >= 0 and noise[node.parent]) or node.path in low)
    for owner, block in page.blocks:
        if not noise[owner]:
            kept.append(block)
            if page.nodes[owner].in_holder:
                held.append(block)
    return " ".join(held or kept)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


COUNTS = "host string, path long, parent long, holder boolean, inside boolean, kind int, value long"
LOW = "host string, path long"


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct presentations (kind 0) and contents (kind 1) of each node of each page."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64()]
    names = [c.split(" ")[0] for c in COUNTS.split(", ")]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        rows: list[tuple] = []
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            page, seen = parse(source.as_py()), set()
            nodes = page.nodes
            for node in nodes[1:]:
                if not node.furniture and node.tag not in INLINE:
                    steps = [c for c, before in zip(node.children, [None, *node.children], strict=False) if c != before]
                    style = xxhash.xxh64_intdigest(b"".join(c.to_bytes(8, "little") for c in steps))
                    seen.add((node.path, nodes[node.parent].path, node.tag in HOLDERS, nodes[node.parent].in_holder, 0, style))
            for owner, block in page.blocks:
                node = nodes[owner]
                if owner and not node.furniture:
                    value = xxhash.xxh64_intdigest(block.encode())
                    seen.add((node.path, nodes[node.parent].path, node.tag in HOLDERS, nodes[node.parent].in_holder, 1, value))
            rows += [(host, _signed(a), _signed(b), c, d, e, _signed(f)) for a, b, c, d, e, f in seen]
            if len(rows) > 50_000:
                yield emit(rows)
                rows = []
        yield emit(rows)


def low_branches(tree: pd.DataFrame, threshold: float = IMPORTANCE) -> list[int]:
    """Paths of one host's tree whose composite importance is below threshold.

    tree: path, parent, holder, inside (below a holder), pages (at the node), style and content importance (content null without own text).
    Inline elements are part of their blocks and have no node.
    """
    rows = {r.path: r for r in tree.itertuples()}
    below: dict[int, list[int]] = {}
    for r in rows.values():
        below.setdefault(r.parent, []).append(r.path)
    importance: dict[int, float] = {}

    def visit(start: int) -> None:
        stack = [(start, False)]
        while stack:
            path, ready = stack.pop()
            if not ready:
                stack.append((path, True))
                stack.extend((c, False) for c in below.get(path, ()) if c not in importance and c != path)
                continue
            r = rows[path]
            children = [c for c in below.get(path, ()) if c != path and c in importance]
            weights = [rows[c].pages for c in children]
            parts = [(importance[c], w) for c, w in zip(children, weights, strict=True)]
            if not math.isnan(r.content):
                parts.append((r.content, r.pages))
            if not parts:
                importance[path] = r.style
                continue
            inner = sum(i * w for i, w in parts) / sum(w for _, w in parts)
            share = GAMMA ** len(parts)
            importance[path] = (1 - share) * r.style + share * inner

    for path in rows:
        if path not in importance:
            visit(path)

    def lowest(r) -> float:
        """What the branch has to reach: below a holder, nothing is judged where the holders themselves are alike."""
        if not r.inside:
            return threshold
        up = rows.get(r.parent)
        while up is not None and not up.holder:
            up = rows.get(up.parent)
        return INSIDE if up is not None and importance[up.path] >= threshold else 0.0

    # A branch is noise only if everything in it is: children come before their parents here.
    noise: dict[int, bool] = {}
    for path, value in importance.items():
        inside = all(noise.get(c, False) for c in below.get(path, ()) if c != path)
        noise[path] = inside and value < lowest(rows[path]) and rows[path].pages >= LEAST_PAGES and not rows[path].holder
    return [path for path, low in noise.items() if low]


def _low_of_host(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"host": pdf["host"].iloc[0], "path": low_branches(pdf)}, columns=["host", "path"]).astype({"path": "int64"})


def style_trees(pages: DataFrame) -> DataFrame:
    """host, path, parent, holder, inside, pages, style and content importance of nodes that two different pages of a host or more share."""
    distinct = pages.select("host", "html", F.md5(F.col("html").cast("binary")).alias("digest")).dropDuplicates(["host", "digest"])
    seen = distinct.select("host", "html").mapInArrow(_observe, COUNTS)
    node = ["host", "path", "parent", "holder", "inside"]
    counts = seen.groupBy(*node, "kind", "value").agg(F.count("*").cast("double").alias("n"))
    sums = counts.groupBy(*node, "kind").agg(F.sum("n").alias("total"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))
    # The chance that two values differ: 1 where each page differs, 0 where all are alike.
    differing = 1 - F.col("same") / (F.col("total") * (F.col("total") - 1))
    nodes = sums.groupBy(*node).agg(
        F.max(F.when(F.col("kind") == 0, F.col("total"))).alias("pages"),
        F.max(F.when((F.col("kind") == 0) & (F.col("total") > 1), differing)).alias("style"),
        F.max(F.when((F.col("kind") == 1) & (F.col("total") > 1), differing)).alias("content"),
    )
    return nodes.where("pages > 1")


def _sourced(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"), host.alias("host"),
    )


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for source, low in zip(batch.column("html"), batch.column("low").to_pylist(), strict=True):
            texts.append(main_text(parse(source.as_py()), frozenset(x % (1 << 64) for x in low or ())))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"]
        )


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html).

    A null or empty html gives an empty text. Pages without a host (null or odd url) share one tree. Repeated rows give
    repeated rows, and equal pages count as one page of their host; other columns are ignored; an empty table gives an empty
    result.
    """
    source = _sourced(pages)
    trees = style_trees(source)
    low = shared.cut(trees.groupBy("host").applyInPandas(_low_of_host, LOW))
    lists = low.groupBy("host").agg(F.collect_list("path").alias("low"))
    if low.count() <= BROADCAST:
        joined = source.join(F.broadcast(lists), "host", "left")
    else:
        salted = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        joined = source.withColumn("salt", salt).join(salted, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "low").mapInArrow(_extract, "page_id long, url string, text string").withColumn(
        "n_chars", F.length("text").cast("long")
    )
