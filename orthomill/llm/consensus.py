"""Main text of web pages by consensus host paths.

Every page's containers are scored by the text they hold; the scores are votes for the container's
generalised tag-class path, summed per host in Spark. Pages are then read again and the text is taken from
the containers on their host's winning path. A path is named by a digest of its parent's digest and its own step, so deep pages
stay small. The project has no page records, so the interface is general.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthomill.llm.tables import stored

_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+|[^>]*+)(?:>|$)", re.S)
_ATTR = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_RAW = frozenset("script style noscript template textarea iframe svg math object canvas select title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP = frozenset("head nav aside footer form button dialog menu datalist fieldset audio video map".split()) | _RAW
_BLOCK = frozenset(
    "html body main article section div header hgroup p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote address figure figcaption table caption "
    "thead tbody tfoot tr td th details summary center".split()) | _DROP
_TEXT_CONTAINERS = frozenset("html body main article section div header td th blockquote li dd center details figure".split())
#: What an opening tag closes by itself, up to the given ancestors.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_NOISE = frozenset(
    "nav navbar navigation menu menus sidebar aside footer masthead ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup share sharing social comment "
    "comments reply replies respond disqus discussion related recommended breadcrumb breadcrumbs pagination pager toolbar widget widgets login search skip "
    "hidden".split())
_REMARKS = frozenset("comment comments reply replies respond disqus discussion".split())
_MAIN = ("article", "main", "section")
_CORE = frozenset("content main article post entry story body text page".split())
_SHUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())


@dataclass(slots=True)
class _Node:
    """``path``: digest of a block's path; ``box``: the nearest element at or above that can hold text blocks."""
    parent: int
    name: str
    path: str
    dropped: bool
    block: bool
    box: int


@dataclass
class Page:
    """Elements in page order, and blocks of text: (innermost block element, text, characters within links)."""
    nodes: list[_Node] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def _noise(name: str, attrs: dict[str, str], inside_core: bool) -> bool:
    """Whether an element is a menu, advert, notice, comment or the like."""
    if name in _DROP or (name == "header" and not inside_core):
        return True
    if not attrs or name in ("html", "body"):
        return False
    if attrs.get("role", "").lower() in _SHUT_ROLES or attrs.get("aria-hidden") == "true" or "hidden" in attrs:
        return True
    if re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    tokens = {t.lower() for t in _TOKEN.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}")}
    if tokens & _REMARKS and not tokens & {"with", "has", "no"}:
        return True
    if name in ("article", "main") or tokens & {"with", "has", "no"}:
        return False
    if tokens & {"header"} and not inside_core and not tokens & _CORE:
        return True
    return bool(tokens & _NOISE) and not (tokens & {"content", "article", "main", "story"} and not tokens & {"ad", "ads", "advert", "related", "sidebar"})


def parse(html: str) -> Page:
    """Read a page, however broken, in one pass; unclosed elements end with their parent or the page.

    Time and memory follow the page's length, however deep it is: ``depths`` knows where each open name stands.
    """
    page, stack, pieces, linked = Page([_Node(-1, "", "", False, True, 0)]), [0], [], 0
    # Open blocks, their places in the stack, and the places of all open elements by name.
    nodes, tops, floors, depths = page.nodes, [0], [0], {}

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            pieces.clear()
            if text and not nodes[stack[-1]].dropped:
                page.blocks.append((tops[-1], text, min(linked, len(text))))
        linked = 0

    def innermost(*names: str) -> int:
        """The place in the stack of the last opened element of these names, 0 for none."""
        return max((depths[n][-1] for n in names if depths.get(n)), default=0)

    def cut(depth: int) -> None:
        """End all elements from this place in the stack on."""
        while len(stack) > depth:
            node = nodes[stack.pop()]
            depths[node.name].pop()
            if node.block:
                tops.pop()
                floors.pop()

    def said(text: str) -> None:
        nonlocal linked
        if text and not nodes[stack[-1]].dropped:
            pieces.append(text)
            if depths.get("a"):
                linked += len(text)

    at, end = 0, len(html)
    while at < end:
        m = _TAG.search(html, at)
        if m is None:
            said(html[at:])
            break
        said(html[at:m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if m["data"]:
                said(m["data"].replace("&", "&amp;"))
            continue
        name = name.lower()
        block = name in _BLOCK
        if m["end"]:
            if name == "br":
                said(" ")
                continue
            if block:
                flush()
            depth = innermost(name)
            # An inline end tag doesn't reach beyond its block.
            if depth and (block or floors[-1] <= depth):
                cut(depth)
            continue
        if name in _VOID:
            if name == "hr":
                flush()
            elif name == "br":
                said(" ")
            continue
        attrs = {a.lower(): b or c or d or "" for a, b, c, d in _ATTR.findall(m["attrs"])} if m["attrs"] else {}
        if m["attrs"] and re.search(r"\shidden(?=[\s/]|$)", m["attrs"]):
            attrs["hidden"] = ""
        if block:
            flush()
            if name in _CLOSES:
                ended, fences = _CLOSES[name]
                while innermost(*ended) > innermost(*fences):
                    cut(innermost(*ended))
            elif nodes[tops[-1]].name == "p" or innermost("p") >= max(1, len(stack) - 6):
                cut(innermost("p"))
        parent = nodes[stack[-1]]
        inside_core = innermost(*_MAIN) > 0
        dropped = parent.dropped or _noise(name, attrs, inside_core)
        if block:
            classes = ".".join(sorted(_DIGITS.sub("#", c.lower()) for c in attrs.get("class", "").split()))
            path = blake2b(f"{nodes[tops[-1]].path}>{name}{'.' + classes if classes else ''}".encode("utf-8", "replace"), digest_size=16).hexdigest()
        else:
            path = ""
        if name in _RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            at = close.start() if close else end
            if close:
                at = (html.find(">", at) + 1) or end
            continue
        here = len(nodes)
        nodes.append(_Node(stack[-1], name, path, dropped, block, here if block and name in _TEXT_CONTAINERS else parent.box))
        depths.setdefault(name, []).append(len(stack))
        if block:
            tops.append(here)
            floors.append(len(stack))
        stack.append(here)
    flush()
    return page


def scores(page: Page) -> dict[int, int]:
    """Score of each container in thousandths of the page's best.

    A block gives its characters outside links to the container it stands in and half to the next one; an
    article, or else the main element, around the best container takes its place.
    """
    raw: dict[int, float] = {}
    for leaf, text, linked in page.blocks:
        worth = len(text) - 2 * linked
        if worth <= 0:
            continue
        own = page.nodes[leaf].name in ("div", "section", "td", "article", "main", "body", "center")
        first = page.nodes[leaf if own else max(0, page.nodes[leaf].parent)].box
        second = page.nodes[page.nodes[first].parent].box if first > 0 else 0
        raw[first] = raw.get(first, 0) + worth
        if second != first:
            raw[second] = raw.get(second, 0) + (worth * 0.9 if own else worth * 0.5)
    raw.pop(0, None)
    if not raw:
        return {}
    best = max(raw, key=lambda i: (raw[i], -i))
    for wanted in ("article", "main"):
        i = best
        while i > 0 and page.nodes[i].name != wanted:
            i = page.nodes[i].parent
        if i > 0:
            raw[i] = max(raw.get(i, 0), raw[best] * 1.01)
            break
    top = max(raw.values())
    return {i: round(1000 * v / top) for i, v in raw.items()}


def main_text(page: Page, path: str | None) -> str:
    """Blocks within the outermost containers on ``path``, or in the page's own best container where there is none."""
    chosen = {i for i, n in enumerate(page.nodes) if n.block and n.path == path and not n.dropped} if path else set()

    def collect(roots: set[int]) -> list[str]:
        within = [False] * len(page.nodes)
        for i, n in enumerate(page.nodes):
            within[i] = i in roots or (n.parent >= 0 and within[n.parent])
        return [text for leaf, text, _ in page.blocks if within[leaf]]

    blocks = collect(chosen) if chosen else []
    if not blocks:
        own = scores(page)
        blocks = collect({max(own, key=lambda i: (own[i], -i))} if own else {0})
    return "\n\n".join(blocks)


def host_of(url: Column) -> Column:
    """The lower-case host of a URL; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def host_paths(pages: DataFrame) -> DataFrame:
    """``(host, path)``: the path (its digest) with the most votes of a host's pages; ties go to the digest that sorts last."""
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = parse(html.as_py() or "")
                rows += [(host, page.nodes[i].path, v) for i, v in scores(page).items() if v > 0 and not page.nodes[i].dropped]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.string(), pa.int64()))],
                                             ["host", "path", "votes"])

    votes = pages.select(host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string")).mapInArrow(vote, "host string, path string, votes long")
    # Whole thousandths add up to the same whatever the order.
    return votes.groupBy("host", "path").agg(F.sum("votes").alias("votes")).groupBy("host").agg(
        F.max(F.struct("votes", "path"))["path"].alias("path"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """The main text of every row of ``pages`` (``page_id``, ``url``, ``html``): ``page_id``, ``url``, ``text``, one row per row.

    The text is the host's winning containers without menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments
    of readers and hidden parts; character references are decoded, white space inside a block becomes one space, and blocks are joined
    by an empty line. A page without its host's path gives its own best container; null and empty pages, and pages without text, give an
    empty text. Rows without a host share one. Repeated rows are extracted each and vote each. Extra columns are not read; no rows
    give no rows. A host's winner is one row, so a host with a third of all pages joins as cheaply as any other.
    """
    winners = stored(host_paths(pages), "host-paths")
    kind = pages.schema["page_id"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(parse(html.as_py() or ""), path) for html, path in zip(batch.column(2), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    hosted = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"), host_of(F.col("url").cast("string")).alias("host"))
    return hosted.join(winners, "host", "left").select("page_id", "url", "html", "path").mapInArrow(extract, f"page_id {kind}, url string, text string")
