"""Main-text extraction from HTML by minimum-cut labelling of text blocks.

A page is cut into blocks (text between block-level boundaries).  A log-linear
classifier over a block's containers, class and id words, link density and length
gives each block a cost for either label, which become its terminal capacities.
Blocks next to each other, and blocks that follow each other under the same parent or
close to each other in the tree, are tied by smoothness edges, strongly if they are
alike (same element, same class), weakly across a container that speaks for one label.
Costs and ties are of one size: ties settle what a block's own words leave open, a short
line between paragraphs or a sentence among links.  The minimum cut, found by max-flow,
is the cheapest labelling; its content side is the text.

Before the flow, blocks whose own capacities outweigh all their ties are settled and
folded into their neighbours, which leaves the cut as it is and most pages without
any flow to compute.

Text: character references decoded, white space inside a block turned into one space,
trimmed, blocks joined by two newlines; ``br`` is white space.  Nothing is capped, and
reading a page takes time in proportion to its size, however deep its elements nest.

Defined results: null or empty html gives an empty text; broken markup is read
leniently (an unclosed script or comment runs to the end of the page); repeated rows
stand for themselves; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# HTML's block-level, void and raw-text elements.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
SILENT = frozenset("script style noscript template textarea select button svg math iframe object canvas audio video head title datalist noframes".split())
RAW = frozenset("script style textarea title iframe noframes".split())
#: An element of the key's kind ends an open element of these kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

# The classifier's words and weights.
OUTSIDE = frozenset("nav footer aside form menu dialog fieldset search address".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner billboard breadcrumb breadcrumbs byline-links comment comments commentlist consent cookie cookies copyright credits disqus disclaimer footer footnav gdpr header-nav login masthead menu menus modal nav navbar navigation newsletter notice notices alert overlay pager pagination paywall popup popups print promo promoted promotion related recommended reply replies respond share sharing shares sidebar sidebars signup sitemap skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar tooltip widget widgets".split()
)
CONTENT_WORDS = frozenset("article articlebody body content entry main maincontent post postbody story text".split())
W_BIAS, W_ARTICLE, W_OUTSIDE, W_BOILER_WORD, W_CONTENT_WORD = -0.4, 2.5, -4.0, -4.0, 1.0
W_WORDS, W_LINKS, W_SENTENCE, W_HEADING, W_LIST = 1.2, -4.0, 0.8, 0.6, -0.6
#: Ties: of neighbours, of neighbours by closeness, the share kept per step apart in the tree, of followers under one parent.
TIE_NEXT, TIE_NEAR, TIE_DECAY, TIE_PARENT = 0.2, 0.6, 0.6, 1.4
#: The share of a tie that blocks of another class, of another element, or of a container with another say keep.
OTHER_CLASS, OTHER_KIND, OTHER_SAY = 0.6, 0.5, 0.2

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)[^>]*>")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())


class Block:
    __slots__ = ("parts", "linked", "node", "article", "outside", "boiler", "content")

    def __init__(self, top: "_Open"):
        self.parts, self.linked, self.node = [], 0, top.held
        self.article, self.outside, self.boiler, self.content = top.article, top.outside, top.boiler, top.content


class _Open:
    """An element; ``held`` is the nearest block-level one from here up, ``up`` and ``level`` are that one's parent and depth."""

    __slots__ = ("tag", "number", "names", "held", "up", "level", "article", "outside", "boiler", "content", "silent", "link")

    def __init__(self, tag, number, parent, attributes):
        self.tag, self.number, self.names = tag, number, ""
        self.article = self.outside = self.boiler = self.content = self.silent = self.link = False
        self.held, self.up, self.level = self, None, 0
        if parent is not None:
            self.article, self.outside, self.boiler, self.content = parent.article, parent.outside, parent.boiler, parent.content
            self.silent, self.link = parent.silent, parent.link
            if tag in BLOCK:
                self.up, self.level = parent.held, parent.held.level + 1
            else:
                self.held = parent.held
        if tag in ("article", "main"):
            self.article = True
        elif tag in OUTSIDE or (tag == "header" and not self.article):
            self.outside = True
        self.silent |= tag in SILENT
        self.link |= tag == "a"
        if attributes and "=" in attributes and tag not in ("body", "html"):
            for name, value in _ATTR.findall(attributes):
                value = value.strip("\"'").lower()
                if name.lower() == "role":
                    self.outside |= value in _ROLES
                    self.article |= value in ("main", "article")
                    continue
                if name.lower() == "class":
                    self.names = value
                words = {value, *value.split(), *_WORD.findall(value)}
                self.boiler |= not words.isdisjoint(BOILER_WORDS)
                self.content |= not words.isdisjoint(CONTENT_WORDS)


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order, with what the classifier looks at."""
    out: list[Block] = []
    root = _Open("#root", 0, None, "")
    stack, current, number = [root], None, 0
    opened: Counter[str] = Counter()
    blocks = [0]  # places of the block-level elements in the stack
    last = page.rfind(">")

    def close(k: int) -> None:
        for o in stack[k:]:
            opened[o.tag] -= 1
        del stack[k:]
        while blocks[-1] >= k:
            blocks.pop()

    def text(piece: str) -> None:
        nonlocal current
        top = stack[-1]
        if top.silent or not piece:
            return
        if current is None:
            if piece.isspace():
                return
            current = Block(top)
            out.append(current)
        current.parts.append(piece)
        if top.link:
            current.linked += len(piece.strip())
        if current.boiler != top.boiler or current.outside != top.outside:  # an inline container
            current.boiler &= top.boiler
            current.outside &= top.outside

    at, size = 0, len(page)
    while at < size:
        begin = page.find("<", at)
        if begin < 0 or (begin > last and not page.startswith("<!--", begin)):
            text(page[at:])
            break
        match = _TAG.match(page, begin) or _LOOSE.match(page, begin)
        if match is None:
            text(page[at : begin + 1])
            at = begin + 1
            continue
        if begin > at:
            text(page[at:begin])
        at = match.end()
        name = match[2]
        if not name:
            continue
        tag = name.lower()
        if match[1]:
            if opened[tag]:
                depth = next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag)
                if blocks[-1] >= depth:
                    current = None
                close(depth)
            elif tag in BLOCK:
                current = None
            continue
        if tag == "br":
            text(" ") if current is not None else None
            continue
        if tag in BLOCK:
            current = None
            k = blocks[-1]
            if k and (stack[k].tag == "p" or stack[k].tag in ENDS.get(tag, ())):
                close(k)
        if tag in VOID:
            continue
        number += 1
        attributes = match[3] if match.re is _TAG else ""
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if attributes.endswith("/") and tag in ("svg", "math", "path"):
            continue
        if tag in BLOCK:
            blocks.append(len(stack))
        stack.append(_Open(tag, number, stack[-1], attributes))
        opened[tag] += 1
    return out


def log_odds(block: Block, text: str) -> float:
    """The classifier: over 0 for content."""
    words = len(text.split())
    odds = W_BIAS + W_WORDS * min(2.5, math.log1p(words) - 1.2)
    odds += W_LINKS * min(1.0, block.linked / max(1, len(text)))
    odds += W_SENTENCE * (text[-1:] in ".!?…\"'”»")
    if block.outside or block.boiler:  # the nearer container has the say
        odds += W_OUTSIDE * block.outside + W_BOILER_WORD * block.boiler
    else:
        odds += W_ARTICLE * block.article + W_CONTENT_WORD * (block.content and not block.article)
    kind = block.node.tag
    odds += W_HEADING * (kind in ("h1", "h2", "h3", "h4", "h5", "h6")) + W_LIST * (kind in ("li", "td", "option"))
    return odds


def apart(a: _Open, b: _Open) -> int:
    """Steps between two block-level elements; over a page's neighbours they add up to the size of its tree."""
    steps = 0
    while a is not b:
        if a.level >= b.level:
            a = a.up
        else:
            b = b.up
        steps += 1
    return steps


def likeness(a: Block, b: Block) -> float:
    """The share of its weight that a tie between two blocks keeps."""
    share = 1.0 if a.node.names == b.node.names else OTHER_CLASS
    if a.node.tag != b.node.tag:
        share *= OTHER_KIND
    if (a.outside, a.boiler, a.article) != (b.outside, b.boiler, b.article):
        share *= OTHER_SAY
    return share


def ties(found: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness edges: neighbours on the page, by closeness in the tree, and followers under one parent."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for j, block in enumerate(found):
        if j:
            near = found[j - 1]
            edges[j - 1, j] = likeness(near, block) * (TIE_NEXT + TIE_NEAR * TIE_DECAY ** apart(near.node, block.node))
        parent = block.node.up.number if block.node.up is not None else -1
        i = last.get(parent)
        if i is not None:
            edges[i, j] = edges.get((i, j), 0.0) + TIE_PARENT * likeness(found[i], block)
        last[parent] = j
    return edges


def minimum_cut(content_cost: list[float], boiler_cost: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """True for the nodes on the content side of a minimum cut; a tie goes to boilerplate.

    A node labelled content pays its content cost, one labelled boilerplate its boilerplate
    cost, and an edge between different labels its weight.
    """
    n = len(content_cost)
    net = [b - c for b, c in zip(boiler_cost, content_cost)]
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None or abs(net[i]) <= sum(near[i].values()):
            continue
        label[i] = net[i] > 0
        for j, w in near[i].items():
            net[j] += w if label[i] else -w
            del near[j][i]
            todo.append(j)
        near[i] = {}
    open_nodes = [i for i in range(n) if label[i] is None]
    if open_nodes:
        number = {i: k for k, i in enumerate(open_nodes)}
        side = _max_flow([net[i] for i in open_nodes], [{number[j]: w for j, w in near[i].items()} for i in open_nodes])
        for i, s in zip(open_nodes, side):
            label[i] = s
    return [bool(x) for x in label]


def _max_flow(net: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Dinic's algorithm; the source feeds nodes with net > 0, the others drain to the sink."""
    n = len(net)
    source, sink = n, n + 1
    rest = [dict(x) for x in near] + [{}, {}]
    for i, x in enumerate(net):
        if x > 0:
            rest[source][i], rest[i][source] = x, 0.0
        elif x < 0:
            rest[i][sink], rest[sink][i] = -x, 0.0
    tiny = 1e-12

    def levels() -> dict[int, int]:
        level, todo = {source: 0}, deque([source])
        while todo:
            u = todo.popleft()
            for v, w in rest[u].items():
                if w > tiny and v not in level:
                    level[v] = level[u] + 1
                    todo.append(v)
        return level

    while sink in (level := levels()):
        arcs = {u: iter(list(rest[u])) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(rest[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    rest[a][b] -= flow
                    rest[b][a] = rest[b].get(a, 0.0) + flow
                full = next(k for k, (a, b) in enumerate(zip(path, path[1:])) if rest[a][b] <= tiny)
                for v in path[full:]:
                    arcs[v] = iter(list(rest[v])) if v != path[full] else arcs[v]
                del path[full + 1 :]
                continue
            for v in arcs[u]:
                if rest[u][v] > tiny and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
            else:
                level.pop(u)
                path.pop()
    return [i in level for i in range(n)]


def labelled(page: str) -> list[tuple[str, float, bool]]:
    """(text, classifier's log-odds, kept by the cut) of each block of a page."""
    found, texts = [], []
    for block in blocks_of(page):
        text = " ".join(html.unescape("".join(block.parts)).split())
        if text:
            found.append(block)
            texts.append(text)
    odds = [log_odds(b, t) for b, t in zip(found, texts)]
    cost = lambda x: math.log1p(math.exp(-abs(x))) + max(0.0, -x)
    return list(zip(texts, odds, minimum_cut([cost(x) for x in odds], [cost(-x) for x in odds], ties(found))))


def extract(page: str | None) -> str:
    """The main text of a page."""
    return "\n\n".join(text for text, _, kept in labelled(page) if kept) if page else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = batch.column("html")
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            texts = [extract(x) for x in pages.slice(a, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
