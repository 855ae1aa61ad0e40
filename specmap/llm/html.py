"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read into blocks: runs of text between block-level tags, with their path of open elements. What a browser does
not show as text (head, script, style, template, comments …) makes no block. Each block gets two costs, of being called
content and of being called boilerplate: the logistic losses of a classifier on its shape (length, links, punctuation,
heading), trained here on blocks that semantic elements label, plus a fixed cost where the nearest telling ancestor says
article or says menu, header, footer, sidebar, notice, advert, form or reader comment. The costs are the capacities to
source and sink; neighbouring blocks, and blocks near each other under one parent, are joined by edges that grow with the
path they share. The minimum cut labels the page. Blocks whose costs differ by more than all their edges keep their own
label in every minimum cut, so they are set first, and the flow runs on what is left.

Cases: a null or empty page has no blocks and an empty text; broken markup is read as far as it goes, a lone < is text;
br and white space of any kind count as one space; pages are independent, so repeated rows each give a row; a null id
stays null; an empty table gives an empty one; pages without any labelling element are judged by shape alone, and without
training blocks the shape costs are zero; other columns are ignored.
"""
from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: About so many pages (those whose hash falls below a share) teach the classifier.
FIT_PAGES = 2_000
#: Cost of going against the nearest telling ancestor, and weight of an edge between blocks that share their whole path.
TELLING, SMOOTH, NEAR = 8.0, 1.0, 3

# HTML elements by role.
HIDDEN = frozenset("head script style template noscript textarea select iframe svg annotation annotation-xml object video audio canvas title".split())
#: Hidden elements that end no line.
INLINE = frozenset("svg annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("html body button caption tbody td tfoot th thead tr".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog button".split())
CONTENT = frozenset("article main".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header "
    "masthead footer foot sidebar side rail widget related recommended cookie cookies consent notice gdpr popup modal overlay alert "
    "newsletter subscribe subscription signup login form search comment comments reply replies respond discussion disqus share sharing "
    "social toolbar copyright legal pagination pager tags".split()
)
CONTENT_WORDS = frozenset("article content post entry story main body text".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
#: First words of class names that tell a state or a topic, not a role.
MODIFIERS = frozenset("has is no with without category tag format type".split())
#: What may stand in a head; the second kind is skipped with its contents.
_HEAD_VOID, _HEAD = frozenset("base basefont bgsound link meta".split()), frozenset("title style script noscript template".split())
_HEAD_END = re.compile(r"(?=<body\b)|</head\b[^>]*>?", re.I)
#: HTML elements that end foreign content.
_BREAKS_OUT = re.compile(
    r"(?=<(?:b|big|blockquote|body|br|center|code|dd|div|dl|dt|em|embed|h[1-6]|hr|i|img|li|listing|menu|meta|nobr|ol|p|pre|ruby|s|small|span|strong|"
    r"strike|sub|sup|table|tt|u|ul|var|article|main|section|header|footer|nav|aside)[\s/>])", re.I)  # fmt: skip
_INSIDE_SVG = re.compile(r"<(?:foreignObject|desc|title)\b", re.I)
SHAPE = ("bias", "words", "links", "sentence", "heading", "item", "brief")


@dataclass
class Block:
    """Text with single spaces, its path of element numbers, what the nearest telling ancestor says, and its shape."""

    text: str
    path: tuple[int, ...]
    told: int
    shape: tuple[float, ...]


def _says(tag: str, attributes: str, inside_article: bool) -> int:
    """1 content, -1 boilerplate, 0 nothing. Whole class names of content outrank those of layout; article and main go by
    their element unless a whole name says otherwise; compound names tell only elsewhere, by their first and last word."""
    if tag in ("html", "body"):
        return 0
    heading = tag == "header" and inside_article
    if tag in BOILERPLATE and not heading:
        return -1
    names: set[str] = set()
    if attributes and "=" in attributes:
        for m in _NAMES.finditer(attributes):
            names.update((m[1] or m[2] or m[3] or "").lower().split())
    layout = BOILERPLATE_WORDS - {"header"} if heading else BOILERPLATE_WORDS
    if names & CONTENT_WORDS:
        return 1
    if names & layout:
        return -1
    if tag in CONTENT:
        return 1
    says = 0
    for parts in map(_WORD.findall, names):
        if not parts or parts[0] in MODIFIERS:
            continue
        content = not CONTENT_WORDS.isdisjoint(parts)
        if {parts[0], parts[-1]} & layout or not content and not layout.isdisjoint(parts):
            return -1
        says |= content and layout.isdisjoint(parts)
    return int(says)


def _after_hidden(page: str, tag: str, at: int) -> int:
    """Where the hidden element whose start tag ends at `at` ends."""
    end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
    if tag == "svg":
        out = _BREAKS_OUT.search(page, at)
        if out and (end is None or out.start() < end.start() and not _INSIDE_SVG.search(page, at, out.start())):
            return out.start()
    return end.end() if end else len(page)


def _after_head(page: str, at: int) -> int:
    """Where the head ends: at its closing tag, or at the first text or tag that cannot stand in a head."""
    while at < len(page):
        m = _TOKEN.match(page, at)
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0][0] != "<" and m[0].strip() or m[0] == "<":
                return at
        elif m[1] or m[4]:
            if tag == "head":
                return m.end()
        elif tag in _HEAD:
            inner = _after_hidden(page, tag, m.end())
            if inner == len(page) and tag != "script" and (end := _HEAD_END.search(page, m.end())):
                inner = end.end()
            at = inner
            continue
        elif tag not in _HEAD_VOID:
            return at
        at = m.end()
    return at


def blocks(page: str) -> list[Block]:
    """The blocks of a page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, number, what it says
    number, links, linked, at = 0, 0, 0, 0
    run: list[str] = []

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                told = next((s for _, _, s in reversed(stack) if s), 0)
                n = text.count(" ") + 1
                top = next((t for t, _, _ in reversed(stack) if t in BLOCKS), "")
                share = min(1.0, linked / len(text))
                shape = (1.0, float(np.log1p(n)), share, float(text[-1] in ".!?…:\"”»"), float(top[:1] == "h" and top[1:].isdigit()), float(top in ("li", "td", "th", "dt")), float(n < 5))
                out.append(Block(text, tuple(k for _, k, _ in stack), told, shape))
        linked = 0

    size = len(page)
    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            token = m[0]
            if token[0] != "<" or token == "<":
                text = html.unescape(token) if "&" in token else token
                run.append(text)
                if links:
                    linked += len(text)
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == tag), 0)
            if tag in BLOCKS:
                flush()
            if depth:
                links -= sum(t == "a" for t, _, _ in stack[depth:])
                del stack[depth:]
            continue
        if tag in HIDDEN:
            if tag not in INLINE:
                flush()
            if not (tag in INLINE and (m[3] or m[6] or "").endswith("/")):
                at = _after_head(page, at) if tag == "head" else _after_hidden(page, tag, at)
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            if tag in CLOSES_P or tag in ("li", "td", "th", "tr", "dt", "dd"):
                same = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}.get(tag, ("p",))
                for d in range(len(stack) - 1, 0, -1):
                    if stack[d][0] in same:
                        links -= sum(t == "a" for t, _, _ in stack[d:])
                        del stack[d:]
                        break
                    if stack[d][0] in BLOCKS:
                        break
        if tag in VOID or (m[3] or m[6] or "").endswith("/") and tag not in BLOCKS:
            continue
        number += 1
        links += tag == "a"
        inside = any(t in CONTENT for t, _, _ in stack)
        stack.append((tag, number, _says(tag, m[3] or m[6] or "", inside)))
    flush()
    return out


def edges(page: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness between neighbours, and between blocks at most `NEAR` apart under one parent."""
    out = []
    for i, b in enumerate(page):
        for j in range(i + 1, min(len(page), i + 1 + NEAR)):
            other = page[j].path
            shared = next((k for k, (x, y) in enumerate(zip(b.path, other, strict=False)) if x != y), min(len(b.path), len(other)))
            alike = shared / max(len(b.path), len(other))
            if j == i + 1:
                out.append((i, j, SMOOTH * alike))
            elif b.path[:-1] == other[:-1]:
                out.append((i, j, SMOOTH * alike / (2 * (j - i))))
    return out


def minimum_cut(gain: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (true: content) that minimise the sum of |gain| of blocks labelled against the sign of their gain, and of
    the weights of links between unlike labels."""
    n = len(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in links:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    pull = list(gain)
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(pull[i]) > sum(near[i].values()):
            label[i] = pull[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                pull[j] += w if label[i] else -w
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        _cut_rest(rest, pull, near, label)
    return [bool(x) for x in label]


def _cut_rest(rest: list[int], pull: list[float], near: list[dict[int, float]], label: list[bool | None]) -> None:
    """Maximum flow by shortest augmenting layers; what the source still reaches is content."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {source: {}, sink: {}}
    for i in rest:
        room[i] = dict(near[i])
    for i in rest:
        if pull[i] >= 0:
            room[source][i] = pull[i]
            room[i].setdefault(source, 0.0)
        else:
            room[i][sink] = -pull[i]
            room[sink].setdefault(i, 0.0)
    while True:
        layer, line = {source: 0}, deque([source])
        while line:
            u = line.popleft()
            for v, c in room[u].items():
                if c > 1e-12 and v not in layer:
                    layer[v] = layer[u] + 1
                    line.append(v)
        if sink not in layer:
            break
        ways = {u: iter(list(room[u])) for u in layer}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(room[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    room[a][b] -= flow
                    room[b][a] = room[b].get(a, 0.0) + flow
                path = [source]
                ways = {x: iter(list(room[x])) for x in layer}
                continue
            v = next((v for v in ways[u] if room[u][v] > 1e-12 and layer.get(v) == layer[u] + 1), None)
            if v is None:
                path.pop()
                layer[u] = -1
            else:
                path.append(v)
    for i in rest:
        label[i] = i in layer


def extract(page: str, weights: np.ndarray) -> str:
    """The content blocks, joined by an empty line."""
    found = blocks(page)
    if not found:
        return ""
    gain = np.array([b.shape for b in found]) @ weights + TELLING * np.array([b.told for b in found])
    kept = minimum_cut(gain.tolist(), edges(found))
    return "\n\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


def fit(shapes: np.ndarray, content: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps; both labels count alike."""
    w = np.zeros(len(SHAPE))
    if content.all() or not content.any():
        return w
    each = np.where(content, 0.5 / content.sum(), 0.5 / (~content).sum())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(shapes @ w, -30, 30)))
        g = shapes.T @ (each * (p - content)) + ridge * w
        h = (shapes * (each * p * (1 - p))[:, None]).T @ shapes + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", fit_pages: int = FIT_PAGES) -> np.ndarray:
    """Weights of the shape, from blocks of about `fit_pages` pages that a telling ancestor labels."""
    share = min(1.0, fit_pages / max(1, pages.count()))
    text = F.col(html_col).cast("string")
    drawn = pages.filter(F.pmod(F.xxhash64(F.col(id_col), text, F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30))).select(text.alias("html"))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [b for page in batch.column("html").to_pylist() for b in blocks(page or "") if b.told]
            yield pa.RecordBatch.from_arrays([pa.array([b.told > 0 for b in told], pa.bool_()), pa.array([list(b.shape) for b in told], pa.list_(pa.float64()))], ["content", "shape"])

    rows = drawn.mapInArrow(stage, "content boolean, shape array<double>").toArrow()
    if not rows.num_rows:
        return np.zeros(len(SHAPE))
    return fit(np.array(rows.column("shape").to_pylist()), np.array(rows.column("content").to_pylist(), bool))


def main_text(pages: DataFrame, weights: np.ndarray, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(id, url, text, n_chars) for every row."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page or "", weights) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    plain = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return plain.mapInArrow(stage, "id long, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
