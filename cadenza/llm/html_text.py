"""Main text of raw web pages by minimum-cut labelling of their blocks.

A page falls into blocks: text between the borders of block-level elements. A linear classifier over the block and its
ancestors (containers, roles, class names, link share, length) gives each block a cost for being called content and one
for boilerplate; these are the capacities to the two terminals. Neighbouring blocks are tied by edges whose weight falls
with their distance in the element tree. The minimum cut, by maximum flow, is the labelling of least total cost.

Pages are read whole and in parallel, each on its own. Character references are decoded once, white space inside a block
becomes one space, blocks are joined in page order by a newline. Defined cases: null html is an empty page with an empty
text; unclosed or stray tags close as browsers close them, broken markup is text; a page without any tag is one block of
content; scripts, styles, templates, comments and the head are never text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import log2

from pyspark.sql import DataFrame

from .common import map_texts, text_bytes

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_RAW = {"script", "style", "template", "noscript", "textarea", "iframe", "svg", "math", "object", "select", "option", "button", "title", "canvas", "audio", "video"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img picture".split())
_CLOSED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "blockquote", "aside", "nav", "header", "footer", "form"}

#: Weights of the classifier, as log-odds of content. Fixed values.
_CONTAINER = {"article": 4.0, "main": 3.0, "nav": -9.0, "footer": -9.0, "aside": -8.0, "form": -8.0, "header": -7.0, "menu": -8.0, "dialog": -8.0, "fieldset": -6.0, "address": -3.0}
_ROLE = {"main": 3.0, "article": 3.0, "navigation": -9.0, "banner": -8.0, "contentinfo": -9.0, "complementary": -8.0, "search": -8.0, "dialog": -8.0, "alert": -8.0, "menu": -8.0}
_BAD_NAME = re.compile(r"(?:^|[-_ ])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|comments?|disqus|respond|replies|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|footer\w*|header|masthead|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommended|widget\w*|pagination|pager|toolbar|skip)(?:$|[-_ ])", re.I)
_GOOD_NAME = re.compile(r"(?:^|[-_ ])(?:article|content|entry|post|story|body|main|text)(?:$|[-_ ])", re.I)
_TAG_BIAS = {"p": 0.8, "h1": 0.8, "h2": 0.5, "h3": 0.5, "pre": 0.8, "blockquote": 0.5, "li": -0.6, "td": -0.3, "th": -0.3, "figcaption": 0.3}
BIAS, PER_DOUBLING, LINKS, SENTENCE, TIE = -1.6, 0.45, -4.0, 0.6, 0.9
NAME_BAD, NAME_GOOD = -8.0, 1.5


class Block:
    __slots__ = ("score", "path", "text")

    def __init__(self, text: str, path: tuple[int, ...], score: float):
        self.text, self.path, self.score = text, path, score


class _Element:
    __slots__ = ("tag", "number", "lean", "held")

    def __init__(self, tag: str, number: int, lean: float, held: bool):
        self.tag, self.number, self.lean, self.held = tag, number, lean, held


def _lean(tag: str, attributes: str, inside: bool) -> float:
    """What an element says about the blocks in it; inside: it stands in an article, whose own header is content."""
    lean = _CONTAINER.get(tag, 0.0)
    if inside and tag == "header":
        lean = 0.0
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return lean
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attributes)}
    lean += _ROLE.get(found.get("role", "").lower(), 0.0)
    name = f"{found.get('class', '')} {found.get('id', '')}"
    if name != " " and tag not in ("body", "html"):
        lean += NAME_BAD if _BAD_NAME.search(name) else NAME_GOOD if _GOOD_NAME.search(name) else 0.0
    if found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")) or re.search(r"(?:^|\s)hidden(?:$|[\s=])", attributes):
        lean += NAME_BAD
    return lean


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order, each with its path in the element tree and its classifier score."""
    out: list[Block] = []
    stack = [_Element("", 0, 0.0, False)]
    parts: list[str] = []
    linked = total = number = 0
    links = 0  # open <a>

    def flush() -> None:
        nonlocal linked, total
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                best = max(e.lean for e in stack)
                worst = min(e.lean for e in stack)
                tag = next((e.tag for e in reversed(stack) if e.tag not in _INLINE), "")
                words = text.count(" ") + 1
                score = BIAS + best + worst + _TAG_BIAS.get(tag, 0.0) + PER_DOUBLING * min(8.0, log2(words)) + LINKS * linked / max(1, total)
                score += SENTENCE * (text[-1] in ".!?:;…\"'»”)")
                out.append(Block(text, tuple(e.number for e in stack if e.tag not in _INLINE), score))
            parts.clear()
        linked = total = 0

    def text_run(piece: str) -> None:
        nonlocal linked, total
        parts.append(piece)
        total += len(piece)
        if links:
            linked += len(piece)

    at, low = 0, None
    while m := _TAG.search(page, at):
        if m.start() > at:
            text_run(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if not m[1]:
            if tag in _RAW or tag == "head":
                low = low if low is not None else page.lower()
                if tag == "head":
                    # the head ends with its tag, or where the body begins
                    ends = [k for k in (low.find("</head", at), low.find("<body", at)) if k >= 0]
                    end = min(ends, default=-1)
                    at = end if end >= 0 else at
                    flush()
                    continue
                end = low.find("</" + tag, at) if len(low) == len(page) else -1
                if end < 0 and len(low) != len(page):
                    closing = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
                    end = closing.start() if closing else -1
                at = end if end >= 0 else len(page)
                if tag not in ("button", "select", "option"):
                    continue
                text_run(" ")
                continue
            if tag in _VOID:
                if tag in ("br", "wbr", "img", "input"):
                    text_run(" " if tag != "wbr" else "")
                else:
                    flush()
                continue
            if tag == "a":
                links += 1
                continue
            if tag in _INLINE:
                number += 1
                stack.append(_Element(tag, number, _lean(tag, m[3], True), False)) if m[3] else None
                continue
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _CLOSED_BY.get(tag, ()) or (stack[k].tag == "p" and tag not in _INLINE):
                    del stack[k:]
                    break
                if stack[k].tag in _SCOPE:
                    break
            number += 1
            inside = stack[-1].held
            stack.append(_Element(tag, number, _lean(tag, m[3], inside), inside or tag in ("article", "main")))
        elif tag == "a":
            links = max(0, links - 1)
        else:
            if tag not in _INLINE:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in _INLINE and stack[k].tag not in _INLINE:
                    break
    if at < len(page):
        text_run(page[at:])
    flush()
    return out


def ties(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: each block with the next, and with the next in the same parent; lighter the further apart in the tree."""
    edges, last = [], {}
    for i, b in enumerate(found):
        before = last.get(b.path[:-1])
        if i:
            a = found[i - 1]
            common = 0
            for x, y in zip(a.path, b.path):
                if x != y:
                    break
                common += 1
            apart = len(a.path) + len(b.path) - 2 * common
            edges.append((i - 1, i, TIE / (1 + max(0, apart - 2))))
        if before is not None and before < i - 1:
            edges.append((before, i, TIE / 2))
        last[b.path[:-1]] = i
    return edges


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the content side of the minimum cut: Dinic's maximum flow from content to boilerplate."""
    n = len(scores)
    source, sink = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def connect(a: int, b: int, there: float, back: float) -> None:
        graph[a].append(len(to))
        to.append(b)
        room.append(there)
        graph[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, s in enumerate(scores):
        connect(source, i, s, 0.0) if s > 0 else connect(i, sink, -s, 0.0)
    for a, b, weight in edges:
        connect(a, b, weight, weight)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for u in queue:
            for e in graph[u]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            for k in range(at[u], len(graph[u])):
                e = graph[u][k]
                if room[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    at[u] = k
                    path.append(e)
                    u = to[e]
                    break
            else:
                if u == source:
                    break
                level[u] = -1
                e = path.pop()
                u = to[e ^ 1]


def main_text(page: str) -> str:
    found = blocks(page)
    if not _TAG.search(page):
        return "\n".join(b.text for b in found)
    labels = min_cut([b.score for b in found], ties(found))
    return "\n".join(b.text for b, content in zip(found, labels) if content)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row."""

    def work(parts: Iterator[dict]) -> Iterator[dict]:
        for part in parts:
            texts = [main_text(h.decode()) if h else "" for h in text_bytes(part["html"])]
            yield {"page_id": part["page_id"], "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return map_texts(pages, ["page_id", "url", "html"], work, "page_id long, url string, text string, n_chars long", "html")
