"""Main text of web pages by tag-path ratios.

A page is read into blocks of text. A block's path is the list of open block elements from the root (inline
markup does not show in it), each with its class and id tokens that name a kind of boilerplate. For every path of a page the
blocks' text length, punctuation and link text are added up. The ratios, text per block, punctuation per block and text
outside links, are smoothed over the neighbouring paths in page order, fused into one score and held against a threshold
derived from the page's own scores. What markup says outright weighs in as a factor: 0 for navigation, headers, footers, asides,
forms, adverts and comments, and a boost for article and main. What wraps the page's text is no boilerplate, whatever its class says.

With an article or main on the page, its blocks are the text. Without, the scores are added up the paths, and the deepest container that
holds most of the score is taken with all that stands in it. Blocks are joined in page order, whole.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
RAW = {"script", "style", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "noscript", "svg", "math",
       "select", "option", "datalist", "object", "canvas", "audio", "video", "button"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
          "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt",
          "u", "var", "center"}
CLOSES = {  # an opening tag ends these elements, up to the nearest of the second set
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, set()),
}
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head"}
CONTENT = {"article", "main"}
ROOTS = {"html", "body", *CONTENT}  # their classes speak of the page, not of themselves
LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "figure", "figcaption", "caption",
          "table", "thead", "tbody", "tfoot", "tr", "th", "address", "details", "summary", "hgroup", "fieldset"}  # parts of a text, not containers
KINDS = re.compile(
    r"^(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|footer|header|masthead|cookies?"
    r"|consent|notices?|popup|modal|newsletter|subscribe|social|share|sharing|comments?|replies|reply|disqus|related|recommended"
    r"|login|signup|search|toolbar|widget|pager|pagination|copyright|legal|disclaimer|hidden)$")
PLACES = re.compile(  # what may stand beside a kind in a compound token without changing what it says
    r"^(?:site|page|global|left|right|top|bottom|upper|lower|primary|secondary|wrap|wrapper|container|bar|box|block|section|area|inner|outer"
    r"|list|links?|items?|content|form|[0-9]+)$")
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")
BOOST = 4.0
SHARE = 0.35  # of the best fused score
REACH = 1


def _kinds(tag: str, attributes: str) -> str:
    """The first class, id or role token that names a kind of boilerplate, whole or beside words for a place."""
    if tag in ("html", "body"):
        return ""
    for m in _ATTRIBUTE.finditer(attributes):
        if m.group(1).lower() in ("class", "id", "role"):
            if tag in ROOTS:
                continue
            for token in (m.group(2) or m.group(3) or m.group(4) or "").lower().split():
                parts = [part for part in re.split(r"[_\-]+", token) if part]
                named = [part for part in parts if KINDS.match(part)]
                if named and all(part in named or PLACES.match(part) for part in parts):
                    return named[0]
        elif m.group(1).lower() in ("hidden", "aria-hidden") and (m.group(2) or m.group(3) or m.group(4) or "true") == "true":
            return "hidden"
    return ""


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int, tuple[int, ...]]]:
    """(path, text, characters inside links, number of each element of the path) of every block with text, in page order."""
    found: list = []
    stack: list[tuple[str, str, int]] = []  # (element, name in the path or "" for inline, place in the page)
    text: list[str] = []
    linked = 0

    def flush():
        nonlocal text, linked
        whole = _SPACE.sub(" ", "".join(text)).strip()
        if whole:
            found.append((tuple(x[1] for x in stack if x[1]), whole, linked, tuple(x[2] for x in stack if x[1])))
        text, linked = [], 0

    def pop(to: int):
        if any(x[1] for x in stack[to:]):
            flush()
        del stack[to:]

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        run = html.unescape(page[at:m.start() if m else len(page)])
        if run:
            text.append(run)
            if any(x[0] == "a" for x in stack):
                linked += len(run.strip())
        if m is None:
            break
        at = m.end()
        if not m.group(2):
            continue
        tag, closing = m.group(2).lower(), bool(m.group(1))
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
                if tag in INLINE and stack[i][1]:
                    break  # inline ends do not reach over a block
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if not m.group(3).rstrip().endswith("/"):
                at = end.end() if end else len(page)
            continue
        if tag in VOID:
            if tag in ("br", "wbr", "img"):
                text.append(" " if tag == "br" else "")
            elif tag == "hr":
                flush()
            continue
        if tag in INLINE:
            stack.append((tag, "", at))
            continue
        flush()
        # a block ends an open paragraph with all the inline markup in it
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == "p" or stack[i][0] in CLOSES.get(tag, (set(),))[0]:
                del stack[i:]
            elif stack[i][1] and (stack[i][0] in CLOSES.get(tag, (0, set()))[1] or tag not in CLOSES):
                break
        while stack and not stack[-1][1] and tag not in ("a",):
            stack.pop()
        kind = _kinds(tag, m.group(3))
        if not m.group(3).rstrip().endswith("/"):
            stack.append((tag, f"{tag}.{kind}" if kind else tag, at))
    flush()
    return found


def _factor(path: tuple[str, ...]) -> float:
    tags = [p.partition(".") for p in path]
    if any(tag in BOILERPLATE or kind for tag, _, kind in tags):
        return 0.0
    return BOOST if any(tag in CONTENT for tag, _, _ in tags) else 1.0


def _unwrapped(found: list) -> list:
    """The blocks with plain names for the marked elements that wrap the page's text: they hold most of it, and its first title."""

    def marked(name):
        tag, _, kind = name.partition(".")
        return kind and kind != "hidden" or tag == "form"

    if not any(marked(name) for path, *_ in found for name in path):
        return found
    apart = BOILERPLATE - {"form"}
    open_ = [b for b in found if not any(name.partition(".")[0] in apart for name in b[0])]
    content = [b for b in open_ if any(name.partition(".")[0] in CONTENT for name in b[0])]
    whole = content or open_
    size: dict = defaultdict(int)
    for _, text, _, places in whole:
        for place in places:
            size[place] += len(text)
    total = sum(len(text) for _, text, _, _ in whole)
    title = next((b[3] for b in whole if b[0] and b[0][-1] == "h1"), None)
    # inside an article or main, what is marked is marked for a reason
    out = []
    for path, text, linked, places in found:
        names, wraps = list(path), True
        for i, place in enumerate(places):
            wraps = wraps and not (content and names[i].partition(".")[0] in CONTENT)
            if wraps and marked(names[i]) and 2 * size[place] > total and (title is None or place in title):
                names[i] = "div"
        out.append((tuple(names), text, linked, places))
    return out


def _container(found: list, score: dict) -> set[tuple[str, ...]]:
    """Paths and places of the blocks in the deepest container that holds most of the score."""
    sums: dict = defaultdict(float)
    for path, *_ in found:
        for k in range(len(path) + 1):
            if not k or path[k - 1].partition(".")[0] not in LEAVES:
                sums[path[:k]] += score[path]
    deepest = max((p for p, x in sums.items() if 2 * x > sums[()]), key=len)
    # of the elements with this path, those that hold a block among the best
    depth, best = len(deepest), SHARE * max(score.values())
    full = {places[:depth] for path, _, _, places in found if path[:depth] == deepest and score[path] >= best}
    return {(path, places) for path, _, _, places in found if path[:depth] == deepest and places[:depth] in full}


def extract(page: str | None) -> str:
    """The main text: blocks joined by line ends, or nothing."""
    found = _unwrapped(blocks(page or ""))
    sums: dict = defaultdict(lambda: [0, 0, 0, 0])
    for path, text, linked, _ in found:
        for i, x in enumerate((1, len(text), len(_PUNCTUATION.findall(text)), linked)):
            sums[path][i] += x
    factor = np.array([_factor(p) for p in sums])
    if not len(factor) or not factor.any():
        return ""
    n, chars, marks, linked = np.array(list(sums.values()), float).T

    def smooth(x):
        weight = np.array([1.0 if k == 0 else 0.25 for k in range(-REACH, REACH + 1)])
        return np.convolve(x, weight, "same")[: len(x)] if len(x) >= len(weight) else x

    outside = np.maximum(chars - linked, 0) / chars
    fused = smooth(chars / n) * np.log1p(smooth(marks / n) + 1) * outside * factor
    inside = factor >= BOOST
    # with an article on the page, its paths are content unless they are links
    whole = bool((inside & (fused > 0)).any())
    chosen = inside if whole else factor > 0
    if fused.max() > 0:
        chosen = chosen & (outside > 0)
    keep = {p for p, c in zip(sums, chosen, strict=True) if c}
    held = None if whole or not fused.max() > 0 else _container(found, dict(zip(sums, fused, strict=True)))
    return "\n".join(text for path, text, _, places in found if path in keep and (held is None or (path, places) in held))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, repeated rows included.

    A null page is empty; a page without main text has an empty text. Other columns are ignored.
    An empty table gives an empty one. ``n_chars`` counts code points.
    """

    def extracted(batches):
        for batch in batches:
            texts = [extract(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
