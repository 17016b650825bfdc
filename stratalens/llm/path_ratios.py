"""Main text of web pages by ratios of their tag paths.

Text length and punctuation are added up for every path from the root to a block; a block's ratios
are smoothed over its neighbours on the page, fused, and held against a threshold from their spread. The element that
holds most of what passes is the article; menus, notices, adverts, forms and comments are left out by
what their elements are or are called.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S,
)
_NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_TALK = re.compile("comment|disqus|repl(?:y|ies)|respond", re.I)
_MARKS = re.compile(r"[.,;:!?…。、，！？؟]")
#: Elements of HTML by what they do to the text around and inside them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object video audio canvas select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup"
    " time tt u var wbr br img ruby rb rt rp nobr".split()
)
NOT_TEXT = frozenset("head nav footer aside form button dialog menu fieldset legend datalist".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr main menu nav ol p pre section table ul".split()
)
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption address tr ul ol dl table tbody".split())
#: Words in names of classes, ids and roles that mark what is not the article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion promoted nav navbar navigation menu"
    " breadcrumb breadcrumbs sidebar aside footer header masthead topbar toolbar comment comments disqus reply replies respond"
    " cookie cookies consent gdpr notice notices alert popup modal overlay subscribe subscription newsletter signup login share sharing"
    " social related recommended recommendations trending popular pagination pager widget widgets search skip legal copyright"
    " contentinfo complementary".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BIGGEST = frozenset("html body main article".split())


def _aside(tag: str, attributes: str, in_article: bool) -> str:
    """What tells that an element is not the article: "kind" for certain, "name" if it is only called so, else nothing."""
    if tag in NOT_TEXT or tag == "header" and not in_article:
        return "kind"
    if not attributes or tag in BIGGEST:
        return ""
    found = ""
    for name, value in _NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return "kind"
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return "kind"
        elif name in ("class", "id", "role"):
            words = {w.lower() for w in _WORDS.findall(value)}
            if words & ASIDE_WORDS and not (tag in HEADINGS or words & {"body", "content"} and words & {"article", "post", "main"}):
                found = "name"
    return found


class Page:
    """Blocks of text in page order with their paths, elements and link share."""

    def __init__(self, source: str, by_name: bool = True):
        self.parent, self.tag, self.named = [-1], ["#"], [False]
        self.talk = [False]
        self.text: list[str] = []
        self.path: list[str] = []
        self.element: list[int] = []
        self.linked: list[float] = []
        self._read(source, by_name)
        if any(self.named):
            self._leave_out_named()

    def _leave_out_named(self) -> None:
        """Blocks inside elements that are called what is not the article go.

        An element stays in spite of its name if it holds a main element or the article element of most text or, on pages without
        these, 0.7 of the text; such is the wrapper of a layout with a sidebar.
        """
        size = np.zeros(len(self.tag))
        for text, element, linked in zip(self.text, self.element, self.linked):
            size[element] += len(text) * (1 - linked)
        articles = [0.0] * len(self.tag)
        mains = [tag == "main" for tag in self.tag]
        for at in range(len(self.tag) - 1, 0, -1):  # parents come before their children
            if self.tag[at] == "article":
                articles[at] = max(articles[at], size[at])
            above = self.parent[at]
            size[above] += size[at]
            articles[above] = max(articles[above], articles[at])
            mains[above] |= mains[at]
        plain = not mains[0] and not articles[0]
        out = [False] * len(self.tag)
        for at in range(1, len(self.tag)):
            wrapper = mains[at] or 0 < articles[at] == articles[0] or plain and size[at] >= 0.7 * size[0] > 0 and not self.talk[at]
            out[at] = out[self.parent[at]] or self.named[at] and not wrapper
        keep = [k for k, element in enumerate(self.element) if not out[element]]
        self.text, self.path, self.element, self.linked = ([x[k] for k in keep] for x in (self.text, self.path, self.element, self.linked))

    def _read(self, source: str, by_name: bool) -> None:
        # Of each open element: tag, number, path, whether it is left out, whether it is in an article or a link.
        stack = [("#", 0, "", False, False, False)]
        # Where each tag is open in the stack, and where all that are not inline are: no search runs through the stack.
        places: defaultdict[str, list[int]] = defaultdict(list)
        blocks = [0]
        buffer: list[str] = []
        links = [0, 0]
        at = 0

        def close_block() -> None:
            if buffer:
                text = " ".join("".join(buffer).split())
                if text:
                    k = blocks[-1]
                    self.text.append(text)
                    self.path.append(stack[k][2])
                    self.element.append(stack[k][1])
                    self.linked.append(links[0] / max(1, links[1]))
                buffer.clear()
            links[0] = links[1] = 0

        def add(raw: str) -> None:
            if raw and not stack[-1][3]:
                text = html.unescape(raw) if "&" in raw else raw
                buffer.append(text)
                links[1] += len(text)
                links[0] += len(text) * stack[-1][5]

        def pop(to: int) -> None:
            if blocks[-1] >= to:
                close_block()
            while blocks[-1] >= to:
                blocks.pop()
            for s in stack[to:]:
                places[s[0]].pop()
            del stack[to:]

        def nearest(tags: tuple[str, ...]) -> int:
            return max((places[t][-1] for t in tags if places[t]), default=0)

        size, last = len(source), source.rfind(">")
        while at < size:
            m = _TOKEN.search(source, at) if at <= last or source.find("<!", at) >= 0 else None
            if m is None:
                add(source[at:])
                break
            add(source[at:m.start()])
            at = m.end()
            closing, tag, attributes = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
            if not tag:
                if m.group().startswith("<![CDATA["):
                    add(html.escape(m.group()[9:].removesuffix("]]>"), False))
                continue
            tag = tag.lower()
            if closing:
                if places[tag]:
                    pop(places[tag][-1])
                continue
            if tag in RAW and not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else size
                continue
            if tag in VOID:
                if tag == "br":
                    add(" ")
                elif tag == "hr":
                    close_block()
                continue
            if tag in CLOSES_P and stack[blocks[-1]][0] == "p":
                pop(blocks[-1])
            while tag in SAME_CLOSES:
                k = nearest(SAME_CLOSES[tag] + HOLDS[tag])
                if stack[k][0] not in SAME_CLOSES[tag]:
                    break
                pop(k)
                if tag != "tr" or stack[-1][0] not in ("tr", "td", "th"):
                    break
            above = stack[-1]
            in_article = above[4] or tag in ("article", "main")
            aside = _aside(tag, attributes, in_article) if by_name else "kind" if tag in NOT_TEXT else ""
            if tag not in INLINE:
                close_block()
                self.parent.append(above[1])
                self.tag.append(tag)
                self.named.append(aside == "name")
                self.talk.append(aside == "name" and bool(_TALK.search(attributes)))
                number = len(self.tag) - 1
            else:
                number = above[1]
            out = above[3] or aside == "kind" or aside == "name" and tag in INLINE
            places[tag].append(len(stack))
            path = above[2]
            if tag not in INLINE:
                blocks.append(len(stack))
                if len(blocks) <= 300:  # deeper blocks have the path of their ancestor
                    path = f"{path}/{tag}"
            stack.append((tag, number, path, out, in_article, above[5] or tag == "a"))
        close_block()


def fused_ratios(page: Page) -> np.ndarray:
    """Of each block: its path's mean text length times punctuation, both smoothed over neighbouring blocks."""
    length, marks, blocks = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, text, linked in zip(page.path, page.text, page.linked):
        length[path] += len(text) * (1 - linked)
        marks[path] += len(_MARKS.findall(text))
        blocks[path] += 1
    def smooth(values: list[float]) -> np.ndarray:
        v = np.array(values)
        return 0.25 * np.concatenate([v[:1], v[:-1]]) + 0.5 * v + 0.25 * np.concatenate([v[1:], v[-1:]])

    text = smooth([length[p] / blocks[p] for p in page.path])
    return text * (1 + smooth([marks[p] / blocks[p] for p in page.path]))


def _between(page: Page, k: int) -> bool:
    """Whether a block stands between two siblings of plain text."""
    if not 0 < k < len(page.text) - 1:
        return False
    above = page.parent[page.element[k]]
    return all(page.parent[page.element[i]] == above and page.linked[i] <= 0.5 for i in (k - 1, k + 1))


def main_text(source: str, strictness: float = 0.5) -> str:
    """The blocks of the article, one a line; empty where there is none."""
    page = Page(source)
    if not page.text:
        page = Page(source, by_name=False)
    if not page.text:
        return ""
    ratio = fused_ratios(page)
    passes = ratio >= min(strictness * ratio.std(), 0.5 * ratio.max())
    weight = np.zeros(len(page.tag))
    for k in np.flatnonzero(passes):
        weight[page.element[k]] += len(page.text[k]) * (1 - page.linked[k])
    for at in range(len(page.tag) - 1, 0, -1):
        weight[page.parent[at]] += weight[at]
    best = 0
    for at in range(1, len(page.tag)):  # parents come before their children
        if weight[at] >= 0.7 * weight[0] and page.parent[at] == best and page.tag[at] not in LEAVES:
            best = at
    whole, at = None, best
    while at > 0:
        if page.tag[at] in ("article", "main") and page.tag[whole or 0] != "article":
            whole = at
        at = page.parent[at]
    best = best if whole is None else whole
    siblings = {page.parent[page.element[k]] for k in np.flatnonzero(passes)}
    inside = [at == best for at in range(len(page.tag))]
    for at in range(best + 1, len(page.tag)):
        inside[at] = inside[page.parent[at]]
    out = []
    for k, text in enumerate(page.text):
        element = page.element[k]
        if not inside[element]:
            continue
        # Links are part of an article: menus in it are told by their element or name, which has left them out by now.
        if whole is not None or page.tag[element] in HEADINGS:
            out.append(text)
        elif page.parent[element] in siblings and (page.linked[k] <= 0.5 or _between(page, k)):
            out.append(text)
        elif passes[k] and page.linked[k] <= 0.8:
            out.append(text)
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row.

    A null, empty or tagless-blank page gives an empty text; a page without tags is one block. The
    whole source is read. Broken markup is read as far as it makes sense, as browsers do: open paragraphs
    end where a block begins, stray end tags count for nothing. Repeated rows and null ids or urls come out as
    they are; further columns are left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [main_text(h) if h else "" for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
