"""Main text of web pages by tree scoring.

Every block of text earns points for its length and its commas, discounted by the share of its
characters inside links, and passes them on: all to its parent, half to the grandparent, a third of
``1 / level`` further up.  The container with most points, after its own link share is taken off, is the
article; siblings with a fair share of its points are kept with it, and so are headings and good
paragraphs next to it or next to what holds it, up to the element of the page's content.  What is never article text by its
element, role or class words (menus, headers, footers, side bars, notices, adverts, forms, scripts,
comments) is left out before and after the scoring.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_session

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th pre "
    "blockquote figure figcaption address details summary header footer nav aside form fieldset hr center hgroup menu dialog".split())
NEVER = frozenset(
    "head nav footer aside form button select option fieldset dialog menu template svg math canvas object audio video map applet".split()) | RAW
NEVER_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
NEVER_WORD = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "popup modal overlay subscribe subscription newsletter share sharing social sidebar related recommended recommendations "
    "breadcrumb breadcrumbs menu nav navbar navigation pagination pager footer masthead topbar toolbar login signup widget".split())
COMMENT_WORD = frozenset("comment comments disqus reply replies respond responses commentlist".split())
ARTICLE_WORD = frozenset("article content entry main post story text body".split())
# Start tags that end an open element of these kinds, looked for up to the nearest of _SCOPE.
_ENDS_P = BLOCK - {"html", "body", "tr", "td", "th", "thead", "tbody", "tfoot", "caption"}
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
         "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"},
          "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
_P_SCOPE = frozenset("html body table td th caption article section div li blockquote button object template".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>=`]+)))?""")
# The rest of a tag; a quoted value may hold anything, a quote that is never closed is a character like others.
_TAIL = re.compile(r"""(?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+>""")
_CLASS_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_COMMAS = re.compile("[,،、，]")
_HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_SENTENCE_END = tuple(".!?…。！？؟")


class Page:
    """Elements in page order (a parent comes before its children) and the events that make up the text."""

    def __init__(self, html: str):
        self.tag, self.parent, self.attributes = ["html"], [-1], [{}]
        self.events: list[tuple[int, int, str]] = []  # (kind, element, text): 0 opens, 1 closes, 2 text, 3 a break
        # Places on the stack of open elements, by name and of blocks: no tag walks the stack.
        self.places: dict[str, list[int]] = {"html": [0]}
        self.blocks: list[int] = []
        self._read(html)

    def _open(self, name: str, attributes: dict, stack: list[int]) -> None:
        self._end_implied(name, stack)
        if name in ("html", "body") and self.places.get(name):
            self.attributes[stack[0]] |= attributes if name == "html" else {}
            return
        element = len(self.tag)
        self.tag.append(name)
        self.parent.append(stack[-1])
        self.attributes.append(attributes)
        self.events.append((0, element, ""))
        if name in VOID:
            self.events.append((1, element, ""))
        else:
            self.places.setdefault(name, []).append(len(stack))
            if name in BLOCK:
                self.blocks.append(len(stack))
            stack.append(element)

    def _innermost(self, names) -> int:
        """Place of the innermost open element with one of the names; 0 without one (the root does not count)."""
        return max((places[-1] for name in names if (places := self.places.get(name))), default=0)

    def _end_implied(self, name: str, stack: list[int]) -> None:
        if name in _ENDS_P:
            self._close_to(stack, {"p"}, _P_SCOPE)
        if name in _ENDS:
            self._close_to(stack, _ENDS[name], _SCOPE[name])
        if name in ("body", "main", "article", "div", "p", "nav", "header", "section") and self.tag[stack[-1]] == "head":
            self._pop(stack, len(stack) - 1)

    def _close_to(self, stack: list[int], names: set[str], scope) -> None:
        at = self._innermost(names)
        if at and at >= self._innermost(scope):
            self._pop(stack, at)

    def _pop(self, stack: list[int], to: int) -> None:
        for element in reversed(stack[to:]):
            self.events.append((1, element, ""))
            self.places[self.tag[element]].pop()
        while self.blocks and self.blocks[-1] >= to:
            self.blocks.pop()
        del stack[to:]

    def _read(self, html: str) -> None:
        stack, at, n = [0], 0, len(html)
        lowered, lost = None, False
        while at < n:
            start = html.find("<", at)
            if start < 0:
                start = n
            if start > at:
                self.events.append((2, stack[-1], html[at:start]))
            if start >= n - 1:
                break
            mark = html[start + 1]
            if mark == "!" or mark == "?":
                if html.startswith("<!--", start):
                    end = html.find("-->", start + 4)
                    at = n if end < 0 else end + 3
                else:
                    end = html.find(">", start)
                    at = n if end < 0 else end + 1
                continue
            closing = mark == "/"
            found = _NAME.match(html, start + 1 + closing)
            if not found:
                if closing:
                    end = html.find(">", start)
                    at = n if end < 0 else end + 1
                else:
                    self.events.append((2, stack[-1], "<"))
                    at = start + 1
                continue
            tail = None if lost else _TAIL.match(html, found.end())
            lost = tail is None  # no tag from here on ends outside of quotes: do not scan the page again for each
            end = tail.end() - 1 if tail else html.find(">", found.end())
            if end < 0:
                break  # a tag cut off at the end of the page
            inside = html[found.end():end]
            at = end + 1
            name = found[0].lower()
            if closing:
                if name == "br" or name == "p" and not self.places.get("p"):
                    self.events.append((3, stack[-1], ""))
                    continue
                place = self._innermost((name,))
                # A stray end of an inline element does not end blocks.
                if place and (name in BLOCK or not self.blocks or self.blocks[-1] <= place):
                    self._pop(stack, place)
                continue
            if name == "br":
                self.events.append((3, stack[-1], ""))
                continue
            attributes = {}
            if "=" in inside or inside.strip(" /"):
                attributes = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(inside)}
            if name in RAW:
                lowered = html.lower() if lowered is None else lowered
                end = lowered.find("</" + name, at) if len(lowered) == n else -1
                if end < 0 and len(lowered) != n:
                    match = re.compile("</" + re.escape(name), re.I).search(html, at)
                    end = match.start() if match else -1
                close = html.find(">", end) if end >= 0 else -1
                at = n if end < 0 or close < 0 else close + 1
                continue
            self._open(name, attributes, stack)
            if inside.endswith("/") and name in ("svg", "path"):
                self._pop(stack, len(stack) - 1)
        self._pop(stack, 1)


def _class_words(attributes: dict) -> set[str]:
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return {w.lower() for w in _CLASS_WORD.findall(named)} if len(named) > 1 else set()


def main_text(html: str) -> str:
    """Blocks of the article, in page order, joined by line feeds."""
    page = Page(html)
    tag, parent, n = page.tag, page.parent, len(page.tag)
    words = [_class_words(a) for a in page.attributes]
    block, linked, inside_article = [0] * n, [False] * n, [False] * n
    for e in range(1, n):
        up = parent[e]
        block[e] = e if tag[e] in BLOCK else block[up]
        linked[e] = linked[up] or tag[e] == "a"
        inside_article[e] = inside_article[up] or tag[e] in ("article", "main")
    # Sizes of all text below each element, and of what stands in links there.
    size, in_links, links, holds = [0] * n, [0] * n, [0] * n, [False] * n
    texts = [(e, " ".join(unescape(t).split())) for kind, e, t in page.events if kind == 2]
    for e, text in texts:
        size[e] += len(text)
        if linked[e]:
            in_links[e] += len(text)
    for e in range(n - 1, 0, -1):
        up = parent[e]
        size[up] += size[e]
        in_links[up] += in_links[e]
        links[up] += links[e] + (tag[e] == "a")
        holds[up] = holds[up] or holds[e] or tag[e] in ("article", "main", "h1")
    gone = [False] * n
    for e in range(1, n):
        gone[e] = gone[parent[e]] or _never(page, e, words[e], size, holds, inside_article)
        if not gone[e] and links[e] >= 3 and tag[e] in ("ul", "ol", "div", "section", "table", "p") and not holds[e]:
            gone[e] = in_links[e] > 0.7 * size[e]
    best, points, good = _best(tag, parent, words, gone, block, linked, texts, size, in_links)
    kept = [False] * n
    if best is None:
        kept[0] = True
    else:
        kept[best] = True
        for e in _beside(best, tag, parent, words, gone, size, in_links, points, good):
            kept[e] = True
    blocks: list[str] = []
    now: list[str] = []

    def flush():
        text = " ".join("".join(now).split())
        if text:
            blocks.append(text)
        now.clear()

    shown = [False] * n
    shown[0] = kept[0]
    for e in range(1, n):
        shown[e] = (shown[parent[e]] or kept[e]) and not gone[e]
    for kind, e, text in page.events:
        if kind < 2:
            if tag[e] in BLOCK:
                flush()
        elif shown[e]:
            now.append(unescape(text) if kind == 2 else " ")
    flush()
    return "\n".join(blocks)


def _never(page: Page, e: int, words: set[str], size: list[int], holds: list[bool], inside_article: list[bool]) -> bool:
    tag, attributes = page.tag[e], page.attributes[e]
    if tag in NEVER or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if attributes.get("role", "").lower() in NEVER_ROLE:
        return True
    if tag == "header":
        return not inside_article[e]
    if tag in ("html", "body", "main") or not words:
        return False
    if words & COMMENT_WORD:
        return tag != "article" or bool(inside_article[page.parent[e]]) or bool(words & {"comment", "reply"})
    if tag == "article" or holds[e] or size[e] > 0.5 * size[0]:
        return False
    return bool(words & NEVER_WORD)


def _beside(best: int, tag, parent, words, gone, size, in_links, points, good: dict[int, float]) -> Iterator[int]:
    """What is kept with the article: blocks next to it, and next to its ancestors inside the page's content."""
    n = len(tag)
    below = [0.0] * n  # points of the good paragraphs at or below an element
    titled = [False] * n
    for e in range(n - 1, 0, -1):
        below[e] += 0 if gone[e] else good.get(e, 0)
        titled[e] = titled[e] or tag[e] == "h1"
        if not gone[e]:
            below[parent[e]] += below[e]
            titled[parent[e]] = titled[parent[e]] or titled[e]
    chain = [best]
    while parent[chain[-1]] > 0:
        chain.append(parent[chain[-1]])
    content = [k for k, e in enumerate(chain) if k and (tag[e] in ("main", "article") or words[e] & ARTICLE_WORD and tag[e] != "body")]
    levels = {parent[e]: e for e in chain[:max(content, default=1)]}  # the article's own level at least
    siblings: dict[int, list[int]] = {up: [] for up in levels}
    for e in range(1, n):
        if parent[e] in siblings and tag[e] in BLOCK and size[e]:
            siblings[parent[e]].append(e)
    for up, held in levels.items():
        outer = tag[up] in ("html", "body")
        follows = False
        for e in reversed(siblings[up]):
            plain = in_links[e] < 0.25 * size[e]
            if e == held:
                keep = True
            elif gone[e]:
                keep = False
            elif tag[e] in _HEADING or tag[e] == "header":
                # A heading goes with what follows it; the headline stands before the article.
                keep = plain and (follows or titled[e] and e < held)
                if keep and e != held:
                    yield e
                continue
            elif tag[e] == "article":
                keep = points.get(e, 0) >= max(10, 0.2 * points.get(best, 0))
            else:
                keep = (points.get(e, 0) >= max(10, 0.2 * points.get(best, 0))
                        or plain and (e in good or below[e] >= (3 if outer else 1) or titled[e] and e < held and size[e] < 300))
            if keep and e != held:
                yield e
            follows = keep


def _best(tag, parent, words, gone, block, linked, texts, size, in_links) -> tuple[int | None, dict[int, float], dict[int, float]]:
    """The container with most points, the points of all, and those of good paragraphs: long ones, or sentences, with few links."""
    length: dict[int, int] = {}
    link: dict[int, int] = {}
    commas: dict[int, int] = {}
    last: dict[int, str] = {}
    for e, text in texts:
        if text and not gone[e]:
            b = block[e]
            length[b] = length.get(b, 0) + len(text)
            commas[b] = commas.get(b, 0) + len(_COMMAS.findall(text))
            last[b] = text
            if linked[e]:
                link[b] = link.get(b, 0) + len(text)
    points: dict[int, float] = {}
    good: dict[int, float] = {}
    for b, chars in length.items():
        own = (1 + commas[b] + min(chars / 100, 3)) * (1 - link.get(b, 0) / chars)
        sentence = tag[b] in ("p", "blockquote") and tag[parent[b]] != "body" and b not in link and last[b].endswith(_SENTENCE_END)
        if chars >= 80 and link.get(b, 0) < 0.25 * chars or sentence:
            good[b] = own
        if chars < 25:
            own /= 10
        level, e = 0, parent[b]
        while e > 0 and level < 6:
            points[e] = points.get(e, 0.0) + (own if level == 0 else own / 2 if level == 1 else own / (3 * level))
            level, e = level + 1, parent[e]
    for e in points:
        if tag[e] in ("article", "main") or words[e] & ARTICLE_WORD and tag[e] != "body":
            points[e] += 25
        points[e] *= 1 - in_links[e] / max(size[e], 1)
    if not points:
        return None, points, good
    best = max(points, key=lambda e: (points[e], -e))
    up = parent[best]
    while up > 0:  # a section of an article stands for the article
        if tag[up] == "article":
            best = up
            break
        up = parent[up]
    return best, points, good


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, ``text``, ``n_chars``) of every page; a null or empty page, or one without text, has the empty string.

    Repeated rows come out as often as they went in; other columns are not looked at.
    """
    text_session(pages.sparkSession, 200)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["id", "url", "text", "n_chars"])

    found = rows.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return found.withColumnsRenamed({"id": id_col, "url": url_col})
