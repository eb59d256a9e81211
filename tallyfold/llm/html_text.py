"""Operator 10: main text of web pages by flat text blocks and a decision tree.

A page falls into flat blocks: runs of text between block-level tags, found in one linear pass. Each
block has its word count and link density, those of the blocks before and after it, and whether it is
a heading. A decision tree, grown here by Gini impurity on the small labelled table below, says which
blocks are main text. What the markup says (the nearest enclosing element or class that marks an
article, a menu, a footer ...) is a minor feature: it is left out of the first levels of the tree, and
every block taken from a real page is in the table without it as well, so that the tree can do
without it.

Defined results: null or empty html gives an empty text; broken markup never fails (an unclosed
element ends with the element around it); text in script, style, head and forms is no block;
repeated rows and null ids stay as they are; whole pages of any length; other columns are ignored;
elements nested deeper than DEEPEST are text of the one around them.
"""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession

from tallyfold.llm.common import map_texts, table

NAME = re.compile(r"/?[A-Za-z][A-Za-z0-9:-]*")
DEEPEST = 500
ATTRS = re.compile(r"(?:\b(?:class|id|role|aria-label|itemprop)\s*=\s*)(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
SKIPPED = {"script", "style", "head", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "select", "button", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
CLOSED_BY_SIBLING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = {"p", "div", "ul", "ol", "table", "section", "article", "aside", "nav", "footer", "header", "main", "h1", "h2", "h3", "h4", "h5", "h6", "form", "blockquote", "pre", "dl", "hr", "figure"}
#: Elements and class words that mark what is main text and what isn't.
MAIN_TAGS = {"article", "main"}
OTHER_TAGS = {"nav", "footer", "aside", "form", "header", "menu", "dialog", "address"}
MAIN_WORDS = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main|body|text)(?:$|[\s_-])", re.I)
OTHER_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|aside|foot\w*|header|masthead|cookies?|consent|notices?|alert|popup|modal|overlay"
    r"|comments?|disqus|repl(?:y|ies)|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe|subscription|signup|login|search\w*|widget\w*|toolbar|pagination|pager|tags?|copyright|legal|disclaimer|skip|toc|complementary|navigation|contentinfo)(?:$|[\s_-])",
    re.I,
)


class Block:
    __slots__ = ("text", "words", "linked", "place", "heading", "sure")

    def __init__(self, text: str, words: int, linked: int, place: int, heading: bool):
        self.text, self.words, self.linked, self.place, self.heading = text, words, linked, place, heading


class Scanner:
    """Finds the tags of a page from left to right; what isn't there is looked for once only."""

    def __init__(self, page: str):
        self.page, self.lower = page, page.lower()
        if len(self.lower) != len(page):  # a few letters grow in lower case
            self.lower = page.translate({i: i + 32 for i in range(65, 91)})
        self.missing: set[str] = set()

    def find(self, what: str, at: int, text: str | None = None) -> int:
        if what in self.missing:
            return -1
        found = (self.page if text is None else text).find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def end_of_tag(self, at: int) -> int:
        """Behind the > that ends a tag, quoted ones left out; -1 if there is none."""
        while True:
            end = self.find(">", at)
            if end < 0:
                return -1
            quotes = [q for q in (self.page.find('"', at, end), self.page.find("'", at, end)) if q >= 0]
            if not quotes:
                return end + 1
            q = min(quotes)
            close = self.find(self.page[q], q + 1)
            if close < 0:
                return end + 1  # a quote that is never closed is a character like others
            at = close + 1

    def element_end(self, name: str, at: int) -> int:
        """Behind the end tag of an element whose content is no markup; -1 if there is none."""
        start = self.find(f"</{name}", at, self.lower)
        return -1 if start < 0 else max(start + 2 + len(name), self.end_of_tag(start + 2))

    def next(self, at: int) -> tuple[int, int, str, str]:
        """start, end, kind or name (with / in front for an end tag), attributes of the next tag; start -1 if none is left."""
        page = self.page
        while True:
            start = self.find("<", at)
            if start < 0:
                return -1, -1, "", ""
            if page.startswith("<!--", start):
                end = self.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, "!", ""
            if page.startswith("<![CDATA[", start) and (end := self.find("]]>", start)) >= 0:
                return start, end + 3, "cdata", page[start + 9 : end]
            if page[start + 1 : start + 2] in ("!", "?"):
                end = self.find(">", start)
                if end >= 0:
                    return start, end + 1, "!", ""
            elif (m := NAME.match(page, start + 1)) and (end := self.end_of_tag(m.end())) >= 0:
                return start, end, m[0].lower(), page[m.end() : end - 1]
            at = start + 1


def _heading(name: str) -> bool:
    return len(name) == 2 and name[0] == "h" and name[1].isdigit()


def blocks_of(page: str) -> list[Block]:
    """The flat blocks of a page in order. place: 1 in an article, -1 in a menu, footer ..., else 0."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, int]] = [("", 0)]  # element, place
    depth: Counter = Counter()  # of each element on the stack
    scanner = Scanner(page)

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
            if text:
                linked = sum(len(html.unescape(p).split()) for p, in_link in parts if in_link)
                heading = any(depth[f"h{i}"] for i in range(1, 7))
                out.append(Block(text, len(text.split()), linked, stack[-1][1], heading))
            parts.clear()

    at, n = 0, len(page)
    while at < n:
        start, end, name, attributes = scanner.next(at)
        raw = page[at : start if start >= 0 else n]
        if raw.strip() or raw and parts:
            parts.append((raw, depth["a"] > 0))
        if start < 0:
            break
        at = end
        if name == "cdata":
            parts.append((html.escape(attributes), depth["a"] > 0))
        elif name == "br":
            parts.append((" ", depth["a"] > 0))
        elif name in ("!", "/br"):
            pass
        elif name in VOID:
            if name not in INLINE:
                flush()
        elif name[0] == "/":
            name = name[1:]
            if name not in INLINE:
                flush()
            if depth[name]:
                # an inline element doesn't end the blocks in it
                k = len(stack) - 1
                while stack[k][0] != name and not (name in INLINE and stack[k][0] not in INLINE):
                    k -= 1
                if stack[k][0] == name:
                    depth.subtract(x for x, _ in stack[k:])
                    del stack[k:]
        elif name in SKIPPED:
            if not attributes.endswith("/"):
                close = scanner.element_end(name, at)
                at = close if close >= 0 else n if name in ("script", "style", "textarea") else at
        else:
            if name not in INLINE:
                flush()
                shut = CLOSED_BY_SIBLING.get(name, ())
                while len(stack) > 1 and (stack[-1][0] in shut or stack[-1][0] in INLINE or (stack[-1][0] == "p" and name in CLOSES_P)):
                    depth[stack.pop()[0]] -= 1
            place = stack[-1][1]
            if name not in INLINE:
                words = " ".join(x.strip("\"'") for x in ATTRS.findall(attributes[:2000])) if attributes else ""
                if name in OTHER_TAGS and not (name in ("header", "address") and place > 0) or words and OTHER_WORDS.search(words):
                    place = -1
                elif place >= 0 and (name in MAIN_TAGS or words and MAIN_WORDS.search(words)):
                    place = 1
            if len(stack) < DEEPEST:
                stack.append((name, place))
                depth[name] += 1
    flush()
    return out


#: Features: words, link density, words and link density before, the same after, heading; then the
#: minor ones: place, and whether the page has an article.
FEATURES, MINOR = 9, (7, 8)
#: So many levels of the tree do without the minor features.
FIRST = 3


def features(blocks: list[Block]) -> list[tuple[float, ...]]:
    none = (0, 0.0)
    own = [none, *((b.words, min(1.0, b.linked / b.words)) for b in blocks), none]
    marked = float(any(b.place > 0 for b in blocks))
    return [(*own[i + 1], *own[i], *own[i + 2], float(b.heading), b.place, marked) for i, b in enumerate(blocks)]


#: Blocks of real pages: words, link density, the same before and after, heading, then 1 for main text.
REAL = [
    # a menu
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0),
    (1, 1.0, 1, 1.0, 8, 0.0, 0, 0),
    (1, 1.0, 1, 1.0, 4, 0.0, 0, 0),
    # an advert behind it
    (8, 0.0, 1, 1.0, 6, 0.0, 0, 0),
    (4, 0.0, 1, 1.0, 11, 0.0, 0, 0),
    (8, 0.0, 1, 1.0, 14, 0.0, 0, 0),
    # the heading of an article
    (6, 0.0, 8, 0.0, 13, 0.0, 1, 1),
    (11, 0.0, 4, 0.0, 23, 0.0, 1, 1),
    (14, 0.0, 8, 0.0, 35, 0.0, 1, 1),
    # its paragraphs
    (13, 0.0, 6, 0.0, 68, 0.0, 0, 1),
    (68, 0.0, 13, 0.0, 92, 0.0, 0, 1),
    (92, 0.0, 68, 0.0, 98, 0.0, 0, 1),
    (98, 0.0, 92, 0.0, 26, 0.0, 0, 1),
    (26, 0.0, 98, 0.0, 8, 0.0, 0, 1),
    (8, 0.0, 26, 0.0, 11, 0.0, 0, 1),
    (11, 0.0, 8, 0.0, 49, 0.0, 0, 1),
    (49, 0.0, 11, 0.0, 61, 0.0, 0, 1),
    (61, 0.0, 49, 0.0, 1, 0.0, 0, 1),
    (1, 0.0, 61, 0.0, 1, 0.0, 0, 1),
    (1, 0.0, 1, 0.0, 48, 0.0, 0, 1),
    (4, 0.0, 34, 0.0, 15, 0.0, 0, 1),
    (2, 0.0, 64, 0.0, 5, 0.0, 0, 1),
    (5, 0.0, 2, 0.0, 48, 0.0, 0, 1),
    (23, 0.0, 11, 0.0, 58, 0.0, 0, 1),
    (58, 0.0, 23, 0.0, 15, 0.0, 0, 1),
    (35, 0.0, 14, 0.0, 17, 0.0, 0, 1),
    (5, 0.0, 41, 0.0, 11, 0.0, 0, 1),
    (143, 0.0, 49, 0.0, 11, 0.0, 0, 1),
    # a footer
    (11, 0.0, 5, 0.0, 0, 0.0, 0, 0),
    (15, 0.0, 58, 0.0, 0, 0.0, 0, 0),
    (11, 0.0, 143, 0.0, 0, 0.0, 0, 0),
]
#: Neighbours (words, link density) as they occur anywhere on a page.
AROUND = [(0, 0.0), (1, 1.0), (2, 0.0), (8, 0.0), (9, 0.6), (40, 0.0), (150, 0.02)]
#: Blocks (words, link density, heading) as they occur anywhere on a page that marks its article.
ANYWHERE = [(1, 0.0, 0), (1, 1.0, 0), (6, 0.0, 1), (9, 0.5, 0), (30, 0.0, 0), (150, 0.02, 0)]
#: The labelled table: the features, then 1 for main text. Blocks of real pages without what the markup
#: says; blocks of any kind on pages that mark their article; blocks of pages that don't.
LABELLED = [
    *((*r[:7], 0, 0, r[7]) for r in REAL),
    *((*r[:7], place, 1, int(place > 0)) for r in REAL for place in (-1, 0, 1)),
    *((w, d, *before, *after, heading, place, 1, int(place > 0)) for w, d, heading in ANYWHERE for before in AROUND for after in AROUND for place in (-1, 0, 1)),
    *((w, d, *before, *after, heading, -1, 0, 0) for w, d, heading in ANYWHERE for before in AROUND[1::3] for after in AROUND[::3]),
    (1, 1.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0),
    (2, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0),
    (5, 0.9, 3, 1.0, 80, 0.0, 0, 0, 0, 0),
    (4, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0),
    (6, 0.0, 4, 0.0, 5, 0.9, 0, 0, 0, 0),
    (3, 0.0, 0, 0.0, 2, 0.9, 0, 0, 0, 0),
    (9, 0.6, 70, 0.0, 2, 1.0, 0, 0, 0, 0),
    (6, 0.0, 90, 0.0, 0, 0.0, 0, -1, 0, 0),
    (40, 0.0, 3, 1.0, 60, 0.0, 0, -1, 0, 0),
    (12, 0.0, 5, 0.0, 3, 0.9, 0, -1, 0, 0),
    (2, 1.0, 3, 0.9, 4, 0.8, 0, -1, 0, 0),
    (7, 0.0, 2, 1.0, 60, 0.0, 1, 0, 0, 1),
    (5, 0.0, 60, 0.0, 60, 0.0, 1, 0, 0, 1),
    (60, 0.0, 7, 0.0, 80, 0.05, 0, 0, 0, 1),
    (80, 0.05, 60, 0.0, 40, 0.0, 0, 0, 0, 1),
    (25, 0.0, 80, 0.0, 6, 0.6, 0, 0, 0, 1),
    (4, 0.0, 60, 0.0, 70, 0.0, 0, 0, 0, 1),
    (18, 0.1, 30, 0.0, 25, 0.0, 0, 0, 0, 1),
    (14, 0.0, 6, 0.0, 18, 0.0, 0, 0, 0, 1),
    (16, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1),
]


def grow(rows: list[tuple[float, ...]], depth: int = 14, level: int = 0) -> tuple | int:
    """A tree by Gini impurity: (feature, threshold, at most, above) or a label; ties go to the lower feature."""
    ones = sum(int(r[-1]) for r in rows)
    label = int(2 * ones >= len(rows))
    if level >= depth or ones in (0, len(rows)):
        return label
    best = None
    for f in (f for f in range(FEATURES) if level >= FIRST or f not in MINOR):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            cut = (a + b) / 2
            score = 0.0
            for side in ([r for r in rows if r[f] <= cut], [r for r in rows if r[f] > cut]):
                p = sum(int(r[-1]) for r in side) / len(side)
                score += len(side) * p * (1 - p)
            if best is None or score < best[0] - 1e-9:
                best = (score, f, cut)
    if best is None:
        return label
    _, f, cut = best
    return f, cut, grow([r for r in rows if r[f] <= cut], depth, level + 1), grow([r for r in rows if r[f] > cut], depth, level + 1)


def predict(tree: tuple | int, row: tuple[float, ...]) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str, tree: tuple | int) -> str:
    blocks = blocks_of(page)
    return "\n\n".join(b.text for b, x in zip(blocks, features(blocks), strict=True) if predict(tree, x))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: list[tuple] | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row; one pass, no shuffle."""
    tree = grow(labelled or LABELLED)

    def make():
        def work(texts: list[str]) -> dict:
            out = [main_text(t, tree) for t in texts]
            return {"text": out, "n_chars": [len(t) for t in out]}

        return work

    return map_texts(pages, html_col, {"page_id": f"`{id_col}`", "url": f"`{url_col}`"}, "text string, n_chars long", make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
