"""Main text of web pages by tree scoring.

A page becomes a tree in page order. Every block with text of its own passes points to its ancestors: for its length and its commas,
in full to the parent, half to the next, less further up. A container's points, plus a bonus or malus for its tag and class, are
discounted by its link density; the best container is kept, with those siblings that score or read like text. Menus, headers, footers,
sidebars, notices, adverts, forms, reader comments and everything invisible never count and never come out. Inside an ``article`` or
``main`` element the whole element is the container, so that its heading stays with its paragraphs. If class names leave nothing or very
little of a page, it is scored again with them as a malus only.

Broken markup (open paragraphs, missing or stray end tags, deep nesting, cut pages) is read like browsers read it, in time in proportion to
the page. Each page is one row of an Arrow batch
and needs a few times its own size; nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession

from .common import by_value, only, table

by_value(__name__)

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
TEXTS = frozenset(("article", "main"))
ENTRIES = frozenset(("li",))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open element of the listed kinds.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "body": ("head",),
}
#: An open element of these kinds shelters those around it from such closing and from stray end tags.
SHELTER = frozenset("table ul ol dl article main section body html div".split())

NEVER = frozenset("head nav aside footer menu dialog button select datalist canvas object audio video applet search".split())
_BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|"
    r"newsletter|subscribe|subscription|signup|login|share|sharing|social|comments?|commentlist|disqus|respond|repl(?:y|ies)|sidebar|widgets?|"
    r"related|recommend\w*|breadcrumbs?|menu|navbar|nav|navigation|footer|masthead|topbar|toolbar|pagination|pager|disclaimer|copyright|"
    r"hidden|search|form)(?:$|[\s_-])",
    re.I,
)
_HEADER = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
#: Classes that tell what a page has or is filed under, not what the element is.
_ASIDE = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without|category|tag)[-_]\S*", re.I)
#: A text shorter than this is weighed again with class rules as a malus; the second reading counts if it is so many times longer.
LITTLE = 200
LONGER = 4
_GOOD = re.compile(r"article|body|content|entry|main|page|post|text|story", re.I)
_BAD_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog form menu menubar toolbar".split())
_BASE = {"div": 5, "article": 25, "main": 15, "section": 5, "body": 0, "td": 3, "pre": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "form": -3, "th": -5}
_CONTAINERS = frozenset("article main section div body td html center pre blockquote figure".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|[^>]*(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Page:
    """The tree of a page as lists in page order; ``runs`` are its texts with the element each stands in."""

    def __init__(self, source: str):
        self.tag, self.parent, self.attributes = ["#"], [0], [""]
        self.end: list[int] = [0]
        self.runs: list[tuple[int, bool, str]] = []
        self.first_run: list[int] = [0]
        self.end_run: list[int] = [0]
        open_: list[int] = [0]
        count: dict[str, int] = {}  # open elements of each kind, so that a stray end tag costs one look
        glued = False
        at = 0
        size = len(source)

        def text(piece):
            nonlocal glued
            if piece:
                self.runs.append((open_[-1], glued, html.unescape(piece) if "&" in piece else piece))
                glued = True

        def close(depth):
            nonlocal glued
            for node in open_[depth:]:
                self.end[node], self.end_run[node] = len(self.tag), len(self.runs)
                count[self.tag[node]] -= 1
                glued = glued and self.tag[node] not in BLOCK
            del open_[depth:]

        def close_open(kinds):
            if not any(count.get(k) for k in kinds):
                return
            for depth in range(len(open_) - 1, 0, -1):
                kind = self.tag[open_[depth]]
                if kind in kinds:
                    close(depth)
                    return
                if kind in SHELTER:
                    return

        while at < size:
            start = source.find("<", at)
            if start < 0:
                text(source[at:])
                break
            found = _TOKEN.match(source, start)
            if not found:  # a lone sign
                nxt = source.find("<", start + 1)
                nxt = size if nxt < 0 else nxt
                text(source[at:nxt])
                at = nxt
                continue
            text(source[at:start])
            at = found.end()
            if found[1]:
                name = found[1].lower()
                if name == "br":
                    glued = False
                    continue
                if not count.get(name):
                    glued = glued and name != "p"
                    continue
                for depth in range(len(open_) - 1, 0, -1):
                    kind = self.tag[open_[depth]]
                    if kind == name:
                        close(depth)
                        break
                    if kind in SHELTER and name not in SHELTER:
                        break
            elif found[2]:
                name, rest = found[2].lower(), found[3] or ""
                if name in CLOSES:
                    close_open(CLOSES[name])
                if name in BLOCK:
                    close_open(("p",))
                    glued = False
                if name in ("html", "body") and name in self.tag:
                    continue
                if name in VOID:
                    glued = glued and name not in ("br", "hr")
                    continue
                node = len(self.tag)
                self.tag.append(name)
                self.parent.append(open_[-1])
                self.attributes.append(rest)
                self.end.append(node + 1)
                self.first_run.append(len(self.runs))
                self.end_run.append(len(self.runs))
                if name in RAW:
                    stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)|</{re.escape(name)}\Z", re.I).search(source, at)
                    at = stop.end() if stop else size
                elif not rest.endswith("/") or name in BLOCK or name in ("a", "span", "b", "i", "em", "strong"):
                    open_.append(node)
                    count[name] = count.get(name, 0) + 1
        close(1)
        self.end[0], self.end_run[0] = len(self.tag), len(self.runs)
        self.before: dict[frozenset, list[int]] = {}

    def attribute(self, node: int) -> dict[str, str]:
        raw = self.attributes[node]
        if not raw.strip(" /"):
            return {}
        return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}

    def inside(self, node: int, kinds: frozenset) -> int:
        """How many elements of some kinds an element holds; counted once for the whole page."""
        sums = self.before.get(kinds)
        if sums is None:
            sums = self.before[kinds] = [0, *accumulate(tag in kinds for tag in self.tag)]
        return sums[self.end[node]] - sums[node + 1]

    def holds(self, node: int, kinds: frozenset) -> bool:
        return self.inside(node, kinds) > 0


def _left_out(page: Page, strict: bool) -> tuple[list[bool], list[float]]:
    """Which elements never count, and the bonus of every element's class and tag; unless ``strict``, a class leaves nothing out."""
    out, bonus = [False], [0.0]
    within, nested = [False], [False]
    for node in range(1, len(page.tag)):
        name, parent = page.tag[node], page.parent[node]
        within.append(within[parent] or name in ("article", "main"))
        nested.append(nested[parent] or name == "article")  # inside an article or a section of bad class
        points = float(_BASE.get(name, -5 if name in HEADINGS else 0))
        bad = out[parent] or name in RAW or name in NEVER
        if not bad and name == "header":
            bad = not (within[parent] and page.holds(node, HEADINGS))
        if not bad and name in ("form", "fieldset"):
            bad = not page.holds(node, TEXTS)
        if not bad:
            held = page.attribute(node)
            marks = _ASIDE.sub("", f"{held.get('class', '')} {held.get('id', '')}")
            if marks != " " and name in BLOCK | {"span", "a"} and name not in ("html", "body", "article", "main"):
                if _BAD.search(marks):
                    bad = strict and not page.holds(node, TEXTS) and name not in HEADINGS
                    points -= 25
                    nested[node] = True
                elif _HEADER.search(marks):
                    bad = strict and not page.holds(node, TEXTS) and name not in HEADINGS
                    bad = bad and not (within[parent] and page.holds(node, HEADINGS))
                    points -= 25
                elif _GOOD.search(marks):
                    points += 25
            elif name == "article" and _BAD.search(marks):
                bad = strict and nested[parent]  # a reader's comment or a teaser
                points -= 25
            bad = bad or "hidden" in held or held.get("aria-hidden") == "true" or bool(_HIDDEN.search(held.get("style", "")))
            bad = bad or held.get("role", "").lower() in _BAD_ROLES and not page.holds(node, TEXTS)
        out.append(bad)
        bonus.append(points)
    return out, bonus


def main_text(source: str) -> str:
    """The main text of one page: blocks in page order joined by one space, empty if there is none."""
    page = Page(source)
    text = _scored(page, True)
    if len(text) < LITTLE:
        again = _scored(page, False)
        text = again if len(again) >= max(1, LONGER * len(text)) else text
    return text


def _scored(page: Page, strict: bool) -> str:
    n = len(page.tag)
    out, bonus = _left_out(page, strict)
    size, linked = [0] * n, [0] * n  # characters inside each element, and those of links
    block, link = [0] * n, [False] * n  # the nearest block; whether inside a link
    for node in range(1, n):
        parent = page.parent[node]
        block[node] = node if page.tag[node] in BLOCK else block[parent]
        link[node] = link[parent] or page.tag[node] == "a"
    own, commas, own_linked = [0] * n, [0] * n, [0] * n
    for node, _, text in page.runs:
        if out[node]:
            continue
        length = len(" ".join(text.split()))
        size[node] += length
        linked[node] += length if link[node] else 0
        own[block[node]] += length
        commas[block[node]] += text.count(",") + text.count("、") + text.count("，")
    for node in range(n - 1, 0, -1):
        size[page.parent[node]] += size[node]
        linked[page.parent[node]] += linked[node]
    if not size[0]:
        return ""
    _drop_menus(page, out, size, linked)
    density = lambda node: linked[node] / size[node] if size[node] else 0.0
    score = [0.0] * n
    for node in range(1, n):
        if not own[node] or out[node] or page.tag[node] in HEADINGS:
            continue
        points = (min(1.0, own[node] / 25) + commas[node] + min(own[node] / 100, 3.0)) * (1 - density(node))
        target = page.parent[node] if page.tag[node] not in _CONTAINERS else node
        for level in range(5):
            if not target:
                break
            score[target] += points / (1, 2, 6, 9, 12)[level]
            target = page.parent[target]
    best, top = 0, float("-inf")
    for node in range(1, n):
        if page.tag[node] in _CONTAINERS and size[node] and not out[node]:
            value = (score[node] + bonus[node]) * (1 - density(node))
            score[node] = value
            if value > top:
                best, top = node, value
    if not best:
        return _text(page, out, [0])
    around = best
    while around and page.tag[around] not in ("article", "main"):
        around = page.parent[around]
    if around:
        return _text(page, out, [around])
    parent = page.parent[best]
    chosen = []
    sibling = parent + 1
    while sibling < page.end[parent]:
        if sibling == best:
            chosen.append(sibling)
        elif not out[sibling] and size[sibling]:
            reads = page.tag[sibling] in HEADINGS | {"p", "pre", "blockquote"} and density(sibling) < 0.25
            if score[sibling] >= max(10.0, 0.2 * top) or reads:
                chosen.append(sibling)
        sibling = page.end[sibling]
    return _text(page, out, chosen)


def _drop_menus(page: Page, out: list[bool], size: list[int], linked: list[int]) -> None:
    """Lists of three or more short entries that are nothing but links count as menus.

    Inside an article only a list ahead of all its text does; one below a heading or a paragraph is part of what is told.
    """
    around = [0] * len(page.tag)  # the article around each element
    before = [0, *accumulate(0 if out[node] else len(text.strip()) for node, _, text in page.runs)]
    for node in range(1, len(page.tag)):
        around[node] = node if page.tag[node] in TEXTS else around[page.parent[node]]
        if page.tag[node] in ("ul", "ol") and not out[node] and size[node] and linked[node] == size[node]:
            entries = page.inside(node, ENTRIES)
            told = around[node] and before[page.first_run[node]] > before[page.first_run[around[node]]]
            if entries >= 3 and size[node] / entries <= 40 and not told:
                for k in range(node, page.end[node]):
                    out[k] = True


def _text(page: Page, out: list[bool], nodes: list[int]) -> str:
    parts = []
    for node in nodes:
        parts.append(" ")
        for where, glued, text in page.runs[page.first_run[node] : page.end_run[node]]:
            if not out[where]:
                parts.append(text if glued else " " + text)
            elif not glued:
                parts.append(" ")
    return " ".join("".join(parts).split())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` per row, over the whole page.

    Null pages count as empty and have an empty text. Repeated rows come out each. A page without elements is one block of text.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(x or "") for x in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    rows = only(pages, page_id=id_col, url=url_col, html=html_col).selectExpr("cast(page_id as long) page_id", "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
