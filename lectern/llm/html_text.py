"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element, in page order. A line weighs as much as its text that is not
in links, and ``mark`` times that where the page marks it as article or main; menus, headers, footers, sidebars,
notices, adverts, forms and reader comments (by element, role, or a class or id all of whose words name a box or a
place) are no lines. Weights are summed over a window of ``window`` lines that slides over each container (an article,
or what lies between them). The largest sum tells whether the marks or the text around them hold the page's main text.

* In marked articles: a surge is a window in which text outweighs links. An article with a surge is main text from its
  first line to its last, as it says itself, however short; one without, or named as a box or inside one that is closed
  after it, is not (all of them if no other has a surge).
* In unmarked text, or where it outweighs the marked one by more than ``mark``: a surge is where the sum first rises over
  ``share`` of the largest sum, the dive that ends it is where the sum is back at nothing. Every line between is kept,
  lines of links too, but a stretch that is mostly links is not (all stretches if there are only such).

Broken markup: p, li, cells, options close their like; an end tag closes what is open inside it; a start of the
article closes unclosed boxes around it; quotes left open in a tag end with the tag.

Cases: null or empty html gives empty text; a page without markup is one block. Any length; nothing is capped.
Rows are judged by themselves and other columns are carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._run import Carried, ship

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>?",
    re.S,
)
ATTR = re.compile(r"([a-zA-Z][\w:-]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Elements by their part in a page, and words that name boxes around a main text.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math object audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
BOXES = frozenset("nav footer aside form menu dialog select button fieldset head datalist search".split())
CLOSES_P = BLOCK - frozenset("body html head caption tbody td tfoot th thead tr option optgroup legend summary".split())
LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}, "option": {"select"}}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
WORDS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer "
    "discussion disqus footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall "
    "popup promo promoted promotion promotions recommendation recommendations recommended related replies reply respond responses share sharing sidebar signup "
    "social sponsor sponsored subscribe subscription teaser toc toolbar topbar tracking widget widgets".split()
)
PLACES = frozenset(
    "site page main top bottom left right inner outer box block container wrapper wrap holder area list item items section panel bar group content module "
    "row col column unit slot primary secondary global local text title link links button buttons icon icons body nav menu header footer form count thread".split()
)
REMARKS = frozenset("comment comments discussion disqus replies reply respond responses".split())
STATES = frozenset("no not has with without is show hide js enable disable".split())


def _box(tag: str, attrs: str, inside: bool) -> str:
    """'' for an element that may hold main text, 'remark' for reader comments, else 'box'."""
    if tag in BOXES or tag == "header" and not inside:
        return "box"
    if not attrs or attrs.isspace() or tag in ("html", "body"):
        return ""
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" and value.lower() != "until-found" or name == "aria-hidden" and value.lower() == "true":
            return "box"
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "box"
        if name == "role" and value.lower() in ROLES:
            return "box"
        if name in ("class", "id", "aria-label", "itemprop", "data-role"):
            for one in value.split():
                words = WORD.findall(CAMEL.sub("-", one).lower())
                if not words or words[0] in STATES:
                    continue
                known = set(words) <= WORDS | PLACES | REMARKS  # related-work or share-price is no box
                if known and set(words) & REMARKS:
                    return "remark"
                if known and set(words) & WORDS or (words[-1] == "header" or words[0] == "header") and not inside and not {"article", "entry", "post", "story"} & set(words):
                    return "box"
    return ""


def lines(html: str, boxes: bool = True) -> tuple[list[tuple[str, int, int]], set[int]]:
    """Text, weight and article (0: none) of each line outside boxes, and the articles that are named as a box or lie in one.

    boxes: whether class words and elements make boxes.
    """
    out: list[tuple[str, int, int]] = []
    stack: list[tuple[str, str, int]] = []  # tag, box, article
    piece: list[str] = []
    boxed: set[int] = set()
    left: list[list] = []  # of boxes that an article closed: tag, open elements of that tag, first article
    linked = 0
    box, article, articles, anchors = "", 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(piece)).split()) if piece else ""
        if text:
            out.append((text, max(len(text) - linked, 0), article))
        piece.clear()
        linked = 0

    def pop_to(i: int) -> None:
        nonlocal box, article, anchors
        anchors -= sum(t == "a" for t, _, _ in stack[i:])
        if any(t in BLOCK for t, _, _ in stack[i:]):
            flush()
        del stack[i:]
        box, article = (stack[-1][1], stack[-1][2]) if stack else ("", 0)

    def text(s: str) -> None:
        nonlocal linked
        if s and not box:
            piece.append(s)
            if anchors:
                linked += len(" ".join(s.split()))

    at = 0
    while at < len(html):
        m = TOKEN.search(html, at)
        if not m:
            text(html[at:])
            break
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag, attrs, end = tag.lower(), m["attrs"] or m["attrs2"] or "", m["end"] or m["end2"]
        if end:
            if tag == "br":
                text(" ")
                continue
            for x in [x for x in left if x[0] == tag]:
                x[1] -= 1
                if not x[1]:  # it was not left open
                    left.remove(x)
                    boxed.update(range(x[2], articles + 1))
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
                if stack[i][0] in ("table", "article", "main") and tag not in BLOCK:
                    break
            else:
                if tag in BLOCK:
                    flush()
            continue
        if tag in RAW:
            if not attrs.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(html, at)
                at = close.start() if close else len(html) if tag in ("script", "style", "title", "textarea") else at
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                text(" ")
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop_to(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        if tag in LIKE:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in LIKE[tag]:
                    pop_to(i)
                    break
                if stack[i][0] in SCOPE[tag]:
                    break
        if tag in BLOCK and tag != "head" and any(t == "head" for t, _, _ in stack):
            pop_to(next(i for i, x in enumerate(stack) if x[0] == "head"))
        for x in left:
            x[1] += x[0] == tag
        kind = _box(tag, attrs, bool(article)) if boxes or tag == "head" else ""
        named = kind == "box"
        if tag in ("article", "main") and kind != "remark":
            kind = ""
            if box == "box" and not article:  # boxes left open
                i = next(i for i, x in enumerate(stack) if x[1])
                left.append([stack[i][0], sum(x[0] == stack[i][0] for x in stack[i:]), articles + 1])
                pop_to(i)
        if tag in BLOCK:
            flush()
        if tag == "a":
            anchors += 1
        box = box or kind
        if tag == "article" and not box and not (stack and any(t == "article" for t, _, _ in stack)) or tag == "main" and not box and not article:
            articles += 1
            article = articles if tag == "article" else -articles
            if named:
                boxed.add(articles)
        stack.append((tag, box, article))
    flush()
    return out, boxed


def _sums(weights: list[float], window: int) -> list[float]:
    """Of each line the weights of it and the lines after it, ``window`` in all."""
    run = [0]
    for w in weights:
        run.append(run[-1] + w)
    return [run[min(i + window, len(weights))] - run[i] for i in range(len(weights))]


def _stretches(weights: list[float], window: int, least: float) -> list[tuple[int, int]]:
    """First line and end of each stretch from a surge, a window's sum over ``least``, to its dive."""
    n, sums = len(weights), _sums(weights, window)
    out, i = [], 0
    while i < n:
        if sums[i] <= least or not weights[i]:
            i += 1
            continue
        a = i
        while a and weights[a - 1]:  # lines before the surge that touch it
            a -= 1
        while i < n and sums[i]:
            i += 1
        out.append((a, i))
    return out


def main_text(html: str, window: int = 3, share: float = 0.05, mark: float = 20.0) -> str:
    for boxes in (True, False):
        found, boxed = lines(html, boxes)
        marked = {a for _, _, a in found if a > 0} or {a for _, _, a in found if a < 0}
        runs: list[list[int]] = []  # container (0: none), first line, end
        for i, (_, _, a) in enumerate(found):
            a = a if a in marked else 0
            if runs and runs[-1][0] == a:
                runs[-1][2] = i + 1
            else:
                runs.append([a, i, i + 1])
        most = {True: 0.0, False: 0.0}  # the largest sum in and out of marked containers
        for a, i, z in runs:
            if abs(a) not in boxed:
                most[bool(a)] = max(most[bool(a)], *_sums([w * (mark if a else 1) for _, w, _ in found[i:z]], window))
        kept = []
        for a, i, z in runs:
            free, whole = [w for _, w, _ in found[i:z]], [len(t) for t, _, _ in found[i:z]]
            if a and abs(a) not in boxed and most[True] >= most[False]:
                kept += [(i, z)] * any(2 * f >= n for f, n in zip(_sums(free, window), _sums(whole, window), strict=True))
            elif a and abs(a) not in boxed:
                kept += [(i, z)] * (mark * max(_sums(free, window)) > share * most[False])
            elif not a and most[False] > most[True]:
                every = _stretches(free, window, share * most[False])
                kept += [(i + x, i + y) for x, y in every if 2 * sum(free[x:y]) >= sum(whole[x:y])] or [(i + x, i + y) for x, y in every] * (len(runs) == 1)
        kept = kept or [(i, z) for a, i, z in runs if a]
        if kept:
            return "\n\n".join(found[k][0] for i, z in kept for k in range(i, z))
    return ""


def _extract(options: dict):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [main_text(x or "", **options) for x in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["_row", "text", "n_chars"])

    return each


def extract_text(pages: DataFrame, html_col: str = "html", **options) -> DataFrame:
    """pages' columns but the html (and any named text or n_chars), with text and n_chars."""
    ship(pages.sparkSession)
    own = Carried(pages, ("text", "n_chars"), (html_col,))
    found = pages.select(F.col(html_col).alias("_html"), own.packed).mapInArrow(_extract(options), own.schema(("text", "string"), ("n_chars", "long")))
    return own.unpacked(found, "text", "n_chars")
