"""HTML pages as ordered blocks, and raw bytes as text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import Protocol
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import ship

SCHEMA = "doc_id long, pos int, kind string, text string"
# Elements left out, elements taken whole, and what closes an open element.
JUNK = frozenset(("script", "style", "nav", "header", "footer", "aside"))
WHOLE = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
CLOSES_P = WHOLE - {"td"} | {"div", "ul", "ol", "table", "section", "article", "blockquote", "form", "pre", "main", "nav", "header", "footer", "aside", "hr"}


class _Blocks(HTMLParser):
    """Collects (kind, text) in document order: whole elements with all their text, div with its direct text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[list] = []
        self.open: list[tuple[str, list | None]] = []
        self.junk = 0

    def _close(self, i: int) -> None:
        for tag, _ in self.open[i:]:
            self.junk -= tag in JUNK
        del self.open[i:]

    def handle_starttag(self, tag, attrs) -> None:
        if tag in VOID:
            return
        names = [t for t, _ in self.open]
        if tag in CLOSES_P and "p" in names:
            self._close(len(names) - 1 - names[::-1].index("p"))
        elif tag in ("li", "td", "th", "tr") and tag in names:
            at = len(names) - 1 - names[::-1].index(tag)
            if not {"ul", "ol", "table"} & set(names[at + 1 :]):
                self._close(at)
        mine: list | None = None
        inside = any(t in WHOLE for t, _ in self.open)
        if not self.junk and not inside and (tag in WHOLE or tag == "div"):
            mine = ["heading" if re.fullmatch("h[1-6]", tag) else "body", []]
            self.out.append(mine)
        self.junk += tag in JUNK
        self.open.append((tag, mine))

    def handle_endtag(self, tag) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._close(i)
                return

    def handle_data(self, data) -> None:
        if self.junk or not self.open:
            return
        whole = next((b for t, b in self.open if t in WHOLE and b is not None), None)
        if whole is not None:
            whole[1].append(data)
        elif self.open[-1][0] == "div" and self.open[-1][1] is not None:
            self.open[-1][1][1].append(data)


def walk(html: str) -> list[tuple[str, str]]:
    p = _Blocks()
    p.feed(html)
    p.close()
    found = [(kind, " ".join(" ".join(x.split()) for x in parts if x.strip())) for kind, parts in p.out]
    return [(k, t) for k, t in found if t]


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """doc_id, pos, kind, text of each page's blocks. One Arrow pass; no shuffle."""

    ship(pages.sparkSession)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, k, t) for i, h in zip(b["doc_id"], b["html"], strict=True) if isinstance(h, str) for n, (k, t) in enumerate(walk(h))]
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "kind", "text"])

    return pages.select(F.col(id_col).cast("long").alias("doc_id"), F.col(html_col).alias("html")).mapInPandas(each, SCHEMA)


def decode_bytes(data: pd.Series, content_type: pd.Series) -> pd.Series:
    """Bytes as text: the declared charset, one named in the first 2048 bytes, UTF-8, CP949, Latin-1."""

    def one(raw: bytes | None, kind: str | None) -> str | None:
        if raw is None:
            return None
        names = [m[1] for m in (re.search(r"charset=[\"']?\s*([\w-]+)", kind or "", re.I),) if m]
        names += [m[1].decode("ascii", "ignore") for m in (re.search(rb"charset=[\"']?\s*([\w-]+)", raw[:2048], re.I),) if m]
        for name in [*names, "utf-8", "cp949", "latin-1"]:
            try:
                return raw.decode(name)
            except (LookupError, UnicodeDecodeError):
                continue
        return raw.decode("utf-8", "replace")

    return pd.Series([one(a, b) for a, b in zip(data, content_type, strict=True)])


def decode(data: Column, content_type: Column) -> Column:
    """decode_bytes as a vectorized function of columns."""
    return F.pandas_udf(decode_bytes, "string")(data, F.coalesce(content_type, F.lit("")))


class Extractor(Protocol):
    """Finds a page's main content as XML of head, p, quote, item and row elements; None if there is none."""

    def extract(self, html: str, **options) -> str | None: ...


# What an extractor is asked for, until it accepts and finds something.
OPTIONS = (
    {"output_format": "xml", "include_tables": True, "include_comments": False, "favor_recall": True},
    {"output_format": "xml", "include_tables": True, "include_comments": False},
    {"output_format": "xml"},
)


def walk_xml(xml: str) -> list[tuple[str, str]]:
    """(kind, text) of an extractor's XML in order; a row's cells are joined. Nothing if it can't be parsed."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return []
    said = lambda e: " ".join("".join(e.itertext()).split())
    out, todo = [], [root]
    while todo:
        e = todo.pop()
        if e.tag == "head":
            out.append(("heading", said(e)))
        elif e.tag in ("p", "quote", "item"):
            out.append(("body", said(e)))
        elif e.tag == "row":
            out.append(("body", " | ".join(t for t in (said(c) for c in e if c.tag == "cell") if t)))
        else:
            todo.extend(reversed(e))
    return [(k, t) for k, t in out if t]


def main_content(html: str, extractor: Extractor) -> list[tuple[str, str]]:
    """Blocks by an extractor; options that it doesn't know are left out."""
    for options in OPTIONS:
        try:
            xml = extractor.extract(html, **options)
        except TypeError:
            continue
        if xml:
            return walk_xml(xml)
    return []


class LineBlocks:
    """The extractor that comes with the package: text-dense runs of the page's own blocks, by a window over their lengths."""

    def __init__(self, window: int = 3, share: float = 0.2):
        self.window, self.share = window, share

    def extract(self, html: str, **options) -> str | None:
        found = walk(html)
        size = [len(t) for _, t in found]
        sums = [sum(size[max(0, i - self.window // 2) : i + self.window // 2 + 1]) for i in range(len(size))]
        kept = [(k, t) for (k, t), s in zip(found, sums, strict=True) if s >= self.share * max(sums)]
        return "<main>" + "".join(f"<{'head' if k == 'heading' else 'p'}>{escape(t)}</{'head' if k == 'heading' else 'p'}>" for k, t in kept) + "</main>" if kept else None


def main_blocks(pages: DataFrame, extractor: Extractor, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """doc_id, pos, kind, text of each page's main content by an extractor."""
    ship(pages.sparkSession)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, k, t) for i, h in zip(b["doc_id"], b["html"], strict=True) if isinstance(h, str) for n, (k, t) in enumerate(main_content(h, extractor))]
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "kind", "text"])

    return pages.select(F.col(id_col).cast("long").alias("doc_id"), F.col(html_col).alias("html")).mapInPandas(each, SCHEMA)


class Renderer(Protocol):
    """Loads a page in a browser; the HTML of the page and then of its frames. Instances are pickled to the executors."""

    def render(self, url: str) -> list[str]: ...


def rendered(pages: DataFrame, renderer: Renderer, url_col: str = "url") -> DataFrame:
    """pages' columns with frames (array of HTML, the page first) and render_error."""
    ship(pages.sparkSession)

    def one(urls: pd.Series) -> pd.DataFrame:
        out = []
        for u in urls:
            try:
                out.append((renderer.render(u), None))
            except Exception as e:  # a page that can't be shown must not end the job
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["frames", "render_error"])

    shown = pages.withColumn("_shown", F.pandas_udf(one, "frames array<string>, render_error string")(F.col(url_col)))
    return shown.select(*pages.columns, "_shown.frames", "_shown.render_error")


def frame_blocks(pages: DataFrame, id_col: str = "page_id", frames_col: str = "frames") -> DataFrame:
    """doc_id, pos, kind, text: the blocks of a page and of its frames, one frame after another."""
    ship(pages.sparkSession)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, frames in zip(b["doc_id"], b["frames"], strict=True):
                found = [x for h in (frames if frames is not None else ()) if h for x in walk(h)]
                rows += [(i, n, k, t) for n, (k, t) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "kind", "text"])

    return pages.select(F.col(id_col).cast("long").alias("doc_id"), F.col(frames_col).alias("frames")).mapInPandas(each, SCHEMA)
