"""Word boxes, pages and downloads as tables."""

from __future__ import annotations

import importlib
import os
import ssl
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as T
from ..shared import ship

WORDS = "doc_id string, page int, word_no int, text string, x0 double, x1 double, top double, bottom double, size double, fontname string, upright boolean"
PAGES = "doc_id string, page int, width double, height double, n_images int, n_rects int, n_lines int, n_curves int, raw_text string"
TABLES = "doc_id string, page int, table_no int, rows array<array<string>>, bbox struct<x0: double, top: double, x1: double, bottom: double>"


class _Part(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict, width: int):
        self.options, self.width = options, width

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in self.options.get("paths", self.options.get("path", "")).split(",") if p]

    def read(self, part: _Part) -> Iterator[tuple]:
        module, _, name = self.options["parser"].partition(":")
        parse = getattr(importlib.import_module(module), name)
        more = {k: v for k, v in (("attributes", self.options.get("attributes")),) if v}
        try:
            rows = list(parse(part.path, **more)) if more else parse(part.path)
        except Exception:
            if not more:
                raise
            rows = parse(part.path)  # a parser that can't give the wanted attributes gives words without them
        for r in rows:
            yield (*r, *[None] * (self.width - len(r)))


def _source(kind: str, ddl: str) -> type[DataSource]:
    """spark.read.format('lectern_<kind>'): parser='module:function' turns a path into tuples; a partition a file, missing last columns are null."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"lectern_{kind}"

        def schema(self) -> str:
            return ddl

        def reader(self, schema) -> DataSourceReader:
            return _Reader(self.options, len(schema.fields))

    return Source


WordSource, PageSource, TableSource = _source("words", WORDS), _source("pages", PAGES), _source("tables", TABLES)


def register(spark: SparkSession) -> None:
    ship(spark)
    for source in (WordSource, PageSource, TableSource):
        spark.dataSource.register(source)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """path, content, kind of the files below a path."""
    return spark.read.format("binaryFile").load(path).select("path", "content", T.content_kind(F.col("content"), F.lit("")).alias("kind"))


def borderless_fallback(ruled: DataFrame, borderless: DataFrame) -> DataFrame:
    """Ruled tables, and the borderless ones of pages without any."""
    return ruled.unionByName(borderless.join(ruled.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti"))


class AccessError(Exception):
    """The server refuses: 401 or 403."""


def tls_context(insecure: bool = False, ca_bundle: str | None = None) -> ssl.SSLContext:
    """No checks if insecure; else the given bundle, the system's trust store, a bundle that is installed, or the default."""
    if insecure:
        out = ssl.create_default_context()
        out.check_hostname, out.verify_mode = False, ssl.CERT_NONE
        return out
    if ca_bundle:
        return ssl.create_default_context(cafile=ca_bundle)
    for module, context in (("truststore", lambda m: m.SSLContext(ssl.PROTOCOL_TLS_CLIENT)), ("certifi", lambda m: ssl.create_default_context(cafile=m.where()))):
        try:
            return context(importlib.import_module(module))
        except (ImportError, OSError):
            continue
    return ssl.create_default_context()


def fetch(url: str, timeout: float = 30, insecure: bool = False, ca_bundle: str | None = None, most: int = 25 << 20) -> tuple[str, str, bytes]:
    """Final URL, content type, bytes; more than most bytes is an error."""
    ask = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0 (compatible; lectern)", "Accept": "text/html,application/pdf,*/*"})
    try:
        with urllib.request.urlopen(ask, timeout=timeout, context=tls_context(insecure, ca_bundle)) as r:
            held = bytearray()
            while piece := r.read(1 << 16):
                held += piece
                if len(held) > most:
                    raise ValueError(f"{url} is larger than {most} bytes")
            return r.geturl(), r.headers.get("Content-Type", ""), bytes(held)
    except urllib.error.HTTPError as e:
        if e.code in (401, 403):
            raise AccessError(f"{url}: access denied ({e.code}); save the page and pass the file") from e
        raise
    except urllib.error.URLError as e:
        if isinstance(e.reason, ssl.SSLError):
            raise ConnectionError(f"{url}: the certificate can't be verified; pass a CA bundle") from e
        raise


def fetched(urls: DataFrame, url_col: str = "url", **options) -> DataFrame:
    """url, final_url, content_type, content, error: one request a row, spread by URL."""

    def each(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for u in b["url"]:
                try:
                    rows.append((u, *fetch(u, **options), None))
                except Exception as e:  # a page that fails must not end the job
                    rows.append((u, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["url", "final_url", "content_type", "content", "error"])

    ship(urls.sparkSession)
    clean = urls.select(T.clean_url(F.col(url_col)).alias("url")).dropna().distinct()
    return clean.mapInPandas(each, "url string, final_url string, content_type string, content binary, error string")


def file_name(url: str) -> str:
    name = urllib.parse.unquote(urllib.parse.urlparse(url).path.rsplit("/", 1)[-1]) or "download"
    return name if name.lower().endswith(".pdf") else f"{name}.pdf"


def require_pdf(data: bytes, content_type: str = "") -> bytes:
    if data[:5] != b"%PDF-" and "pdf" not in content_type.lower():
        raise ValueError(f"not a PDF (content type {content_type or 'unknown'})")
    return data


def download(url: str, folder: str, **options) -> str:
    """Save the PDF at a URL below folder; its path."""
    _, kind, data = fetch(url, **options)
    to = os.path.join(folder, file_name(url))
    with open(to, "wb") as f:
        f.write(require_pdf(data, kind))
    return to


@contextmanager
def spooled(data: bytes, folder: str, suffix: str = ".pdf") -> Iterator[str]:
    """Path of a file below a folder that all executors share, as long as it is needed."""
    to = os.path.join(folder.removeprefix("file://").removeprefix("file:"), f"lectern-{uuid.uuid4().hex}{suffix}")
    with open(to, "wb") as f:
        f.write(data)
    try:
        yield to
    finally:
        os.remove(to)


class Ocr(Protocol):
    """Reads the text of a page's image; instances are pickled to the executors."""

    def text(self, image: bytes, dpi: int) -> str: ...


def with_ocr(pages: DataFrame, images: DataFrame, ocr: Ocr | None, mode: str = "off", dpi: int = 150) -> DataFrame:
    """pages (with is_scanned) with ocr_text and ocr_warning; images: doc_id, page, image. Only scanned pages are read, and only if mode is 'detect'."""
    if mode != "detect":
        return pages.withColumns({"ocr_text": F.lit(None).cast("string"), "ocr_warning": F.lit(None).cast("string")})
    if ocr is None:
        return pages.withColumns({"ocr_text": F.lit(None).cast("string"), "ocr_warning": F.when(F.col("is_scanned"), "ocr_unavailable")})

    def each(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for d, p, image in zip(b["doc_id"], b["page"], b["image"], strict=True):
                try:
                    rows.append((d, p, ocr.text(bytes(image), dpi), None))
                except Exception as e:  # a page that can't be read must not end the job
                    rows.append((d, p, None, f"ocr_failed: {type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "ocr_text", "ocr_warning"])

    ship(pages.sparkSession)
    scanned = pages.where("is_scanned").select("doc_id", "page")
    found = images.join(scanned, ["doc_id", "page"]).select("doc_id", "page", "image").mapInPandas(each, f"doc_id {images.schema['doc_id'].dataType.simpleString()}, page int, ocr_text string, ocr_warning string")
    out = pages.join(found, ["doc_id", "page"], "left")
    none = F.col("is_scanned") & F.col("ocr_text").isNull() & F.col("ocr_warning").isNull()
    return out.withColumn("ocr_warning", F.when(none, "ocr_no_image").otherwise(F.col("ocr_warning")))
