"""Language of web pages by Bayesian evidence fusion.

Four kinds of evidence give each language a likelihood or prior:

* text: naive Bayes over hashed byte trigrams of the page's main text, tempered to ``evidence`` trigrams at most, as
  neighbouring trigrams are not independent. The tables are fitted to a bounded sample of labelled texts.
* markup: the language the page declares (html lang, or the meta element of it).
* address: the language code in the URL (a path segment, a leading label of the host, or a country suffix).
* host: how often its other pages are in each language, smoothed towards its domain's shares and these towards all
  pages', each by a number of pseudo-pages. The page's own part is taken out first.

How far markup and address are to be believed is estimated from all pages: grouped sums of the text's posterior by
declared code. All sums are grouped aggregations; hosts and domains only ever are keys of such tables.

Cases: pages of any length; null html, URL or text give no evidence of that kind (an unknown declared code counts as none); without any, the
prior of all pages decides. Equal posteriors go to the code that sorts first. Rows are judged each, other columns of pages aren't looked at; an empty table gives
an empty result. Without labelled texts it raises ValueError.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._run import Carried, cut, lean, ship
from .html_text import main_text

U = np.uint64
BITS = 15
CHUNK = 1 << 18  # bytes of text at once; there is a trigram a byte
DECLARED = re.compile(r"<html\b[^>]*?\slang\s*=\s*[\"']?\s*([a-zA-Z]{2,3})\b", re.I)
META = re.compile(r"<meta\b(?=[^>]*content-language)[^>]*?content\s*=\s*[\"']?\s*([a-zA-Z]{2,3})\b", re.I)


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each three bytes of a row, A-Z as a-z and what is between words as one kind of byte."""
    inside, _ = W.ALNUM.tables()
    x = np.where(inside[data], data, 32).astype(U)
    x[(x >= 65) & (x <= 90)] += U(32)
    if len(x) < 3:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    code = (x[:-2] << U(16)) | (x[1:-1] << U(8)) | x[2:]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ok = (row[:-2] == row[2:]) & (code != U(0x202020))
    return row[:-2][ok], (W.mix(code[ok]) >> U(64 - BITS)).astype(np.int64)


def _tally(languages: list[str]):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: i for i, x in enumerate(languages)}
        held = np.zeros((len(languages), 1 << BITS), dtype=np.int64)
        for b in batches:
            lang = np.array([place[x] for x in b.column(1).to_pylist()], dtype=np.int64)
            for row, _, data, offsets in W.chunks(b.column(0), CHUNK):
                doc, bucket = _trigrams(data, offsets)
                held += np.bincount(lang[row + doc] * (1 << BITS) + bucket, minlength=held.size).reshape(held.shape)
        at = np.flatnonzero(held.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held.ravel()[at])], names=["cell", "n"])

    return each


def train(texts: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 3000) -> tuple[list[str], np.ndarray]:
    """Languages and log likelihoods of the buckets, from per_language texts each, the least by a hash of the text."""
    ship(texts.sparkSession)
    known = texts.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(text_col).alias("_t"), F.lower(lang_col).alias("_l"))
    share = {r["_l"]: r["count"] for r in known.groupBy("_l").count().collect()}
    if not share:
        raise ValueError("no labelled texts")
    languages = sorted(share)
    # of a language with n texts, those with the least hash, about per_language of them: no sort, no text is moved
    rate = F.create_map(*[F.lit(y) for x, n in share.items() for y in (x, min(1.0, per_language / n))])
    drawn = known.where(F.pmod(F.xxhash64("_t"), F.lit(1_000_000)) < rate[F.col("_l")] * 1_000_000)
    counts = drawn.mapInArrow(lean(_tally(languages)), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # languages x 2**BITS cells at most
    held = np.full(len(languages) << BITS, 0.5)
    held[counts["cell"].to_numpy(np.int64)] += counts["n"].to_numpy(np.float64)
    held = held.reshape(len(languages), -1)
    return languages, np.log(held / held.sum(axis=1, keepdims=True))


def _scores(shared, evidence: float, html: bool):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, logs = shared.value
        table = np.ascontiguousarray(logs.T)
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                part = b.slice(lo, 128)
                source = part.column(0)
                declared = pa.nulls(part.num_rows, pa.string())
                if html:
                    pages = [x or "" for x in source.to_pylist()]
                    found = [DECLARED.search(x) or META.search(x) for x in pages]
                    declared = pa.array([m[1].lower() if m else None for m in found], pa.string())
                    source = pa.array([main_text(x) for x in pages], pa.string())
                out = np.zeros((part.num_rows, len(languages)))
                for row, rows, data, offsets in W.chunks(source, CHUNK):
                    doc, bucket = _trigrams(data, offsets)
                    n = np.bincount(doc, minlength=rows)
                    sums = np.stack([np.bincount(doc, table[bucket, j], minlength=rows) for j in range(len(languages))], axis=1)
                    out[row : row + rows] = sums * (np.minimum(n, evidence) / np.maximum(n, 1))[:, None]
                out -= out.max(axis=1, keepdims=True) if len(languages) else 0
                likes = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * len(languages)), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], declared, likes], names=[*b.schema.names[1:], "declared", "text_log"])

    return each


def text_scores(rows: DataFrame, model: tuple[list[str], np.ndarray], column: str, html: bool, evidence: float = 40.0) -> DataFrame:
    """rows' columns but the one read (and any named declared or text_log), with declared and text_log (of each language, its largest 0)."""
    spark = rows.sparkSession
    ship(spark)
    own = Carried(rows, ("declared", "text_log"), (column,))
    found = rows.select(F.col(column), own.packed).mapInArrow(lean(_scores(spark.sparkContext.broadcast(model), evidence, html)), own.schema(("declared", "string"), ("text_log", "array<double>")))
    return own.unpacked(found, "declared", "text_log")


def _address(url: Column, languages: list[str]) -> Column:
    """The language a URL names: by a path segment, else by the first label or the suffix of its host."""
    codes = "|".join(map(re.escape, languages))
    at = [rf"(?i)^[a-z][a-z0-9+.-]*://[^/?#]+/(?:[^?#]*/)?({codes})(?:[-_][a-z]+)?(?:[/?#]|$)", rf"(?i)^[a-z][a-z0-9+.-]*://({codes})\.", rf"(?i)^[a-z][a-z0-9+.-]*://[^/?#:]+\.({codes})(?:[:/?#]|$)"]
    found = [F.regexp_extract(F.coalesce(url, F.lit("")), p, 1) for p in at]
    return F.lower(F.coalesce(*[F.when(F.length(x) > 0, x) for x in found]))


def _normal(logs: Column) -> Column:
    top = F.array_max(logs)
    odds = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
    return F.transform(odds, lambda x: x / total)


def _sum_of(column: str, k: int) -> Column:
    return F.array(*[F.sum(F.col(column)[i]) for i in range(k)])


def identify(pages: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", pseudo: tuple[float, float] = (4.0, 16.0)) -> DataFrame:
    """id, url, host, declared, address, lang, posterior (of lang), text_lang of each page."""
    languages, _ = model
    k = len(languages)
    scored = text_scores(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("_html")), model, "_html", True)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    known = lambda c: F.when(c.isin(*languages), c)
    x = scored.withColumns({"host": host, "declared": known(F.col("declared")), "address": _address(F.col("url"), languages), "p": _normal(F.col("text_log"))})
    x = cut(x.withColumn("domain", F.substring_index("host", ".", -2)))

    overall = x.agg(*[F.coalesce(F.sum(F.col("p")[i]), F.lit(0.0)).alias(f"p{i}") for i in range(k)]).first()
    base = np.array(list(overall)) + 1.0
    base = (base / base.sum()).tolist()
    trust = {}
    for kind in ("declared", "address"):  # at most languages x languages numbers
        rows = x.where(F.col(kind).isNotNull()).groupBy(kind).agg(_sum_of("p", k).alias("n")).collect()
        held = np.full((k, k), 0.2) + np.diag(np.full(k, 5.0))  # a code names its own language until counts say otherwise
        for r in rows:
            held[languages.index(r[kind])] += np.array(r["n"])
        trust[kind] = np.log(held / held.sum(axis=0, keepdims=True))

    domains = x.groupBy(F.col("domain").alias("_domain")).agg(_sum_of("p", k).alias("in_domain"))
    hosts = x.groupBy(F.col("host").alias("_host")).agg(_sum_of("p", k).alias("on_host"))
    x = x.join(domains, F.col("domain") == F.col("_domain")).join(hosts, F.col("host") == F.col("_host"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)

    def smooth(sums: str, above: Column, weight: float) -> Column:
        own = F.zip_with(sums, "p", lambda a, b: F.greatest(a - b, F.lit(0.0)))
        return F.zip_with(own, above, lambda a, q: (a + weight * q) / (total(own) + weight))

    x = x.withColumn("by_domain", smooth("in_domain", F.array(*map(F.lit, base)), pseudo[1])).withColumn("by_host", smooth("on_host", F.col("by_domain"), pseudo[0]))
    logs = [F.col("text_log"), F.transform("by_host", lambda v: F.log(v))]
    for kind in ("declared", "address"):
        rows = F.create_map(*[c for i, name in enumerate(languages) for c in (F.lit(name), F.array(*[F.lit(float(v)) for v in trust[kind][i]]))])
        logs.append(F.coalesce(rows[F.col(kind)], F.array(*[F.lit(0.0)] * k)))
    x = x.withColumn("post", _normal(reduce(lambda a, b: F.zip_with(a, b, lambda u, v: u + v), logs)))
    names = F.array(*map(F.lit, languages))
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return x.select("id", "url", "host", "declared", "address", best(F.col("post")).alias("lang"), F.array_max("post").alias("posterior"), best(F.col("text_log")).alias("text_lang"))
