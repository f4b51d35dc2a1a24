"""Words to lines, and what repeats at the edges of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import keyed


def split_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no from 0, text of each line."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "text"))


def cluster_by_anchor(words: DataFrame, reach: float = 0.6) -> DataFrame:
    """words with line_no: a word stays in a line as long as its top is near the top of the line's first word.

    The line's first word carries over from word to word, so this is a fold over each page's words in order, in one
    aggregation a page. It only keeps where lines start; a line's number is then repeated for each of its words.
    """
    place = F.struct(F.bround("top", 1).alias("r"), F.col("x0").alias("x"), F.col("word_no").alias("k"), F.struct(*[F.col(f"`{c}`") for c in words.columns]).alias("row"))
    pages = words.groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(place)), lambda w: w["row"]).alias("w"))
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("starts"))

    def step(a: Column, w: Column) -> Column:
        same = a["anchor"].isNotNull() & (F.abs(w["top"] - a["anchor"]) <= F.lit(reach) * F.greatest(w["bottom"] - w["top"], F.lit(1.0)))
        starts = F.when(same, a["starts"]).otherwise(F.array_append(a["starts"], a["n"]))
        return F.struct(F.when(same, a["anchor"]).otherwise(w["top"]).alias("anchor"), (a["n"] + 1).alias("n"), starts.alias("starts"))

    begun = pages.select("w", F.aggregate("w", start, step)["starts"].alias("starts"))
    begun = begun.select("w", "starts", F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("w"))).alias("ends"))
    line = F.flatten(F.transform("starts", lambda s, j: F.array_repeat(j, F.get("ends", j) - s)))
    return begun.select(F.explode(F.arrays_zip(F.col("w").alias("w"), line.alias("line"))).alias("p")).select("p.w.*", F.col("p.line").alias("line_no"))


def cluster_by_bucket(words: DataFrame, height: float = 3.0) -> DataFrame:
    """words with bucket: the top rounded to a multiple of height."""
    return words.withColumn("bucket", F.bround(F.col("top") / height) * height)


def to_lines(words: DataFrame, clean=T.clean_prose) -> DataFrame:
    """One row a line of words with line_no: text in x order and the line's extents and font."""
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_no", "text"))), lambda w: w["text"])
    font = F.mode("fontname", True) if "fontname" in words.columns else F.lit(None).cast("string")
    out = words.groupBy("doc_id", "page", "line_no").agg(
        clean(F.array_join(pieces, " ")).alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"),
        F.avg("size").alias("font_size"), font.alias("font_name"), F.bool_or(~F.coalesce(F.col("upright"), F.lit(True))).alias("is_rotated"),
    )
    return out.where("text <> ''").withColumn("is_bold", F.lower(F.coalesce("font_name", F.lit(""))).contains("bold"))


def body_band(words: DataFrame, header: float = 55.0, footer: float = 740.0) -> DataFrame:
    """Words between the header and footer bands."""
    return words.where((F.col("top") >= header) & (F.col("top") <= footer))


def boilerplate(lines: DataFrame, pages: DataFrame, edge: int = 2, share: float = 0.6, least_pages: int = 3) -> DataFrame:
    """doc_id, norm: digit-free forms among the first and last lines of at least share of a document's pages.

    lines: doc_id, page, line_no, text. pages: doc_id, page, with the pages that have no lines too.
    """
    w = Window.partitionBy("doc_id", "page")
    at = lines.withColumn("a", F.row_number().over(w.orderBy("line_no"))).withColumn("z", F.row_number().over(w.orderBy(F.desc("line_no"))))
    forms = at.where((F.col("a") <= edge) | (F.col("z") <= edge)).select("doc_id", "page", T.digit_form(F.col("text")).alias("norm")).distinct()
    counts = forms.groupBy("doc_id", "norm").agg(F.count("*").alias("n"))
    total = pages.groupBy("doc_id").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= least_pages)
    return counts.join(keyed(total), "doc_id").where(F.col("n") >= F.greatest(F.lit(2), F.bround(F.col("pages") * share))).select("doc_id", "norm", "n")


def strip_boilerplate(lines: DataFrame, found: DataFrame) -> DataFrame:
    """lines without boilerplate and page numbers."""
    normed = lines.where(~T.is_page_number(F.col("text"))).withColumn("norm", T.digit_form(F.col("text")))
    return normed.join(keyed(found.select("doc_id", "norm")), ["doc_id", "norm"], "left_anti").drop("norm")


def with_gaps(lines: DataFrame) -> DataFrame:
    """lines with gap (to the line before) and median_gap (of the page's positive gaps, 0 without any)."""
    page = Window.partitionBy("doc_id", "page")
    x = lines.withColumn("gap", F.col("top") - F.lag("bottom").over(page.orderBy("line_no")))
    return x.withColumn("median_gap", F.coalesce(F.median(F.when(F.col("gap") > 0, F.col("gap"))).over(page), F.lit(0.0)))


def outside_tables(words: DataFrame, tables: DataFrame, slack: float = 2.0) -> DataFrame:
    """Words whose centre is in no table's box of their page. tables: doc_id, page, bbox."""
    w, t = words.alias("w"), tables.alias("t")
    cx, cy = (F.col("w.x0") + F.col("w.x1")) / 2, (F.col("w.top") + F.col("w.bottom")) / 2
    hit = (F.col("w.doc_id") == F.col("t.doc_id")) & (F.col("w.page") == F.col("t.page"))
    hit = hit & cx.between(F.col("t.bbox.x0") - slack, F.col("t.bbox.x1") + slack) & cy.between(F.col("t.bbox.top") - slack, F.col("t.bbox.bottom") + slack)
    return w.join(keyed(t), hit, "left_anti")
