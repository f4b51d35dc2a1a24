"""Lines to paragraphs, with sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import profiles as P
from ..functions import text as T
from .lines import with_gaps


def heading_style(lines: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, style: legal if so many distinct lines look like legal headings, else numbered."""
    legal = F.countDistinct(F.when(P.is_prose_heading(F.col("text"), "legal"), F.col("text")))
    return lines.groupBy("doc_id").agg(F.when(legal >= least, "legal").otherwise("numbered").alias("style"))


def page_paragraphs(lines: DataFrame, style: str | None = "auto", gap_factor: float = 1.6) -> DataFrame:
    """doc_id, page, pos, kind (heading or body), text; lines: doc_id, page, line_no, text, top, bottom.

    A paragraph ends at a heading and at a gap over gap_factor times the page's median gap; a legal heading's trailing
    sentence starts the next one. One window pass marks starts, a running sum numbers them, an aggregation joins.
    style: auto, numbered, legal, or None for paragraphs by gaps alone.
    """
    if style == "auto":
        x = lines.join(heading_style(lines), "doc_id").withColumn("_h", P.is_prose_heading(F.col("text"), F.col("style")))
    else:
        x = lines.withColumn("_h", P.is_prose_heading(F.col("text"), style) if style else F.lit(False))
    x = with_gaps(x).withColumn("_l", T.heading_label(F.col("text")))
    far = (F.col("median_gap") > 0) & (F.col("gap") > F.col("median_gap") * gap_factor)
    part = F.struct(F.lit(0).alias("part"), F.lit("heading").alias("kind"), F.col("_l.label").alias("piece"), F.lit(True).alias("new"))
    rest = F.struct(F.lit(1).alias("part"), F.lit("body").alias("kind"), F.col("_l.trailing").alias("piece"), F.lit(True).alias("new"))
    body = F.struct(F.lit(0).alias("part"), F.lit("body").alias("kind"), F.col("text").alias("piece"), F.coalesce(far, F.lit(False)).alias("new"))
    pieces = F.when(F.col("_h"), F.when(F.col("_l.trailing") != "", F.array(part, rest)).otherwise(F.array(part))).otherwise(F.array(body))
    x = x.select("doc_id", "page", "line_no", F.explode(pieces).alias("p")).select("doc_id", "page", "line_no", "p.*")
    w = Window.partitionBy("doc_id", "page").orderBy("line_no", "part")
    start = F.col("new") | (F.coalesce(F.lag("kind").over(w), F.lit("heading")) == "heading")
    x = x.withColumn("pos", F.sum(start.cast("int")).over(w))
    out = x.groupBy("doc_id", "page", "pos", "kind").agg(T.join_lines(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "part", "piece"))), lambda s: s["piece"])).alias("text"))
    return out.where("text <> ''").select("doc_id", "page", "pos", "kind", "text")


def merge_across_pages(paragraphs: DataFrame) -> DataFrame:
    """doc_id, para_id, page, kind, section, text: a page's first paragraph joins the open sentence before it.

    A merged text ends as its last fragment does, so each fragment only has to look at the one before it.
    """
    doc = Window.partitionBy("doc_id").orderBy("page", "pos")
    first = F.min("pos").over(Window.partitionBy("doc_id", "page"))
    x = paragraphs.withColumn("_first", F.col("pos") == first)
    joins = (
        (F.col("kind") == "body") & (F.lag("kind").over(doc) == "body") & (F.lag("page").over(doc) != F.col("page")) & F.col("_first")
        & ~T.ends_sentence(F.lag("text").over(doc)) & F.col("text").rlike(r"^\p{Ll}")
    )
    x = x.withColumn("para_id", F.sum((~F.coalesce(joins, F.lit(False))).cast("int")).over(doc))
    x = x.groupBy("doc_id", "para_id").agg(
        F.min("page").alias("page"), F.first("kind").alias("kind"),
        T.join_lines(F.transform(F.array_sort(F.collect_list(F.struct("page", "pos", "text"))), lambda s: s["text"])).alias("text"),
    )
    return carry_section(x, "para_id").select("doc_id", "para_id", "page", "kind", "section", "text")


def carry_section(rows: DataFrame, order: str, *more: str) -> DataFrame:
    """rows with section: the last heading so far, itself included; '' before the first."""
    w = Window.partitionBy("doc_id").orderBy(order, *more).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.coalesce(F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(w), F.lit("")))
