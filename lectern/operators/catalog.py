"""Control catalogs, parsed line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import profiles as P
from ..functions import text as T


def catalog_pages(pages: DataFrame) -> DataFrame:
    """doc_id, first_page, end_page (exclusive): from the chapter's first page to the back matter. pages: doc_id, page, raw_text."""
    top = F.upper(F.array_join(F.slice(F.split(T.strip(F.col("raw_text")), "\n"), 1, 5), "\n"))
    ends = F.exists(F.array(*[F.lit(f"{k} PAGE") for k in ("REFERENCES", "APPENDIX A", "APPENDIX B", "APPENDIX C")]), lambda k: F.col("top").contains(k))
    x = pages.withColumn("top", top).withColumn("opens", F.col("top").contains("CHAPTER THREE PAGE")).withColumn("ends", ends)
    x = x.withColumn("first_page", F.min(F.when(F.col("opens"), F.col("page"))).over(Window.partitionBy("doc_id")))
    return x.groupBy("doc_id").agg(
        F.coalesce(F.first("first_page"), F.min("page")).alias("first_page"),
        F.coalesce(F.min(F.when(F.col("ends") & (F.col("page") >= F.col("first_page")), F.col("page"))), F.max("page") + 1).alias("end_page"),
    )


def parse_controls(lines: DataFrame) -> DataFrame:
    """doc_id, item_no, clause_id, title, text, classification, source_page, confidence, issues. lines: doc_id, page, line_no, text, size, is_bold.

    A bold heading opens a control, a numbered one in capitals an enhancement of the last control; other lines belong
    to the last heading. Headings without text give nothing.
    """
    so_far = Window.partitionBy("doc_id").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = lines.where(~((F.col("size") >= 13.0) & F.col("text").rlike(r"^3\.\d+\s+[A-Z][A-Z ]+$")) & ~F.col("text").startswith("Quick link to"))
    base = F.col("is_bold") & (F.col("size") >= 10.5) & F.col("text").rlike(P.BASE_HEADING)
    x = x.withColumn("base", base).withColumn("parent", F.last(F.when(base, F.regexp_extract("text", P.BASE_HEADING, 1)), ignorenulls=True).over(so_far))
    sub = ~F.col("base") & F.col("text").rlike(P.ENHANCEMENT) & F.col("parent").isNotNull()
    head = F.when(F.col("base"), F.struct(F.col("parent").alias("id"), T.strip(F.regexp_extract("text", P.BASE_HEADING, 2)).alias("title"), "page")).when(
        sub, F.struct(F.concat("parent", F.lit("("), F.regexp_extract("text", P.ENHANCEMENT, 1), F.lit(")")).alias("id"), T.strip(F.regexp_extract("text", P.ENHANCEMENT, 2)).alias("title"), "page")
    )
    x = x.withColumn("head", head).withColumn("n", F.count("head").over(so_far)).where("n > 0")
    g = x.groupBy("doc_id", "n").agg(
        F.first("head", ignorenulls=True).alias("head"),
        T.clean_catalog(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("head").isNull(), F.struct("page", "line_no", "text")))), lambda s: s["text"]), " ")).alias("text"),
    ).where("text <> ''")
    gone, short, doi = F.lower("text").rlike(r"(?U)\[withdrawn\s*:"), F.length("text") < 20, F.col("text").contains(T.DOI_PATH)
    return g.select(
        "doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("n")).alias("item_no"), F.col("head.id").alias("clause_id"), F.col("head.title").alias("title"), "text",
        F.when(gone, "Information").otherwise("Requirement").alias("classification"), F.col("head.page").alias("source_page"),
        F.when(gone, 0.9).when(doi, 0.3).when(short, 0.6).otherwise(0.95).alias("confidence"),
        F.array_compact(F.array(F.when(short, "text_too_short"), F.when(doi, "contains_doi_fragment"))).alias("issues"),
    )


def check_controls(items: DataFrame) -> DataFrame:
    """items with the catalog's own checks: only the second and later rows of an id are duplicates."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "clause_id").orderBy("item_no"))
    t = F.col("text")
    rules = (
        (nth > 1, "duplicate_clause_id", 0.5), (F.coalesce("clause_id", F.lit("")) == "", "missing_clause_id", 0.3), (F.coalesce("title", F.lit("")) == "", "missing_title", 0.5),
        (F.length(t) < 10, "text_too_short", 0.3), (t.contains(T.DOI_PATH), "contains_doi_url", 0.2), (F.length(T.strip(t)) <= 2, "single_char_text", 0.1),
        (t.contains(T.PAGE_HEADER), "contains_page_header", 0.2), (t.rlike(r"\.{4,}"), "toc_dot_leader", 0.2),
    )
    x = items.withColumns({f"_r{i}": when for i, (when, _, _) in enumerate(rules)})
    return x.select(
        *[c for c in items.columns if c not in ("confidence", "issues")],
        F.least("confidence", *[F.when(F.col(f"_r{i}"), cap) for i, (_, _, cap) in enumerate(rules)]).alias("confidence"),
        F.concat("issues", F.array_compact(F.array(*[F.when(F.col(f"_r{i}"), code) for i, (_, code, _) in enumerate(rules)]))).alias("issues"),
    )


def keep_controls(items: DataFrame, blocking: tuple[str, ...]) -> DataFrame:
    bad = F.arrays_overlap("issues", F.array(*map(F.lit, blocking)))
    return items.where(~bad & (F.coalesce("text", F.lit("")) != "") & (F.coalesce("clause_id", F.lit("")) != "") & ~F.lower("text").contains("doi.org"))
