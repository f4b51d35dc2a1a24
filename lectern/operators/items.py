"""Paragraphs, blocks, slides and tables to items, and items to the frames that sheets are written from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .validate import BLOCKING


def paragraph_items(paragraphs: DataFrame, order: str = "para_id", classify: bool = True) -> DataFrame:
    """doc_id, item_no, clause_id, title, text, classification: one item a body paragraph, with the id and title of the heading before it."""
    w = Window.partitionBy("doc_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = paragraphs.withColumn("_h", F.last(F.when(F.col("kind") == "heading", T.split_heading(F.col("text"))), ignorenulls=True).over(w)).where("kind = 'body'")
    return x.select(
        "doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(order)).alias("item_no"), F.coalesce("_h.clause_id", F.lit("")).alias("clause_id"), F.coalesce("_h.title", F.lit("")).alias("title"), "text",
        (T.classify_obligation(F.col("text")) if classify else F.lit("Information")).alias("classification"),
    )


def block_items(blocks: DataFrame, classify: bool = True, split: bool = True) -> DataFrame:
    """doc_id, item_no, page, clause_id, title, text, classification, confidence, issues; tables give an item a row.

    split: headings are divided into id and title; otherwise the whole heading is the id.
    """
    w = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    named = T.split_heading(F.col("text")) if split else F.struct(T.strip(F.col("text")).alias("clause_id"), F.lit("").alias("title"))
    x = blocks.withColumn("_h", F.last(F.when(F.col("block_type") == "heading", named), ignorenulls=True).over(w)).where("block_type not in ('heading', 'toc')")
    cells = F.transform("rows", lambda r: F.array_join(F.transform(r, lambda c: T.strip(F.coalesce(c, F.lit("")))), " | "))
    lines = F.filter(F.transform(F.split("text", "\n"), T.strip), lambda s: s != "")
    is_table = F.col("block_type") == "table"
    rows = F.when(is_table & (F.coalesce(F.size("rows"), F.lit(0)) > 0), cells).when(is_table, lines).otherwise(F.array("text"))
    x = x.select("doc_id", "block_no", "page", "block_type", "_h", "confidence", "issues", F.posexplode(rows).alias("_i", "line"))
    plain = F.col("block_type").isin("table", "note") | F.lit(not classify)
    return x.select(
        "doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("block_no", "_i")).alias("item_no"), "page", F.coalesce("_h.clause_id", F.lit("")).alias("clause_id"), F.coalesce("_h.title", F.lit("")).alias("title"),
        F.col("line").alias("text"), F.when(plain, "Information").otherwise(T.classify_obligation(F.col("line"))).alias("classification"),
        F.coalesce("confidence", F.when(F.col("block_type") == "table", 0.9).otherwise(1.0)).alias("confidence"), "issues",
    )


def deck_items(slides: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, page, pos, clause_id, title, text, classification of slides (doc_id, page, text) and their tables (doc_id, page, table_no, rows)."""
    title = F.coalesce("slide_title", F.concat(F.lit("Slide "), F.col("page").cast("string")))
    named = slides.select("doc_id", "page", T.slide_title(F.col("text"), F.col("page")).alias("slide_title"))
    t = tables.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("table_no"))).join(named, ["doc_id", "page"], "left")
    clause = F.concat(F.lit("slide"), F.col("page").cast("string"), F.when(F.col("nth") > 1, F.concat(F.lit("_"), F.col("nth").cast("string"))).otherwise(""))
    rows = t.select("doc_id", "page", clause.alias("clause_id"), title.alias("title"), "nth", F.posexplode("rows").alias("row", "r"))
    rows = rows.select("doc_id", "page", "clause_id", "title", F.col("nth").alias("a"), F.col("row").alias("b"), F.array_join(F.transform("r", lambda c: F.coalesce(c, F.lit(""))), " | ").alias("text"))
    whole = slides.select(
        "doc_id", "page", F.concat(F.lit("slide"), F.col("page").cast("string")).alias("clause_id"), T.slide_title(F.col("text"), F.col("page")).alias("title"),
        F.lit(1 << 30).alias("a"), F.lit(0).alias("b"), T.strip(F.coalesce("text", F.lit(""))).alias("text"),
    )
    x = rows.unionByName(whole)
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "a", "b"))
    return x.select("doc_id", "page", pos.alias("pos"), "clause_id", "title", "text", F.lit("Information").alias("classification"))


ENRICHED = ("requirement", "detailed_description", "change_in_requirement", "requirement_classification")


def assessment_rows(items: DataFrame, standard_id: str, start_row: int = 10) -> DataFrame:
    """doc_id, sheet_row and the columns A to I of the assessment sheet; the clause is written where it changes."""
    w = Window.partitionBy("doc_id").orderBy("item_no")
    n = F.row_number().over(w)
    more = [F.coalesce(F.col(c), F.lit("")) if c in items.columns else F.lit("") for c in ENRICHED]
    return items.select(
        "doc_id", (n + start_row - 1).alias("sheet_row"), F.concat(F.lit(f"{standard_id}_"), n.cast("string")).alias("row_id"),
        F.when(~F.col("clause_id").eqNullSafe(F.lag("clause_id").over(w)), F.col("clause_id")).alias("clause"), "title", "text", F.coalesce("classification", F.lit("Information")).alias("classification"),
        *[c.alias(name) for c, name in zip(more, ENRICHED, strict=True)],
    )


def issue_rows(items: DataFrame, start_row: int = 10) -> DataFrame:
    """doc_id, list_row (by the full list), page, clause_id, title, text, confidence, issues of items with issues."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("item_no"))
    x = items.withColumn("list_row", n + start_row - 1).where(F.size("issues") > 0)
    return x.select("doc_id", "list_row", "page", "clause_id", "title", "text", "confidence", F.array_join("issues", ", ").alias("issues"))


def review_rows(items: DataFrame) -> DataFrame:
    status = F.coalesce("export_status", F.when(F.arrays_overlap("issues", F.array(*map(F.lit, BLOCKING))), "rejected").otherwise("exported"))
    return items.select(
        "doc_id", "item_no", status.alias("export_status"), "page", "source_type", "clause_id", "title", F.substring("text", 1, 150).alias("preview"), F.length("text").alias("text_length"),
        "classification", "confidence", F.array_join("issues", ", ").alias("issues"), F.substring(F.coalesce("raw_text", F.lit("")), 1, 500).alias("raw_text"),
    )


def sheet_names(tables: DataFrame) -> DataFrame:
    """tables with sheet_name: slide{page}, with _k from the page's second table on."""
    n = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("table_no"))
    return tables.withColumn("sheet_name", F.substring(F.concat(F.lit("slide"), F.col("page").cast("string"), F.when(n > 1, F.concat(F.lit("_"), n.cast("string"))).otherwise("")), 1, 31))


def summary(items: DataFrame) -> DataFrame:
    """One row a document: how many items, requirements, information rows, rejected rows and issues."""
    return items.groupBy("doc_id").agg(
        F.count("*").alias("n_items"), F.count_if(F.col("classification") == "Requirement").alias("n_requirements"), F.count_if(F.col("classification") == "Information").alias("n_information"),
        F.count_if(F.col("export_status") == "rejected").alias("n_rejected"), F.count_if(F.size("issues") > 0).alias("n_with_issues"),
    )


def catalog_rows(items: DataFrame) -> DataFrame:
    """doc_id, item_no and the five columns of a catalog's plain sheet."""
    return items.select("doc_id", "item_no", F.col("clause_id").alias("Clause ID"), F.col("title").alias("Title"), F.col("classification").alias("Classification"), F.col("source_page").alias("Source Page"), F.col("text").alias("Text"))


def catalog_review_rows(items: DataFrame, most: int = 200) -> DataFrame:
    """doc_id, item_no and the eight columns of a catalog's review sheet; a longer text ends in dots."""
    t = F.coalesce("text", F.lit(""))
    preview = F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)
    return items.select(
        "doc_id", "item_no", "source_page", "clause_id", "title", "classification", preview.alias("text_preview"), F.length(t).alias("text_length"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.array_join("issues", ", ").alias("issues"),
    )


def block_review_rows(blocks: DataFrame) -> DataFrame:
    """doc_id and the nine columns of a sheet of blocks as they were found."""
    none = F.lit("")
    given = lambda c: F.coalesce(F.col(c).cast("string"), none) if c in blocks.columns else none
    box = F.concat(F.lit("["), F.array_join(F.array(*[F.col(f"bbox.{c}").cast("string") for c in ("x0", "top", "x1", "bottom")]), ", "), F.lit("]"))
    return blocks.select("doc_id", "page", F.col("block_no").alias("block_id"), "block_type", given("clause_id").alias("clause_id"), given("title").alias("title"), "text", "confidence", F.array_join("issues", ", ").alias("issues"), box.alias("bbox"))


def page_warnings(items: DataFrame, page: str = "page") -> DataFrame:
    """doc_id, warning_no, warning: each issue of a page once, in the order of its first item."""
    x = items.select("doc_id", "item_no", F.col(page).alias("_page"), F.posexplode("issues").alias("at", "issue"))
    first = x.groupBy("doc_id", F.concat(F.lit("Page "), F.coalesce(F.col("_page").cast("string"), F.lit("None")), F.lit(": "), F.col("issue")).alias("warning")).agg(F.min(F.struct("item_no", "at")).alias("first"))
    return first.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")).alias("warning_no"), "warning")


def sheet_sizes(tables: DataFrame, slides: DataFrame) -> DataFrame:
    """doc_id, sheet_name, n_rows, width of a deck's sheets; the texts are the last one. tables: with sheet_name and rows."""
    widest = F.coalesce(F.array_max(F.transform("rows", lambda r: F.size(r))), F.lit(0))
    sheets = tables.select("doc_id", "sheet_name", F.size("rows").cast("long").alias("n_rows"), widest.alias("width"))
    return sheets.unionByName(slides.groupBy("doc_id").agg(F.lit("slides_text").alias("sheet_name"), F.count("*").alias("n_rows"), F.lit(2).alias("width")))


def padded_rows(tables: DataFrame) -> DataFrame:
    """tables with each row filled up with '' to its table's width."""
    widest = F.array_max(F.transform("rows", lambda r: F.size(r)))
    return tables.withColumn("rows", F.transform("rows", lambda r: F.concat(r, F.array_repeat(F.lit(""), widest - F.size(r)))))


def subset(items: DataFrame, selected: tuple[int, ...] | None = None, first: int | None = None) -> DataFrame:
    """The items of a document that are to be enriched: those selected, the first so many, or all. item_no counts from 1."""
    if selected is not None:
        return items.where(F.col("item_no").isin(*selected) if selected else F.lit(False))
    return items if first is None else items.where(F.col("item_no") <= first)


def sheet_check(rows: DataFrame, id_pattern: str, titles: tuple[str, ...], phrases: tuple[str, ...]) -> DataFrame:
    """One row a document: counts over a written assessment sheet (doc_id, sheet_row, clause, title, text), and its first id.

    titles: front matter by title; phrases: what no clause, title or text may hold. Clauses are compared as written.
    """
    clean = lambda c: T.strip(F.coalesce(F.col(c), F.lit("")))
    x = rows.select("doc_id", "sheet_row", *[clean(c).alias(c) for c in ("clause", "title", "text")]).where("clause <> '' or title <> '' or text <> ''")
    low = F.lower(F.concat_ws(" ", "clause", "title", "text"))
    bad = F.lower("title").isin(*[t.lower() for t in titles]) | F.exists(F.array(*map(F.lit, [p.lower() for p in phrases])), lambda p: low.contains(p))
    repeated = x.where("clause <> ''").groupBy("doc_id", "clause").count().where("count > 1").groupBy("doc_id").agg(F.count("*").alias("_duplicates"))
    found = x.groupBy("doc_id").agg(
        F.count("*").alias("n_rows"), F.min_by("clause", "sheet_row").alias("first_id"), F.count_if(F.col("clause") == "").alias("n_blank"),
        F.count_if((F.col("clause") != "") & ~F.col("clause").rlike(id_pattern)).alias("n_invalid"), F.count_if(bad).alias("n_bad"), F.count_if(F.length("text") <= 1).alias("n_one_letter"),
    )
    return found.join(repeated, "doc_id", "left").select(*found.columns, F.coalesce("_duplicates", F.lit(0)).cast("long").alias("n_duplicates"))
