"""Blocks of web pages to paragraphs, and signs that a page was not read whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import profiles as P
from ..functions import text as T


def fold_markers(blocks: DataFrame) -> DataFrame:
    """doc_id, pos, kind, text: blocks that are only an enumeration marker prefix the next other block; trailing ones stay.

    A block's group is the number of other blocks before it, so markers and the block they label fall together.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    x = blocks.withColumn("_m", T.is_marker(F.col("text")))
    x = x.withColumn("_g", F.coalesce(F.sum((~F.col("_m")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("_to", F.max(F.when(~F.col("_m"), F.col("pos"))).over(Window.partitionBy("doc_id", "_g")))
    x = x.withColumn("_at", F.coalesce("_to", F.col("pos")))
    g = x.groupBy("doc_id", F.col("_at").alias("pos")).agg(
        F.max_by("kind", "pos").alias("kind"), F.count("*").alias("n"), F.first("text").alias("one"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: T.strip(s["text"])), " ").alias("all"),
    )
    return g.select("doc_id", "pos", "kind", F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("all")).alias("text"))


def drop_repeats(blocks: DataFrame) -> DataFrame:
    """Blocks that differ from the block just before in kind or text (white space aside)."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    key = F.struct("kind", T.collapse(F.col("text")).alias("t"))
    return blocks.withColumn("_k", key).withColumn("_b", F.lag("_k").over(w)).where("_b is null or _k != _b").drop("_k", "_b")


def web_paragraphs(blocks: DataFrame, least_legal: int = 3, forms: bool = True) -> DataFrame:
    """doc_id, para_id, kind, section, text: headings by tag or by form; a legal heading's trailing sentence starts the body.

    forms: otherwise headings are as tagged, and whole.
    """
    x = blocks.withColumn("text", T.clean_web(F.col("text"))).where("text <> ''")
    if forms:
        legal = F.countDistinct(F.when(P.is_prose_heading(F.col("text"), "legal"), F.col("text")))
        style = x.groupBy("doc_id").agg(F.when(legal >= least_legal, "legal").otherwise("numbered").alias("style"))
        x = x.join(style, "doc_id").withColumn("_h", (F.col("kind") == "heading") | P.is_prose_heading(F.col("text"), F.col("style"))).withColumn("_l", T.heading_label(F.col("text")))
        head, rest, body = (F.struct(F.lit(k).alias("kind"), t.alias("text")) for k, t in (("heading", F.col("_l.label")), ("body", F.col("_l.trailing")), ("body", F.col("text"))))
        parts = F.when(F.col("_h"), F.when(F.col("_l.trailing") != "", F.array(head, rest)).otherwise(F.array(head))).otherwise(F.array(body))
        x = x.select("doc_id", "pos", F.posexplode(parts).alias("_i", "p")).select("doc_id", "pos", "_i", "p.kind", "p.text")
    else:
        x = x.select("doc_id", "pos", F.lit(0).alias("_i"), "kind", "text")
    w = Window.partitionBy("doc_id").orderBy("pos", "_i")
    x = x.withColumn("para_id", F.row_number().over(w))
    section = F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("para_id").rowsBetween(Window.unboundedPreceding, 0))
    return x.select("doc_id", "para_id", "kind", F.coalesce(section, F.lit("")).alias("section"), "text")


def incomplete(blocks: DataFrame, chars: int = 500, bodies: int = 3) -> DataFrame:
    """doc_id, n_blocks, body_chars, is_incomplete."""
    body = F.col("kind") == "body"
    legal = F.col("text").rlike(r"(?iU)(^|[^\p{L}\p{N}_])(article|chapter|section|part)\s+\d+")
    g = blocks.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.coalesce(F.sum(F.when(body, F.length("text"))), F.lit(0)).alias("body_chars"), F.count_if(body).alias("n_body"), F.bool_or((F.col("kind") == "heading") | legal).alias("shaped"))
    return g.select("doc_id", "n_blocks", "body_chars", ((F.col("body_chars") < chars) | (F.col("n_body") < bodies) | ~F.col("shaped")).alias("is_incomplete"))


def arbitrate(first: DataFrame, fallback: DataFrame, blocks: int = 3, chars: int = 500) -> DataFrame:
    """The first extractor's blocks, or the fallback's where the first gave little and the fallback has more text."""
    size = lambda df, n: df.groupBy("doc_id").agg(F.count("*").alias(f"n_{n}"), F.sum(F.length("text")).alias(f"c_{n}"))
    s = size(first, "a").join(size(fallback, "b"), "doc_id", "full_outer")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    use = s.select("doc_id", (((z("n_a") < blocks) | (z("c_a") < chars)) & (z("c_b") > z("c_a"))).alias("other"))
    take = lambda df, when: df.join(use.where(when).select("doc_id"), "doc_id", "left_semi")
    return take(first, ~F.col("other")).unionByName(take(fallback, F.col("other")))


def warnings(paragraphs: DataFrame, least_chars: int = 200, repeats: int = 5) -> DataFrame:
    """doc_id, code, detail: too little content, headings repeated too often, the first heading number that runs backwards."""
    total = paragraphs.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n")).where(F.col("n") < least_chars).select("doc_id", F.lit("no_content").alias("code"), F.col("n").cast("string").alias("detail"))
    heads = paragraphs.where("kind = 'heading'")
    often = heads.groupBy("doc_id", "text").agg(F.count("*").alias("n")).where(F.col("n") > repeats).select("doc_id", F.lit("repeated_heading").alias("code"), F.substring("text", 1, 60).alias("detail"))
    n = F.regexp_extract("text", r"(\d+)", 1)
    w = Window.partitionBy("doc_id").orderBy("para_id")
    x = heads.where(n != "").select("doc_id", "para_id", n.cast("long").alias("n")).withColumn("was", F.lag("n").over(w)).where("n < was")
    back = x.groupBy("doc_id").agg(F.min_by(F.concat(F.col("n").cast("string"), F.lit(" after "), F.col("was").cast("string")), "para_id").alias("detail")).select("doc_id", F.lit("numbers_run_backwards").alias("code"), "detail")
    return total.unionByName(often).unionByName(back)


def html_title(html: Column) -> Column:
    """The title element, white space collapsed, with the five basic character references decoded."""
    t = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(ch))
    return T.collapse(t)
