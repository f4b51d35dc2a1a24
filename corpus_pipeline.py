"""Five stages over the documents: each gets what its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents. Rows without an id are kept by the filtering stages as they are judged. Of rows that repeat,
with or without an id, the stage of near copies keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm._run import Carried, cut, scratch, table
from lectern.llm.decontaminate import remove_contaminated
from lectern.llm.jaccard_join import jaccard_components
from lectern.llm.mixing import mix
from lectern.llm.substring_dedup import remove_repeats
from lectern.llm.toxicity import toxicity, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that score 0.5 or more go; labels train the model."""
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    own = Carried(docs, ())
    return own.unpacked(toxicity(docs.select(own.packed, "text"), model, spans=False).where("score < 0.5"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each group of documents linked by a shingle similarity of 0.8 or more the one with the least id stays.

    Rows without an id come after all others; of rows with the least id, or of rows without one, the least hash of a text
    stays, and of rows alike in both the least by all columns. Documents without words are no copies of each other.
    """
    found = cut(jaccard_components(docs, n=5, threshold=(80, 100)).where("n_shingles > 0").groupBy("_d", "_h", "group_id").agg(F.count("*").alias("_n")))
    place = F.struct(F.col("_d").isNull().alias("late"), F.col("_d").alias("id"), F.col("_h").alias("hash"))
    best = found.groupBy("group_id").agg(F.min(place).alias("best"))
    judged = found.join(best, "group_id").select(F.col("_d").alias("_id"), F.col("_h").alias("_with"), "_n", (place == F.col("best")).alias("_stays"))
    gone, repeated = judged.where("not _stays").drop("_n", "_stays"), judged.where("_stays and _n > 1").drop("_n", "_stays")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_with"))
    own = Carried(docs, ())
    keyed = docs.select(own.packed, "doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_h"))
    kept = keyed.join(gone, same, "left_anti")
    single = kept.join(repeated, same, "left_anti").select("_row")
    once = kept.join(repeated, same, "left_semi").groupBy("doc_id", "_h").agg(F.min("_row").alias("_row")).select("_row")
    return own.unpacked(single.unionByName(once))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: words of 50-word windows that a document with a smaller id also has are cut out; a text without any stays as it is."""
    own = Carried(docs, ())
    found = remove_repeats(docs.select(own.packed, "doc_id", "text"), window=50)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select(*[F.when(F.col("n_removed") > 0, new[c]).otherwise(F.col(f"_row.`{c}`")).alias(c) if c in new else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that hold 10 consecutive words of a benchmark item, or a whole shorter one, go."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: how often the mix takes each document."""
    return mix(docs, weights=(3, 1, 2), share=1.5, most=2).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_benchmark_text),
    ("mixing", mix_sources),
]

#: The first stage trains a model, which SQL cannot express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):  # each stage's own intermediate tables go when its result is written; so do the results
        for _, stage in STAGES:
            with scratch(spark):
                docs = cut(stage(spark, docs, sf_dir), keep=True)
        return cut(docs, keep=True)
