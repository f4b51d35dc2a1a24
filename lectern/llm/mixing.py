"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each source gets a target of words from its weight; what is over ``most`` times its size is shared out again by
weight until no target is above. Among all document rates between 0 and ``most`` that meet the targets, entropy
balancing takes those nearest to even odds in relative entropy. Its convex dual has one multiplier a source; the rates
are exponentially tilted: most / (1 + exp(-multiplier * size / mean size)). Newton iterations solve the dual. Each is
one grouped aggregation over all sources, on (source, size, number of documents) instead of documents, and keeps to a
bracket, so it converges from any start; targets that are still missed after ``most_rounds`` raise RuntimeError.

Rates become whole copies by rounding running sums over documents sorted by size, so a source's error stays below one
long document; then, a few times, the one copy more or less that brings the source nearest to its target is made. All
of this happens on cells of equal size, split so that none has more than ``cell_rows`` documents; documents only join
their cell at the end and the first of it by a hash of the id (of the text where that is null) take the odd copies.

Cases: texts of any length; null or empty text has size 0 and is never taken. Null sources are one source, the last. A source without
words has target 0. Null ids and repeated rows are documents like others. Other columns are not looked at. An empty
table gives an empty result. The same rows give the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._run import cut


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in text; null counts as empty."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "x")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size -> with target. The level at which weight * level, cut at most * size, sums up to the share."""
    code_point = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    nth = (F.row_number().over(code_point) - 1) % len(weights) + 1
    weight = F.element_at(F.array(*map(F.lit, weights)), nth).cast("double")
    fills = Window.orderBy("ratio", F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    before, all_ = fills.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))  # of this source and all after it
    x = sources.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("limit") / F.col("weight"))
    x = x.withColumn("total", F.sum("source_size").over(all_) * F.lit(float(share)))
    x = x.withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / rest)
    x = x.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(all_)["level"])
    return x.select("source", "source_size", F.least("limit", F.coalesce(F.col("weight") * F.col("level"), F.col("limit"))).alias("target"))


def _rate(tilt: Column, size: Column, mean: Column, most: float) -> Column:
    return F.lit(float(most)) / (1 + F.exp(-F.greatest(F.least(tilt * size / mean, F.lit(60.0)), F.lit(-60.0))))


def solve(cells: DataFrame, goals: DataFrame, most: float = 2.0, tolerance: float = 1e-7, most_rounds: int = 60) -> DataFrame:
    """cells (source, size, n), goals (source, target, mean) -> source, tilt: Newton's method on the dual, within a bracket."""
    state = cut(goals.select("source", "target", "mean", F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(None).cast("double").alias("off")))
    for _ in range(most_rounds):
        rate = _rate(F.col("tilt"), F.col("size"), F.col("mean"), most)
        words = F.col("n") * F.col("size")
        at = cells.join(state.select(F.col("source").alias("s"), "mean", "tilt"), F.col("source").eqNullSafe(F.col("s")))
        sums = at.groupBy("s").agg(F.sum(words * rate).alias("got"), F.sum(words * rate * (1 - rate / most) * F.col("size") / F.col("mean")).alias("slope"))
        x = state.join(sums, F.col("source").eqNullSafe(F.col("s")))
        over = F.col("got") - F.col("target")
        lo, hi = F.when(over <= 0, F.col("tilt")).otherwise(F.col("lo")), F.when(over >= 0, F.col("tilt")).otherwise(F.col("hi"))
        x = x.withColumn("lo", lo).withColumn("hi", hi).withColumn("step", F.col("tilt") - over / F.greatest("slope", F.lit(1e-300)))
        far = F.greatest(F.abs("tilt") * 2, F.lit(1.0))
        inside = (F.col("step") > F.coalesce("lo", F.col("tilt") - far)) & (F.col("step") < F.coalesce("hi", F.col("tilt") + far))
        other = F.when(F.col("lo").isNull(), F.col("hi") - far).when(F.col("hi").isNull(), F.col("lo") + far).otherwise((F.col("lo") + F.col("hi")) / 2)
        off = F.abs(over) / F.greatest("target", F.lit(1.0))
        settled = off <= tolerance
        state = cut(x.select("source", "target", "mean", F.when(settled, F.col("tilt")).when(inside, F.col("step")).otherwise(other).alias("tilt"), "lo", "hi", off.alias("off")))
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst <= tolerance:
            return state.select("source", "tilt")
    raise RuntimeError(f"Newton iterations left a target missed by a share of {worst:.2g} after {most_rounds} rounds")


def _nudged(cells: DataFrame, most: int) -> DataFrame:
    """One copy more or less of the cell that brings each source nearest to its target, if nearer than now."""
    gap = F.first("target") - F.sum(F.col("m") * F.col("size"))
    short = cells.groupBy("source").agg(gap.alias("gap")).select(F.col("source").alias("s"), "gap")
    x = cells.join(short, F.col("source").eqNullSafe(F.col("s")))
    can = F.when(F.col("gap") > 0, F.col("m") < most * F.col("n")).otherwise(F.col("m") > 0) & (F.col("size") > 0)
    left = F.when(can, F.abs(F.abs("gap") - F.col("size")))
    x = x.withColumn("left", left).withColumn("pick", F.struct("left", "size", "part"))
    best = x.where(F.col("left") < F.abs("gap")).groupBy(F.col("source").alias("b")).agg(F.min("pick").alias("best"))
    x = x.drop("s").join(best, F.col("source").eqNullSafe(F.col("b")), "left")
    here = F.coalesce((F.col("best.size") == F.col("size")) & (F.col("best.part") == F.col("part")), F.lit(False))
    return x.select("source", "size", "part", "n", "target", "source_size", F.when(here, F.col("m") + F.when(F.col("gap") > 0, 1).otherwise(-1)).otherwise(F.col("m")).alias("m"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5, most: int = 2, cell_rows: int = 4096, nudges: int = 3,
) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken (copies * size) of every document."""
    draw = F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col))).otherwise(F.xxhash64(F.col(id_col)))
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), draw.alias("draw")))
    plain = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = plain.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    goals = cut(targets(sources.select("source", "source_size"), weights, share, float(most)))
    shape = sources.select(F.col("source").alias("s"), "docs")
    open_ = goals.join(shape, F.col("source").eqNullSafe(F.col("s"))).where((F.col("target") > 0) & (F.col("target") < F.col("source_size") * float(most) * (1 - 1e-12)))
    tilts = solve(plain, open_.select("source", "target", (F.col("source_size") / F.col("docs")).alias("mean")), float(most))

    parts = F.ceil(F.col("n") / cell_rows)
    spread = F.col("parts") > 1
    keyed = sized.join(plain.select(F.col("source").alias("s"), F.col("size").alias("z"), parts.alias("parts")), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    keyed = keyed.select("doc_id", "source", "size", "draw", F.when(spread, F.pmod("draw", F.col("parts"))).otherwise(F.lit(0).cast("long")).alias("part"))
    cells = keyed.groupBy("source", "size", "part").agg(F.count("*").alias("n"))
    g = goals.select(F.col("source").alias("g"), "source_size", "target")
    t = tilts.select(F.col("source").alias("t"), "tilt")
    m = shape.select(F.col("s").alias("h"), "docs")
    cells = cells.join(g, F.col("source").eqNullSafe(F.col("g"))).join(m, F.col("source").eqNullSafe(F.col("h"))).join(t, F.col("source").eqNullSafe(F.col("t")), "left")
    tilted = _rate(F.col("tilt"), F.col("size"), F.col("source_size") / F.col("docs"), float(most))
    rate = F.when((F.col("size") == 0) | (F.col("target") <= 0), F.lit(0.0)).when(F.col("tilt").isNull(), F.lit(float(most))).otherwise(tilted)
    to = F.sum(F.col("n") * F.col("rate")).over(Window.partitionBy("source").orderBy("size", "part").rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumn("rate", rate).withColumn("to", to)
    before = F.lag("up", 1, 0.0).over(Window.partitionBy("source").orderBy("size", "part"))
    cells = cells.withColumn("up", F.floor(F.col("to") + 0.5 + 1e-9)).withColumn("m", F.greatest(F.least(F.col("up") - before, most * F.col("n")), F.lit(0)).cast("long"))
    cells = cut(cells.select("source", "size", "part", "n", "target", "source_size", "m"))
    for _ in range(nudges):
        cells = cut(_nudged(cells, most))

    c = cells.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("p"), "n", "m", "target", "source_size")
    found = keyed.join(c, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("part") == F.col("p")))
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("draw", "doc_id"))
    copies = (F.floor(F.col("m") / F.col("n")) + F.when(rank <= F.col("m") % F.col("n"), 1).otherwise(0)).cast("int")
    return found.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source"
    )
