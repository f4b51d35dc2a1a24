"""Connected components of links by contraction.

In a round each node points to the neighbour that comes first in an order drawn anew for the round, if that comes before
itself, and takes what its own choice points to as its label. Links between labels go on to the next round, so the
graph shrinks by a share of its nodes each time, however long its paths are. Choices are grouped minima, which combine
before the shuffle: a node with very many links meets in no task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._run import cut


def _contracted(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """node, label of each node that the edges name, and the edges between different labels."""

    def key(c: str) -> Column:
        return F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("order"), F.col(c).alias("node"))

    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = both.groupBy("a").agg(F.min(key("b")).alias("first")).select(F.col("a").alias("node"), F.least(key("a"), "first")["node"].alias("to"))
    labels = cut(first.join(first.select(F.col("node").alias("to"), F.col("to").alias("label")), "to").select("node", "label"))
    one, two = (labels.select(F.col("node").alias(c), F.col("label").alias(f"_{c}")) for c in "ab")
    mapped = edges.join(one, "a").join(two, "b").where("_a != _b")
    return labels, cut(mapped.select(F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b")).distinct())


def followed(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """df with the column's nodes replaced by their labels (node, label), where they have one."""
    to = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    found = df.join(to, F.col(column) == F.col("_node"), "left")
    return found.select(*[F.coalesce("_label", column).alias(c) if c == column else F.col(c) for c in df.columns])


def settled(edges: DataFrame, most_rounds: int = 60) -> DataFrame | None:
    """edges (a long, b long) -> node, label: one label for all nodes that links join; None without edges between different nodes."""
    edges = edges.where("a != b")
    out = None
    for turn in range(most_rounds):
        if edges.isEmpty():
            return out
        labels, edges = _contracted(edges, turn)
        out = labels if out is None else cut(followed(out, "label", labels))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a long, b long) -> node, root: the least node that links reach; least nodes themselves and nodes without a link to another are left out."""
    found = settled(cut(edges.select("a", "b")), most_rounds)
    if found is None:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    least = found.groupBy("label").agg(F.min("node").alias("root"))
    return found.join(least, "label").where("node != root").select("node", "root")
