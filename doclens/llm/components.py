"""Connected components of an edge table by a contraction to centres, minimum labels and pointer jumping, with joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.llm.common import cut, discard

#: Rows of a task's share of the graph, about; tasks at least.
ROWS_A_TASK, TASKS = 1 << 18, 8


def tasks_for(rows: int) -> int:
    """A number of tasks for a table of so many narrow rows: a shuffle may have many more parts, whose tasks would be nearly empty."""
    return max(TASKS, rows // ROWS_A_TASK)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, label (a node of the component, the same for all of it) for every node of edges (a long, b long).

    An `a` should have few edges, as it is brought together with them; a `b` may have any number. Of the b of an a one stands
    for it; the others are joined to that one, and so is the a if it is a b elsewhere. What is left has the b alone as its
    nodes: where stars overlap, as those of near copies do, it is far smaller than the edges, and the rounds are over it.
    edges are read three times, so they should be a written table.
    """
    edges = edges.filter("a <> b")
    ends = edges.select("a", "b", F.lit(False).alias("hub")).unionByName(edges.select(F.col("b").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(True).alias("hub")))
    stars = ends.groupBy("a").agg(F.min("b").alias("m"), F.collect_set("b").alias("all"), F.max("hub").alias("hub"))
    few = tasks_for(edges.count())
    stars = cut(stars.coalesce(few), "stars")
    others = F.explode(F.when(F.col("hub"), F.array_append("all", F.col("a"))).otherwise(F.col("all")))
    between = _labels(stars.filter("m IS NOT NULL").select(others.alias("a"), F.col("m").alias("b")), few, most_rounds)
    of = stars.select(F.col("a").alias("node"), F.when(F.col("hub"), F.col("a")).otherwise(F.col("m")).alias("centre"))
    return cut(of.join(between.withColumnRenamed("node", "centre"), "centre", "left").select("node", F.coalesce("label", "centre").alias("label")).coalesce(few), "labels")


def _labels(edges: DataFrame, few: int, most_rounds: int) -> DataFrame:
    """node, label (the smallest node reachable) for every node of edges.

    Each round takes the smallest label among a node's neighbours, then the label of that label, so long chains shorten
    by halves. Labels are written to the shared folder each round, which also ends the lineage. The joins are on written
    tables, so that Spark can split the centre of a star and a label that many nodes share.
    """
    once = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().coalesce(few)
    both = cut(once.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*"), "edges")
    few = tasks_for(both.count())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")).coalesce(few), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near")).coalesce(few)
        least = cut(labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")).coalesce(few), "labels")
        of = least.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = cut(least.join(of, "label").select("node", "old", F.least("label", "next").alias("label")).coalesce(few), "labels")
        discard(labels, least)
        labels = jumped.select("node", "label")
        labels._scratch = jumped._scratch
        if jumped.filter("old <> label").isEmpty():
            discard(both)
            return labels
    raise RuntimeError(f"components: labels still change after {most_rounds} rounds")
