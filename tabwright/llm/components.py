"""Connected components of an edge table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import by_rows, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of (a, b): the smallest node of its component.

    Each round gives a node, and the node it is labelled with, the smallest label next to it, and then the label of that
    label; components of n nodes settle in about log n rounds. Every aggregate combines on the map side and every round
    is written, so neither a node with very many edges nor a lost executor is a problem. No edges give an empty table.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        beside = both.join(by_rows(labels.select(F.col("node").alias("b"), F.col("label").alias("next"))), "b").groupBy("a").agg(F.min("next").alias("next"))
        offers = labels.join(by_rows(beside.withColumnRenamed("a", "node")), "node").select("node", "label", F.least("label", "next").alias("next"))
        best = (offers.select("node", "next").unionByName(offers.select(F.col("label").alias("node"), "next"))
                .groupBy("node").agg(F.min("next").alias("next")))
        jump = best.select(F.col("node").alias("next"), F.col("next").alias("far"))
        new = best.join(by_rows(jump), "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"))
        new = written(new, "labels")
        changed = new.join(by_rows(labels.withColumnRenamed("label", "was")), "node").where("label != was").limit(1).count()
        labels = new
        if not changed:
            return labels
