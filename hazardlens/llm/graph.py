"""Connected components of an edge table, by repeated contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlens.llm.common import store


def connected_components(edges: DataFrame, folder: str) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; nodes of one component share a root.

    Each round every node points to its smallest neighbour or itself, pointers are
    followed to their end, and edges are contracted onto the ends. Every node with an
    edge is joined with another one, so the nodes at least halve per round. Rounds are
    written below ``folder``; nothing is collected.
    """
    edges = store(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), f"{folder}/edges-0")
    roots = None
    number = 0
    while not edges.isEmpty():
        number += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
        parents = store(
            smallest.select("node", F.least("node", "b").alias("root")), f"{folder}/parents-{number}-0"
        )
        hop = 0
        while True:
            # A pointer that leads to a node which points on is moved on by one hop.
            hop += 1
            ahead = parents.select(F.col("node").alias("root"), F.col("root").alias("next"))
            parents = store(
                parents.join(ahead, "root")
                .select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")),
                f"{folder}/parents-{number}-{hop}",
            )
            moved = not parents.filter("moved").isEmpty()
            parents = parents.drop("moved")
            if not moved:
                break
        end_a = parents.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        end_b = parents.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        edges = store(
            edges.join(end_a, "a").join(end_b, "b").filter("root_a <> root_b")
            .select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(),
            f"{folder}/edges-{number}",
        )
        if roots is None:
            roots = parents
        else:
            later = parents.select(F.col("node").alias("root"), F.col("root").alias("later"))
            roots = store(
                roots.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root")),
                f"{folder}/roots-{number}",
            )
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
