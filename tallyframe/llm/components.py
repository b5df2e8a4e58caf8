"""Connected components of a table of links, by contraction in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.tables import drop, keep


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b).

    In each round every node moves to the neighbour that comes first in a new random order, so a fixed share of the
    nodes goes whatever the shape of the graph. Degrees do not matter: neighbours meet in combining aggregates.
    """
    edges = keep(links.filter(F.col("a") != F.col("b")).select("a", "b").distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    root = keep(nodes.select("node", F.col("node").alias("root")))
    turn = 0
    while not edges.isEmpty():
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("r"), F.col(c).alias("to"))  # noqa: E731, B023
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = both.groupBy("a").agg(F.min(rank("b")).alias("best")).select("a", F.least("best", rank("a"))["to"].alias("to"))
        move = keep(move.filter(F.col("to") != F.col("a")))
        at = lambda side: move.select(F.col("a").alias(side), F.col("to").alias(f"{side}_to"))  # noqa: E731, B023
        merged = keep(
            edges.join(at("a"), "a", "left").join(at("b"), "b", "left")
            .select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"))
            .filter(F.col("a") != F.col("b"))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        )
        moved = keep(root.join(at("root"), "root", "left").select("node", F.coalesce("root_to", "root").alias("root")))
        drop(edges, root, move)
        edges, root = merged, moved
    drop(edges)
    return root
