"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import stash


def _roots(parents: DataFrame) -> DataFrame:
    """(node, parent) with each parent the last of its chain, by doubling."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
        moved = stash(
            parents.join(up, "parent", "left").select(
                "node", F.coalesce("_up", "parent").alias("parent"),
                F.col("_up").isNotNull().alias("moved"),
            ),
            "parents",
        )
        parents = moved.select("node", "parent")
        if moved.filter("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """`node` and `component`, the smallest node it reaches, for all nodes of links (a, b).

    In each round every node points to its smallest neighbour below it, the chains of pointers are
    followed to their ends, and links between different ends go on to the next round.
    """
    edges = stash(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select(
        "node", F.col("node").alias("component")
    )
    while not edges.isEmpty():
        roots = _roots(
            stash(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")), "near")
        )
        to = roots.select(F.col("node").alias("component"), F.col("parent").alias("_to"))
        labels = stash(
            labels.join(to, "component", "left").select(
                "node", F.coalesce("_to", "component").alias("component")
            ),
            "labels",
        )
        to_a = roots.select(F.col("node").alias("a"), F.col("parent").alias("_a"))
        to_b = roots.select(F.col("node").alias("b"), F.col("parent").alias("_b"))
        moved = (
            edges.join(to_a, "a", "left")
            .join(to_b, "b", "left")
            .select(F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y"))
            .filter("x <> y")
        )
        edges = stash(
            moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(),
            "edges",
        )
    return labels
