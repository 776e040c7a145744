"""Connected components of a table of links, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.llm.common import stash


def connected_components(links: DataFrame, made: list[str] | None = None) -> DataFrame:
    """(node, root) for every node of links (a, b), root the smallest node of its component.

    Each round, every node that has a smaller neighbour points to the smallest; pointers never rise, so they form trees, which pointer
    jumping flattens.  Links between roots remain for the next round.  Rounds and jumps are logarithmic in the longest chain; only
    whether any link is left goes to the driver.  Loops (a, a) and repeated links don't matter; no links give no rows.
    made: gets the paths of the tables written.
    """
    edges = stash(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), made)
    roots = None
    while not edges.isEmpty():
        up = _flatten(stash(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), made), made)
        nodes = up
        # nodes without a smaller neighbour are roots of themselves for now
        if roots is None:
            tops = up.select(F.col("root").alias("node")).distinct().join(up, "node", "left_anti")
            roots = stash(nodes.unionByName(tops.withColumn("root", F.col("node"))), made)
        else:
            moved = up.select(F.col("node").alias("root"), F.col("root").alias("_to"))
            roots = stash(roots.join(moved, "root", "left").select("node", F.coalesce("_to", "root").alias("root")), made)
        edges = stash(
            _renamed(_renamed(edges, up, "a"), up, "b")
            .filter(F.col("a") != F.col("b"))
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .distinct(),
            made,
        )
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _renamed(edges: DataFrame, up: DataFrame, side: str) -> DataFrame:
    to = up.select(F.col("node").alias(side), F.col("root").alias("_to"))
    other = "b" if side == "a" else "a"
    return edges.join(to, side, "left").select(F.coalesce("_to", side).alias(side), other)


def _flatten(up: DataFrame, made: list[str] | None) -> DataFrame:
    """Follow the pointers (node, root) to their ends."""
    while True:
        over = up.select(F.col("node").alias("root"), F.col("root").alias("_to"))
        jumped = stash(up.join(over, "root", "left").select("node", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("_moved")), made)
        up = jumped.select("node", "root")
        if jumped.filter("_moved").isEmpty():
            return up
