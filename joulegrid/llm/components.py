"""Connected components on edge tables by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from joulegrid.llm.common import discard, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node points its larger (or all) neighbours to the smallest one it knows.

    The minimum per node is a combining aggregate and the neighbours join it, so a node with very many
    neighbours is never gathered: the join splits it.
    """
    around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = around.join(least, "a")
    if large:
        moved = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links between comparable ids -> (node, root), root the smallest id of the component.

    Nodes without a link don't appear; self links and repeated links are harmless; an empty table gives an
    empty result. Rounds grow with the logarithm of the longest chain; each is written to the shared folder.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while not _is_stars(now):
        grown = stored(_star(now, large=True))
        after = stored(_star(grown, large=False))
        discard(grown, now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _is_stars(edges: DataFrame) -> bool:
    """True when every node has one link and no centre has a link of its own."""
    several = edges.groupBy("a").count().where("count > 1").select("a")
    chained = edges.select(F.col("b").alias("a")).distinct().join(edges.select("a"), "a", "left_semi")
    return several.limit(1).unionAll(chained.limit(1)).isEmpty()
