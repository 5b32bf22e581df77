"""Connected components of links, with no group collected anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hangs the larger (or all smaller) neighbours of each node below its least neighbour."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # ``a`` is the node; with ``small`` all its neighbours are smaller already.
    least = both.groupBy("a").agg(F.min("b").alias("low"))
    low = F.least("a", "low")
    hung = both.join(least, "a").select(F.col("b").alias("node"), "a", low.alias("low"))
    if small:
        moved = hung.select(F.col("node").alias("a"), F.col("low").alias("b")).unionByName(
            least.select("a", F.col("low").alias("b"))
        )
    else:
        moved = hung.filter("node > a").select(F.col("node").alias("a"), F.col("low").alias("b"))
    return moved.filter("a != b").distinct()


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """``node, root`` of every node of ``links (a, b)``: the least node that it reaches.

    Alternates hanging larger and smaller neighbours below the least one, which keeps the
    components and ends in stars, in about log(n) rounds; each round is stored, so that a lost
    executor never repeats earlier ones. Links may repeat; links of a node to itself, or with
    null, are ignored.
    """
    ordered = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stored(ordered.distinct(), "links")
    seen = None
    for _ in range(rounds):
        edges = stored(_star(_star(edges, small=False), small=True), "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
