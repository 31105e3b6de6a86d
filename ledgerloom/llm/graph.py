"""Connected components by joins, for the links that the operators of this subpackage find."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.session import discard, materialise


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` of every node of ``edges`` (a, b); the component is its smallest node.

    Large-star and small-star rounds: each node links its neighbours to its smallest neighbour, so
    a component that holds a third of all nodes never becomes one row or one task, and the number
    of rounds grows with the logarithm of its size. Rounds end as soon as every component is a star. Every round is written to the shared folder, and the one before deleted.
    """
    links = materialise(edges.select("a", "b").filter("a <> b").distinct(), "links")
    if links.isEmpty():
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(most_rounds):
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        kept = least.filter("m < a").select("a", F.col("m").alias("b"))
        down = large.unionAll(kept).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        down = materialise(down, "star")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        old, links = links, materialise(small.filter("a <> b").distinct(), "links")
        discard(old, down)
        # done when all are stars: no node has two links or is linked to from one that has a link itself
        ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(links.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty():
            break
    else:
        raise RuntimeError("components did not converge")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
