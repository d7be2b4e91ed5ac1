"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) of every node that has a link to another.

    In each round a node points to its smallest neighbour, if that is smaller, and on to where
    those pointers end; links are rewritten to what their ends point to, and repeated ones
    and loops go. What pointers end at is smaller than all its neighbours, so at least half of the
    nodes go with each round, and a star or a chain in one. The tables of all rounds are then
    put together from the smallest to the largest. Nothing leaves the executors; a node
    with many links only makes a skewed join, which is split.
    """
    left = checkpointed(ordered(links.select(F.col(a).alias("x"), F.col(b).alias("y"))))
    rounds: list[DataFrame] = []
    while not rounds or left.limit(1).count():
        both = left.unionByName(left.select(F.col("y").alias("x"), F.col("x").alias("y")))
        ends = ended(checkpointed(both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("q"))))
        rounds.append(ends)
        x = left.join(ends, "x").select(F.col("q").alias("x"), "y")
        left = checkpointed(ordered(x.join(ends.select(F.col("x").alias("y"), F.col("q").alias("r")), "y").select("x", F.col("r").alias("y"))))
    out = rounds.pop()
    while rounds:
        # what a later round does not name has reached its component
        out = rounds.pop().join(out.select(F.col("x").alias("q"), F.col("q").alias("r")), "q", "left").select("x", F.coalesce("r", "q").alias("q"))
    return out.select(F.col("x").alias("node"), F.col("q").alias("component"))


def ended(to: DataFrame) -> DataFrame:
    """x, q of pointers (x, q) that never rise: q is where the pointers from x end. Chains are cut to a third each time."""
    while True:
        two = to.join(to.select(F.col("x").alias("q"), F.col("q").alias("q2")), "q").select("x", "q2")
        three = two.join(to.select(F.col("x").alias("q2"), F.col("q").alias("q3")), "q2")
        three = checkpointed(three.select("x", F.col("q3").alias("q"), (F.col("q2") != F.col("q3")).alias("moved")))
        to = three.select("x", "q")
        if not three.where("moved").limit(1).count():
            return to


def ordered(links: DataFrame) -> DataFrame:
    """Each link between different nodes once, the smaller end first."""
    return links.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
