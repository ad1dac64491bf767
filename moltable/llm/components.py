"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltable.runtime import stage

ROUNDS_BY_ID = 2  # rounds that prefer small nodes before the order becomes random


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node that can be reached.

    Each round hooks every node to the first of itself and its neighbours, and that to its own hook, and then replaces both
    ends of all ties by their hooks: a tie whose ends are one is gone, equal ties are one. A tie and its image
    join the same components, so the graph shrinks and nothing is lost. "First" is the smallest node for two
    rounds, which settles stars, and the smallest hash of node and round after them, where a node is the first of its
    neighbourhood with a chance of one half at most: the number of rounds grows with the logarithm of
    the longest chain. Hooks and ties are written in the shared folder every round; the driver learns one
    number: whether ties are left. Minima are partial before the shuffle, so a hub costs a row per
    task; no join makes more rows than there are ties.
    """
    ties = edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    ties = stage(ties.distinct(), "ties")
    hooks: list[DataFrame] = []
    while True:
        turn = len(hooks)
        key = F.col("next") if turn < ROUNDS_BY_ID else F.xxhash64("next", F.lit(turn))
        sides = ties.select(F.col("a").alias("node"), F.col("b").alias("next")).union(ties.select("b", "a"))
        near = sides.union(ties.select("a", "a")).union(ties.select("b", "b"))
        first = near.groupBy("node").agg(F.min(F.struct(key.alias("key"), "next")).alias("first"))
        hook = stage(first.select("node", F.col("first.next").alias("next")), "hooks")
        further = hook.select(F.col("node").alias("next"), F.col("next").alias("second"))
        hook = stage(hook.join(further, "next").select("node", F.col("second").alias("next")), "hooks")
        hooks.append(hook)
        left = ties.join(hook.select(F.col("node").alias("a"), F.col("next").alias("_a")), "a")
        both = left.join(hook.select(F.col("node").alias("b"), F.col("next").alias("_b")), "b").where("_a <> _b")
        ties = stage(both.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "ties")
        if ties.isEmpty():
            break
    ends = hooks[0]
    for hook in hooks[1:]:
        ends = ends.join(hook.select(F.col("node").alias("next"), F.col("next").alias("then")), "next", "left")
        ends = ends.select("node", F.coalesce("then", "next").alias("next"))
    ends = stage(ends, "ends")
    least = ends.groupBy("next").agg(F.min("node").alias("component"))
    return ends.join(least, "next").select("node", "component")
