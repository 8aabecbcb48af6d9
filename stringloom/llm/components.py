"""Connected components by contraction, with aggregates and joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.session import cut


def _follow(rows: DataFrame, steps: DataFrame, column: str, *others: str) -> DataFrame:
    """(node, column, *others) with ``column`` replaced by its next step (_n, _to), if it has one. Many nodes can
    point to one; such rows are a few bytes each, and adaptive execution splits the left side of an outer join."""
    return rows.join(steps, F.col(column) == F.col("_n"), "left").select("node", F.coalesce("_to", column).alias(column), *others)


def _to_ends(hooked: DataFrame) -> DataFrame:
    """(node, to) with hooks, which always fall, followed to their ends."""
    while True:
        onward = hooked.select(F.col("node").alias("_n"), F.col("to").alias("_to"))
        stepped = cut(_follow(hooked.withColumn("_was", F.col("to")), onward, "to", "_was"))
        if stepped.filter("to <> _was").isEmpty():
            return stepped.select("node", "to")
        hooked = stepped.select("node", "to")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a bigint, b bigint); a component is its smallest node.

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends by doubling (a chain of
    n nodes takes log n steps), and contracts the edges, until none is left. Rounds are cut to shared storage.
    """
    left = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    for _ in range(most_rounds):
        if left.isEmpty():
            break
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("node"), F.least("a", "to").alias("to"))
        hooked = cut(hooked)
        stepped = _to_ends(hooked)
        maps.append(stepped)
        a = stepped.select(F.col("node").alias("a"), F.col("to").alias("x"))
        b = stepped.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = left.join(a, "a").join(b, "b").filter("x <> y")
        left = cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = maps[0].select("node", F.col("to").alias("component"))
    for step in maps[1:]:
        nodes = step.select(F.col("node").alias("_n"), F.col("to").alias("_to"))
        found = _follow(found, nodes, "component")
    return cut(found)
