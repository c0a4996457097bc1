"""Connected components of links between rows, in rounds of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durable import written


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``; root is the least node of its component.

    In each round every node that has a smaller neighbour hooks to its least one, chains of hooks are halved until none is
    left, and links are contracted to the roots. A chain of any length is one round, and each round at least joins
    every node that is not a local minimum. Nodes may be of any type that can be ordered. A null end links nothing.
    More than ``rounds`` raise.
    """
    links = written(links.filter("a <> b").select("a", "b").distinct())
    tree = None
    for _ in range(rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("node"), "root"))
        while hooks.alias("x").join(hooks.filter("node <> root").alias("y"), F.col("x.root") == F.col("y.node")).take(1):
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("top"))
            hooks = written(hooks.join(up, "root").select("node", F.col("top").alias("root")))
        if tree is None:
            tree = hooks
        else:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("top"))
            tree = written(tree.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        ends = [hooks.toDF(c, f"root_{c}") for c in ("a", "b")]
        links = written(links.join(ends[0], "a").join(ends[1], "b").filter("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct())
        if not links.take(1):
            return tree
    raise RuntimeError(f"components did not settle in {rounds} rounds")
