"""Connected components over edges of any number, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import checkpointed, dropped


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """(node, root): the smallest node of each node's component, from edges (a, b).

    In each round every node goes over to the neighbour (or itself) that a hash drawn anew puts first, and the edges are
    contracted accordingly, so they shrink by a constant factor whatever the shape of the graph; a round's nodes and
    edges are written to the checkpoint folder. Nodes without an edge have no row. Null ends and loops are left out.
    Raises an error if edges are left after ``most`` rounds; an unfinished result is never returned.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    steps = []
    for k in range(most):
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        near = both.groupBy("a").agg(F.min(rank("b")).alias("x"))
        step = checkpointed(near.select(F.col("a").alias("node"), F.least(rank("a"), F.col("x"))["v"].alias("to")))
        steps.append(step)
        left, right = step.select(F.col("node").alias("a"), F.col("to").alias("ta")), step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        rest = checkpointed(both.join(left, "a").join(right, "b").where("ta <> tb").select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct())
        dropped(both)
        both = rest
        if both.isEmpty():
            break
    else:
        raise RuntimeError(f"components are unfinished after {most} rounds")
    roots = steps[-1]
    for step in reversed(steps[:-1]):
        further = roots.select(F.col("node").alias("at"), F.col("to").alias("end"))
        roots = step.join(further, step["to"] == further["at"], "left").select("node", F.coalesce("end", "to").alias("to"))
    lowest = roots.groupBy("to").agg(F.min("node").alias("root"))
    return roots.join(lowest, "to").select("node", "root")
