"""Connected components by contraction, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Gives node, label for every node of an edge between different nodes; the label is
    the smallest node reachable.

    Each round points every node to its smallest neighbour (or itself), follows pointers twice and
    contracts the edges; a round at least halves the longest path of pointers. Aggregates are partial,
    so a node with very many edges is no single task's work. Every round is written to the shared
    folder, so lost executors cost one round at most.
    """
    e = edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = materialize(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    found = None
    while True:
        if e.isEmpty():
            return found if found is not None else e.select(F.col("a").alias("node"), F.col("b").alias("label"))
        step = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p"))
        step = materialize(step, "cc-step")
        second = step.select(F.col("a").alias("p"), F.col("p").alias("q"))
        jump = materialize(step.join(second, "p").select("a", "q"), "cc-jump")  # every node has a pointer
        release(step)
        if found is None:
            found = materialize(jump.select(F.col("a").alias("node"), F.col("q").alias("label")), "cc-labels")
        else:
            moved = found.join(jump.select(F.col("a").alias("label"), F.col("q").alias("to")), "label", "left")
            last, found = found, materialize(moved.select("node", F.coalesce("to", "label").alias("label")), "cc-labels")
            release(last)
        to_a, to_b = jump.select("a", F.col("q").alias("x")), jump.select(F.col("a").alias("b"), F.col("q").alias("y"))
        left = e.join(to_a, "a").join(to_b, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        last, e = e, materialize(left, "cc-edges")
        release(last, jump)
