"""Connected components of an edge table by contraction to local minima."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.operators.skew import attach
from postmill.sources.scratch import materialise


def _roots(edges: DataFrame, n_edges: int) -> DataFrame:
    """``(v, root)``: follow, from every vertex, the lowest neighbour down to a vertex without a lower one.

    Parents are resolved by pointer jumping, so a path of n vertices takes log2(n) steps.
    """
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(
        edges.select(F.col("b").alias("v"), F.col("a").alias("u"))
    )
    parents = both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("p"))
    state = materialise(parents.withColumn("done", F.col("v") == F.col("p")), "parents")
    settled = []
    while True:
        settled.append(state.where("done").select("v", F.col("p").alias("root")))
        open_rows = state.where("not done").select("v", "p")
        if open_rows.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        known = reduce(DataFrame.unionByName, [s.select("v", F.col("root").alias("p"), F.lit(True).alias("done")) for s in settled])
        steps = known.unionByName(open_rows.withColumn("done", F.lit(False)))
        steps = steps.select(F.col("v").alias("p"), F.col("p").alias("next"), "done")
        jumped = attach(open_rows, steps, "p", "inner", big_rows=2 * n_edges).select("v", F.col("next").alias("p"), "done")
        state = materialise(jumped, "parents")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for every vertex of the edge table; a component is named by its lowest id.

    Each round replaces every vertex by the root of its tree and drops edges inside a tree, which at least
    halves the vertices that still have edges. Every round is written, so lost executors cost one round.
    """
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    edges = materialise(pairs.distinct(), "edges")
    rounds = []
    n_edges = most = edges.count()
    while n_edges:
        roots = materialise(_roots(edges, n_edges), "roots")
        rounds.append(roots)
        lifted = attach(edges, roots.select(F.col("v").alias("a"), F.col("root").alias("ra")), "a", "inner", n_edges)
        lifted = attach(lifted, roots.select(F.col("v").alias("b"), F.col("root").alias("rb")), "b", "inner", n_edges)
        across = lifted.where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b"))
        edges = materialise(across.distinct(), "edges")
        n_edges = edges.count()
    if not rounds:
        return pairs.select(F.col("a").alias("id"), F.col("b").alias("component"))
    final = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        later = final.select(F.col("v").alias("root"), F.col("root").alias("last"))
        final = attach(earlier, later, "root", big_rows=2 * most).select("v", F.coalesce("last", "root").alias("root"))
    return final.select(F.col("v").alias("id"), F.col("root").alias("component"))
