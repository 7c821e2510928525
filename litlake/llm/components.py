"""Connected components by contraction: each vertex merges into its least neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litlake.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """Per vertex of ``edges`` (u, v longs): vertex, component (a vertex of the same component).

    A round maps every edge to the least neighbours of its ends and drops loops, so
    at least half of the vertices that still have edges go. Minima combine before
    the shuffle, hence a vertex with very many edges isn't one task's work.
    """
    both = written(edges.select("u", "v").where("u <> v").distinct(), "links")
    both = written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = None
    while not both.isEmpty():
        least = both.groupBy("u").agg(F.min("v").alias("v"))
        least = least.select(F.col("u").alias("vertex"), F.least("u", "v").alias("least"))
        least = written(least, "least")
        if labels is None:
            labels = least.select("vertex", F.col("least").alias("component"))
        else:
            step = least.select(F.col("vertex").alias("component"), "least")
            labels = labels.join(step, "component", "left").select(
                "vertex", F.coalesce("least", "component").alias("component")
            )
        labels = written(labels, "labels")
        of_u = least.select(F.col("vertex").alias("u"), F.col("least").alias("pu"))
        of_v = least.select(F.col("vertex").alias("v"), F.col("least").alias("pv"))
        both = both.join(of_u, "u").join(of_v, "v").where("pu <> pv")
        both = written(both.select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), "edges")
    if labels is None:
        return both.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return labels
