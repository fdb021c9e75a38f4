"""Connected components of a large sparse graph, as joins and aggregations.

Large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond",
SoCC 2014) on a table of directed edges.  Minima are aggregated map-side and joined back, so a node
with very many neighbours is no single task's work; each round is written to the shared checkpoint
folder, which also ends its lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize_counted


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u > v): neighbours of a node are linked to the smallest one around it."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = around.join(least, "u")
    if large:
        return linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    own = least.filter(F.col("m") < F.col("u")).select("u", F.col("m").alias("v"))
    rest = linked.filter(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(rest).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges(u, v)`` other than the roots themselves.

    The root is the smallest node of the component.  Loops and repeated or reversed edges are fine.
    """
    digest = {"digest": F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))}
    current = (
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") > F.col("v")).distinct()
    )
    current, seen = materialize_counted(current, "links", digest)
    while seen["rows"]:
        moved = _star(_star(current, large=True), large=False)
        current, now = materialize_counted(moved, "links-round", digest)
        if now == seen:
            break
        seen = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
