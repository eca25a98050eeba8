"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a join and an aggregation; its result is written to the shared
folder, so lineage stays short and no edge passes through the driver; the result of
the step before is deleted then. A node with very many edges is met by the rows of
its least neighbour, one a node, so adaptive execution can split its edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlore.llm.common import forget, stash


def _pointed(edges: DataFrame) -> DataFrame:
    """(node, near, least): each edge seen from node, with the least of node and its neighbours."""
    least = edges.groupBy("node").agg(F.min("near").alias("m")).select("node", F.least("m", "node").alias("least"))
    return edges.join(least.hint("merge"), "node")  # never broadcast: some thirty such joins would gather in the driver


def _both_ways(edges: DataFrame) -> DataFrame:
    turned = edges.select(F.col("low").alias("node"), F.col("high").alias("near"))
    return edges.select(F.col("high").alias("node"), F.col("low").alias("near")).unionByName(turned)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the least node that can be reached. Nulls link nothing."""
    pairs = edges.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).distinct()
    pairs, before = stash(pairs, "edges"), None
    while True:
        large = _pointed(_both_ways(pairs)).filter("near > node").select(F.col("least").alias("low"), F.col("near").alias("high")).filter("low != high").distinct()
        seen = _pointed(large.select(F.col("high").alias("node"), F.col("low").alias("near")))
        hung = seen.select(F.col("least").alias("low"), F.col("near").alias("high")).unionByName(seen.select(F.col("least").alias("low"), F.col("node").alias("high")))
        spent, pairs = pairs, stash(hung.filter("low != high").distinct(), "edges")
        forget(spent)
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    roots = pairs.select(F.col("low").alias("node")).distinct()
    return pairs.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
