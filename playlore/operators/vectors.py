"""Sparse vectors as rows (id, dimension, value): cosines, entropies, overlaps, lifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlore.functions.compat import entropy_bits


def norms(vectors: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return vectors.groupBy(*keys).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"))


def cosine_chain(vectors: DataFrame, owner: str, period: str, dim: str, value: str = "value") -> DataFrame:
    """(owner, period, previous, cos): each period's cosine with the one before it that has data; 0 where they share nothing, null for the first."""
    w = Window.partitionBy(owner).orderBy(period)
    periods = norms(vectors, [owner, period], value).withColumns({"previous": F.lag(period).over(w), "previous_norm": F.lag("norm").over(w)})
    before = vectors.select(owner, F.col(period).alias("previous"), F.col(dim), F.col(value).alias("_v"))
    dots = vectors.join(periods.select(owner, period, "previous"), [owner, period]).join(before, [owner, "previous", dim]).groupBy(owner, period).agg(F.sum(F.col(value) * F.col("_v")).alias("dot"))
    cos = F.when(F.col("previous").isNotNull(), F.coalesce(F.col("dot") / (F.col("norm") * F.col("previous_norm")), F.lit(0.0)))
    return periods.join(dots, [owner, period], "left").select(owner, period, "previous", F.round(cos, 6).alias("cos"))


def cosine_matrix(vectors: DataFrame, id_: str, dim: str, value: str = "value") -> DataFrame:
    """(a, b, cos) for every pair of ids with a < b that share a dimension."""
    n = norms(vectors, [id_], value)
    unit = vectors.join(n, id_).select(id_, dim, (F.col(value) / F.col("norm")).alias("_u"))
    a, b = unit.select(F.col(id_).alias("a"), dim, F.col("_u").alias("_x")), unit.select(F.col(id_).alias("b"), dim, F.col("_u").alias("_y"))
    return a.join(b, dim).filter("a < b").groupBy("a", "b").agg(F.round(F.sum(F.col("_x") * F.col("_y")), 6).alias("cos"))


def entropy(df: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """(keys, entropy, top_share) of the shares of weight within keys, in bits."""
    w = Window.partitionBy(*keys)
    p = df.withColumn("_p", F.col(weight) / F.sum(weight).over(w))
    return p.groupBy(*keys).agg(F.round(F.sum(entropy_bits(F.col("_p"))), 6).alias("entropy"), F.round(F.max("_p"), 6).alias("top_share"))


def jaccard_pairs(members: DataFrame, item: str, group: str, least_shared: int) -> DataFrame:
    """(a, b, shared, jaccard) of items by the groups that hold them. members has each (item, group) once."""
    sizes = members.groupBy(item).agg(F.count(F.lit(1)).alias("size"))
    a = members.select(F.col(item).alias("a"), group)
    b = members.select(F.col(item).alias("b"), group)
    shared = a.join(b, group).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least_shared)
    sized = shared.join(sizes.select(F.col(item).alias("a"), F.col("size").alias("size_a")), "a").join(sizes.select(F.col(item).alias("b"), F.col("size").alias("size_b")), "b")
    return sized.select("a", "b", "shared", F.round(F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared")), 6).alias("jaccard"))


def lift(df: DataFrame, owner: str, item: str, group: Column) -> DataFrame:
    """(owner, item, group, n, lift): a group's share of an item's rows over its share of the owner's rows."""
    n = df.groupBy(owner, item, group.alias("group")).agg(F.count(F.lit(1)).alias("n"))
    by_item, by_group, by_owner = Window.partitionBy(owner, item), Window.partitionBy(owner, "group"), Window.partitionBy(owner)
    counted = n.withColumns({"item_n": F.sum("n").over(by_item), "group_n": F.sum("n").over(by_group), "all_n": F.sum("n").over(by_owner)})
    return counted.select(owner, item, "group", "n", "item_n", F.round(F.col("n") * F.col("all_n") / (F.col("item_n") * F.col("group_n")), 6).alias("lift"))
