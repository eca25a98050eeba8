"""Terms of texts and their weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlore.functions.scratch import written

TERM = r"[\p{L}]{3,}"


def terms(df: DataFrame, doc: str, text: Column, *keep: str) -> DataFrame:
    """(doc, keep, term, tf): words of three letters or more, lower case.

    Texts are dealt by doc before they are cut into words, so one shuffle of texts serves the counts and all that is by doc.
    """
    words = F.explode(F.regexp_extract_all(F.lower(F.coalesce("_text", F.lit(""))), F.lit(TERM), F.lit(0)))
    return df.select(doc, *keep, text.alias("_text")).repartition(doc).select(doc, *keep, words.alias("term")).groupBy(doc, *keep, "term").agg(F.count(F.lit(1)).alias("tf"))


def tf_idf(counted: DataFrame, doc: str, group: str, top: int = 15, ceiling: float = 0.35) -> DataFrame:
    """(doc, group, term, tf, score, rank): tf * ln(max(n, 2) / df) within a group of documents, terms of the ceiling's share or more left out.

    The terms with their weights are a table of their own, so that Spark knows its size: a small one is looked up where the counts are.
    """
    n = counted.select(group, doc).distinct().groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    df = counted.groupBy(group, "term").agg(F.count(F.lit(1)).alias("df"))
    weighed = df.join(n, group).filter(F.col("df") < ceiling * F.greatest(F.col("n"), F.lit(2))).withColumn("idf", F.log(F.greatest(F.col("n"), F.lit(2)) / F.col("df")))
    scored = counted.join(written(weighed.select(group, "term", "idf"), "term-weights"), [group, "term"]).withColumn("score", F.round(F.col("tf") * F.col("idf"), 6))
    w = Window.partitionBy(doc).orderBy(F.desc("score"), F.desc("tf"), "term")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).drop("idf")


def with_edits(keywords: DataFrame, edits: DataFrame, doc: str) -> DataFrame:
    """Keywords with the owner's edits (doc, term, action): hidden ones go, added ones come first with a score of 99."""
    hidden = edits.filter("action = 'hide'").select(doc, "term")
    added = edits.filter("action = 'add'").select(doc, "term", F.lit(99.0).alias("score"))
    return keywords.select(doc, "term", "score").join(hidden, [doc, "term"], "left_anti").join(added.select(doc, "term"), [doc, "term"], "left_anti").unionByName(added)
