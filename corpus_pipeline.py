"""A training corpus from raw documents: clean, dedup by line, dedup by similarity, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playlore.llm.common import marked, read, stash
from playlore.llm.linededup import dedup_lines
from playlore.llm.merkle import numbered
from playlore.llm.mixing import mix
from playlore.llm.neardup import near_duplicates
from playlore.llm.packing import pack_documents
from playlore.llm.quality import judge

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _retexted(docs: DataFrame) -> DataFrame:
    """clean_text as text, and n_chars to match."""
    return docs.withColumns({"text": F.col("clean_text"), "n_chars": F.char_length("clean_text").cast("long")}).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and so do rejected documents.

    Texts that are null, empty or without words are rejected, whatever else the row holds; repeated rows are judged alike and
    all stay or go; an empty table stays empty; columns beyond those of documents are left behind, whatever their names.
    """
    return _retexted(judge(docs.select(*COLUMNS)).filter("kept"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; a document that has no word left after that goes too.

    Rows of one id and text count as one document, and each stays; null ids come first in the order of ids; a null or empty
    text loses nothing and stays; an empty table stays empty; columns beyond those of documents are left behind.
    """
    left = dedup_lines(docs.select(*COLUMNS)).filter(F.col("clean_text").rlike(r"[^\x20\x09-\x0D]") | (F.col("n_removed") == 0))
    return _retexted(left)


def _with_nodes(docs: DataFrame) -> DataFrame:
    """docs with node: doc_id, unless one doc_id has several texts; then the number of each distinct pair of id and text, in that order."""
    pairs = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("sum"))
    if pairs.groupBy("doc_id").agg(F.min("sum").alias("lo"), F.max("sum").alias("hi")).filter("lo < hi").isEmpty():
        return docs.withColumn("node", F.col("doc_id"))
    known = stash(numbered(pairs.distinct().withColumn("all", F.lit(0)), "all", "doc_id", "sum").select("doc_id", "sum", F.col("index").alias("node")), "row-nodes")
    return docs.withColumn("sum", F.xxhash64("text")).join(known, ["doc_id", "sum"], "left").drop("sum")


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the least id stays; rows without an id stay.

    Rows with one id and different texts are judged each by its own text: they go only if linked with one that stays, and of
    linked ones the least id, then text hash, stays. Of equal rows one stays. Texts that are null or empty link with nothing
    and stay; an empty table stays empty; columns beyond those of documents are left behind.
    """
    docs = _with_nodes(docs.select(*COLUMNS))
    found = near_duplicates(docs.select(F.col("node").alias("doc_id"), "text")).filter("doc_id is not null").groupBy(F.col("doc_id").alias("node")).agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    odd = stash(found.filter("node <> component_id or rows > 1"), "not-alone")  # few; all other rows stay where they are
    split = marked(docs, odd.select("node"), "node")
    first = Window.partitionBy("node").orderBy(F.xxhash64("text"))
    least = split.filter("maybe").join(odd, "node", "left").filter("component_id is null or node = component_id")
    one = least.withColumn("r", F.when(F.col("node").isNotNull(), F.row_number().over(first)).otherwise(1)).filter("r = 1")
    return split.filter("not maybe").select(*COLUMNS).unionByName(one.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its draw says, in an order by hash.

    A null source is a source of its own; rows without an id are drawn by that; repeated rows draw alike; null and empty texts
    are repeated like others; an empty table stays empty; columns beyond those of documents are left behind.
    """
    return mix(docs.select(*COLUMNS)).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in a sequence.

    A null or empty text is the end mark alone; repeated rows and rows without an id are packed each; very long texts are cut
    into whole sequences and a rest; an empty table gives no pieces.
    """
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_dup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Tokens can't be made in SQL; tests/llm/test_pipeline_by_hand.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
