"""Search in names by an inverted index, with every candidate verified.

The index is a table of postings: each run of two and of three letters of a lower-cased name, and each ordered pair of its
letters (for fuzzy search), with the name itself. Postings lie in partitions by a hash of the gram and are sorted by it, so a
search reads one partition for each term, and of that the row groups of one gram. Of a term's grams the rarest is read; the
counts of grams are a second table in the same partitions. A candidate is verified by the name that its posting holds.

Counts are looked up for the grams of the terms alone, a few numbers; postings never pass through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
POSTING = "gram string, kind string, id string, name string, bucket int"
#: What a word may follow.
BREAKS = r"[\s&/·\-—(]"


def _runs(name: Column, n: int) -> Column:
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(name) - n + 1, F.lit(1))), lambda i: F.substring(name, i, F.lit(n)))
    return F.filter(runs, lambda g: F.char_length(g) == n)


def _pairs(name: Column) -> Column:
    """Each ordered pair of different places' letters, blanks left out, as "~ab"."""
    letters = F.filter(F.split(name, ""), lambda c: F.trim(c) != "")
    after = lambda i: F.array_distinct(F.slice(letters, i + 2, F.greatest(F.size(letters) - i - 1, F.lit(0))))
    return F.flatten(F.transform(letters, lambda c, i: F.transform(after(i), lambda d: F.concat(F.lit("~"), c, d))))


def _grams(name: Column, fuzzy: bool) -> Column:
    return F.array_distinct(F.concat(_runs(name, 2), _runs(name, 3), *([_pairs(name)] if fuzzy else [])))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write_index(names: DataFrame, folder: str, fuzzy: bool = True) -> None:
    """names: kind, id, name. Writes the postings and the counts of grams below folder."""
    low = names.filter("name is not null").select("kind", F.col("id").cast("string").alias("id"), "name").distinct()
    postings = low.withColumn("gram", F.explode(_grams(F.lower("name"), fuzzy))).withColumn("bucket", _bucket(F.col("gram")))
    # a gram that most names have is dealt to many tasks by its names, and sorted in each
    postings.repartitionByRange("bucket", "gram", "kind", "id").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{folder}/postings")
    held = names.sparkSession.read.schema(POSTING).parquet(f"{folder}/postings")
    held.groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("n")).repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{folder}/counts")


def rarest(spark: SparkSession, folder: str, wanted: dict[str, set[str]]) -> dict[str, str | None]:
    """For each term the rarest of its grams; None if the index lacks one of them, so that no name can match."""
    every = sorted(set().union(*wanted.values())) if wanted else []
    if not every:
        return {}
    buckets = {r.gram: r.bucket for r in spark.createDataFrame([(g,) for g in every], "gram string").select("gram", _bucket(F.col("gram")).alias("bucket")).collect()}
    counts = spark.read.schema("gram string, n long, bucket int").parquet(f"{folder}/counts")
    known = {r.gram: r.n for r in counts.filter(F.col("bucket").isin(*set(buckets.values())) & F.col("gram").isin(*every)).collect()}
    return {term: min(grams, key=lambda g: (known[g], g)) if grams <= known.keys() else None for term, grams in wanted.items()}


def _candidates(spark: SparkSession, folder: str, chosen: dict[str, str | None]) -> DataFrame:
    """(term, kind, id, name): the postings of each term's gram, read from their partitions alone."""
    some = {t: g for t, g in chosen.items() if g is not None}
    pairs = spark.createDataFrame(sorted(some.items()), "term string, gram string")
    buckets = {r[0] for r in pairs.select(_bucket(F.col("gram"))).collect()}
    postings = spark.read.schema(POSTING).parquet(f"{folder}/postings").filter(F.col("bucket").isin(*buckets) & F.col("gram").isin(*set(some.values())))
    return postings.join(F.broadcast(pairs), "gram").select("term", "kind", "id", "name")  # pairs: a row for each term


def _term_grams(term: str) -> set[str]:
    """The runs of three letters of a term, or of two if it has no more; none of a shorter one, which finds nothing."""
    n = min(3, len(term))
    return {term[i : i + n] for i in range(len(term) - n + 1)} if n >= 2 else set()


def search(spark: SparkSession, folder: str, terms: list[str]) -> DataFrame:
    """(term, kind, id, name) of the names that hold a term, whatever the case; terms of one letter find nothing."""
    wanted = {t: grams for t in terms if (grams := _term_grams(t.strip().lower()))}
    found = _candidates(spark, folder, rarest(spark, folder, wanted))
    return found.filter(F.contains(F.lower("name"), F.lower(F.trim("term"))))


def fuzzy_score(term: Column, name: Column) -> Column:
    """How well a name has a term's letters in order; null if it doesn't. Runs, starts of words and an early first letter count more."""
    low, query = F.lower(name), F.lower(term)
    letters = F.split(F.regexp_replace(query, r"\s+", ""), "")
    state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("run"), F.lit(-1).alias("first"), F.lit(0).alias("score"))

    def step(a: Column, c: Column) -> Column:
        spot = F.call_function("locate", c, low, a["at"] + 1) - 1
        start = (spot == 0) | F.substring(low, spot, F.lit(1)).rlike(BREAKS)
        run = F.when(spot == a["at"], a["run"] + 1).otherwise(F.lit(1))
        gained = 1 + F.when(start, 3).otherwise(0) + F.when(run > 1, run).otherwise(0)
        hit = F.struct((spot + 1).alias("at"), run.alias("run"), F.when(a["first"] < 0, spot).otherwise(a["first"]).alias("first"), (a["score"] + gained).alias("score"))
        return F.when(a.isNotNull() & (spot >= 0), hit)

    def end(a: Column) -> Column:
        whole = F.when(F.startswith(low, query), 10).otherwise(0)
        return F.when(a.isNotNull(), (100 * (a["score"] + whole) - 20 * a["first"] - 2 * (F.char_length(low) - F.size(letters))) / F.lit(100.0))

    return F.when(F.regexp_replace(query, r"\s+", "") == "", F.lit(0.0)).otherwise(F.aggregate(letters, state, step, end))


def fuzzy(spark: SparkSession, folder: str, terms: list[str]) -> DataFrame:
    """(term, kind, id, name, score) of the names that have a term's letters in order; needs an index with pairs, and terms of two letters or more."""
    packed = {t: "".join(t.lower().split()) for t in terms}
    wanted = {t: {f"~{a}{b}" for a, b in zip(p, p[1:], strict=False)} for t, p in packed.items() if len(p) > 1}
    found = _candidates(spark, folder, rarest(spark, folder, wanted))
    return found.withColumn("score", fuzzy_score(F.col("term"), F.col("name"))).filter("score is not null")
