"""Mixing sources to target weights by Poisson replication.

A source with a target share w of `total` documents and n documents of its own
has the mean repetition rate w * total / n. Each document draws its number of
copies from that Poisson distribution: a hash of its id is the uniform number
that the distribution's cumulative function is inverted at, so the draw needs
no state and no random generator, and is the same on any cluster. Documents are
then exploded by their counts and shuffled globally by a hash of id and copy.

Edge cases: a null source is a source of its own; a null id draws like the text
"null"; repeated rows draw alike; sources without a weight (when weights are
given) get none; an empty table stays empty; input columns that clash with an
output name are replaced in the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playlore.llm.common import read, stash, unit_interval

#: Production parameters: shares go as the source's size to this power, so large sources shrink and small ones grow.
TEMPERATURE, SEED = 0.7, "mix"
#: Rows of one source are spread over this many join keys.
SALTS = 64
#: Sources whose rates are broadcast: a few hundred bytes each.
BROADCAST = 10_000


def source_rates(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, total: int | None = None) -> DataFrame:
    """(source_key, rate, thresholds): thresholds are the cumulative probabilities of 0, 1, 2 ... copies.

    They go on until the rest of the distribution is below the 52 bits of the uniform number.
    """
    counts = docs.groupBy(_key(F.col(source)).alias("source_key")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    else:
        each = [v for s, w in weights.items() for v in (F.lit(f"s:{s}"), F.lit(float(w)))]
        weighed = counts.withColumn("w", F.coalesce(F.element_at(F.create_map(*each), F.col("source_key")), F.lit(0.0)))
    sums = weighed.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    want = F.lit(int(total)) if total is not None else F.col("all_n")
    rate = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * want / F.col("n")).otherwise(0.0)
    rated = weighed.crossJoin(F.broadcast(sums)).withColumn("rate", rate)
    last = F.ceil(F.col("rate") + 12 * F.sqrt(F.col("rate")) + 30).cast("int")
    # one pass keeps the running sum; the logarithm of k! is built up beside it
    start = F.struct(F.exp(-F.col("rate")).alias("cdf"), F.lit(0.0).alias("log_k"), F.array(F.exp(-F.col("rate"))).alias("out"))

    def step(a: Column, k: Column) -> Column:
        log_k = a["log_k"] + F.log(k.cast("double"))
        cdf = a["cdf"] + F.exp(-F.col("rate") + k * F.log(F.col("rate")) - log_k)
        return F.struct(cdf.alias("cdf"), log_k.alias("log_k"), F.concat(a["out"], F.array(cdf)).alias("out"))

    thresholds = F.when(F.col("rate") > 0, F.aggregate(F.sequence(F.lit(1), last), start, step)["out"]).otherwise(F.array(F.lit(1.0)))
    return rated.select("source_key", "n", "rate", thresholds.alias("thresholds"))


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s:"), source.cast("string")), F.lit("null"))


def draw(docs: DataFrame, rates: DataFrame, doc_id: str = "doc_id", source: str = "source", seed: str = SEED) -> DataFrame:
    """docs with rate and repeats. Up to BROADCAST sources the rates are broadcast, and no row moves; beyond, the hot sources' rows are salted and the rates repeated for each salt."""
    rates = stash(rates, "rates")
    if rates.limit(BROADCAST + 1).count() <= BROADCAST:
        keyed = docs.drop("rate", "repeats").withColumns({"source_key": _key(F.col(source)), "u": unit_interval(F.col(doc_id), seed)})
        drawn = keyed.join(F.broadcast(rates.select("source_key", "rate", "thresholds")), "source_key")
        return drawn.withColumn("repeats", F.size(F.filter("thresholds", lambda t: t <= F.col("u")))).drop("source_key", "thresholds", "u")
    salted = rates.select("source_key", "rate", "thresholds", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    keyed = docs.drop("rate", "repeats").withColumns({"source_key": _key(F.col(source)), "salt": F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int"), "u": unit_interval(F.col(doc_id), seed)})
    drawn = keyed.join(salted, ["source_key", "salt"]).withColumn("repeats", F.size(F.filter("thresholds", lambda t: t <= F.col("u"))))
    return drawn.drop("source_key", "salt", "thresholds", "u")


def replicate(drawn: DataFrame, doc_id: str = "doc_id", seed: str = SEED) -> DataFrame:
    """A row for each copy, in an order that a hash of id and copy gives; rows of one id follow one another by their content.

    The order needs the whole rows, so they move, whichever columns are selected later.
    """
    copies = drawn.drop("copy", "shuffle_key").filter("repeats > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    key = F.md5(F.concat(F.lit(f"{seed}:order:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(":"), F.col("copy").cast("string")))
    return copies.withColumn("shuffle_key", key).orderBy("shuffle_key", F.xxhash64(*copies.columns))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, total: int | None = None, seed: str = SEED) -> DataFrame:
    return replicate(draw(docs, source_rates(docs, weights=weights, temperature=temperature, total=total), seed=seed), seed=seed)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "source", "repeats", "copy", "shuffle_key")


ORACLE = f"""WITH counted AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {TEMPERATURE}) AS w FROM documents GROUP BY 1),
rated AS (SELECT source, w / sum(w) OVER () * sum(n) OVER ()::DOUBLE / n AS rate FROM counted),
mass AS (SELECT source, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM rated, LATERAL (SELECT unnest(range(ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM mass),
drawn AS (SELECT d.doc_id, d.source, count(c.k) AS repeats
  FROM (SELECT doc_id, source, row_number() OVER () AS rid, ('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u FROM documents) d
  LEFT JOIN cdf c ON c.source = d.source AND c.c <= d.u GROUP BY d.rid, d.doc_id, d.source)
SELECT doc_id, source, repeats::INTEGER AS repeats, copy::INTEGER AS copy, md5('{SEED}:order:' || doc_id || ':' || copy) AS shuffle_key
FROM drawn, LATERAL (SELECT unnest(range(1, repeats + 1)) AS copy)"""
