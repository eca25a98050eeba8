"""Document fingerprints by I-Match over many randomised lexicon subsets.

The lexicon holds the terms whose inverse document frequency lies in a chosen
band. ROUNDS times it is dealt at random into 256 subsets, so a term is in a subset of
each round and subsets of different rounds overlap. A document's distinct lexicon
terms are sorted, and for each subset that it has terms of, those terms are hashed
together; the fingerprint lists subset and hash. Two fingerprints are alike as
far as their subsets agree, so an edit changes some subsets and leaves others.

Size: the lower bound of the band says how large the lexicon can get. A term in
at least a share p of the documents, with t distinct terms a document on average,
leaves room for t / p terms, whatever the number of documents. Up to MOST_TERMS of
them are a look-up table in the plan, and fingerprints one projection of the texts;
a larger lexicon stays a table, which terms are joined to. Both ways give the same
fingerprints.

Edge cases: a null text is empty; a text without lexicon terms is fingerprinted
by all its terms, so equal texts always have equal fingerprints; repeated rows
get equal results; in `edited_next`, rows with the same id and text follow
each other, null ids come last in an order by hash, and a lone document is followed by itself;
an empty table stays empty; input columns that clash with an output name are
replaced in the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playlore.llm.common import let, read, row_key, stash

#: Production parameters: the band, as shares of documents that have a term.
LEAST_SHARE, MOST_SHARE = 0.002, 0.25
#: Times that the lexicon is dealt into 256 subsets, by a byte of a term's hash each.
ROUNDS = 2
#: Buckets of the look-up table, and terms at most of a lexicon that is made one.
BUCKETS, MOST_TERMS = 4096, 200_000
#: Rows of a bucket of ids, and buckets at most: their limits are a literal of GROUP lists.
BUCKET_ROWS, MOST_BUCKETS, GROUP = 2000, 65536, 256
TERM = r"[\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Distinct terms, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0)))


def lexicon(docs: DataFrame, text: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """(term, df) within the band, from counts over all documents; a term needs two documents at least."""
    counts = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    banded = (F.col("df") >= F.greatest(F.lit(2), least * F.col("n"))) & (F.col("df") <= most * F.col("n"))
    return counts.filter("df >= 2").crossJoin(F.broadcast(total)).filter(banded).select("term", "df")


def lookup(lex: DataFrame) -> Column:
    """A lexicon of MOST_TERMS terms at most as a literal, an array of buckets, so that a look-up costs the same for any size."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("long")
    filled = lex.groupBy(bucket.alias("id")).agg(F.collect_list("term").alias("held"))
    empty = F.array().cast("array<string>")
    every = lex.sparkSession.range(BUCKETS).join(filled, "id", "left").select("id", F.coalesce("held", empty).alias("held"))
    buckets = every.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("id", "held"))), lambda x: x["held"])).alias("buckets"))
    return F.from_json(F.lit(buckets.first()["buckets"]), "array<array<string>>")


def fingerprint(text: Column, buckets: Column) -> Column:
    """array<string>: round, two hex digits of the subset and five of the hash of its terms; for a text without lexicon terms one entry, "---" and its hash."""
    inside = lambda t: F.array_contains(F.get(buckets, F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int")), t)

    def of(all_terms: Column) -> Column:
        drawn = lambda t, m: F.array(*[F.struct(F.concat(F.lit(str(r)), F.substring(m, 2 * r + 1, 2)).alias("s"), t.alias("t")) for r in range(ROUNDS)])
        placed = F.sort_array(F.flatten(F.transform(F.filter(all_terms, inside), lambda t: let(F.md5(t), lambda m: drawn(t, m)))))
        # one string, a line for each run of a subset's terms: linear, where a filter for each subset would not be
        line = lambda p, x, i: F.when(F.coalesce(F.get(p, i - 1)["s"] == x["s"], F.lit(False)), F.concat(F.lit(" "), x["t"])).otherwise(F.concat(F.lit("\n"), x["s"], x["t"]))
        runs = lambda p: F.split(F.substring(F.array_join(F.transform(p, lambda x, i: line(p, x, i)), ""), 2, 2147483647), "\n")
        parts = lambda p: F.transform(runs(p), lambda g: F.concat(F.substring(g, 1, 3), F.substring(F.md5(F.substring(g, 4, 2147483647)), 1, 5)))
        whole = F.array(F.concat(F.lit("---"), F.substring(F.md5(F.array_join(F.array_sort(all_terms), " ")), 1, 5)))
        return let(placed, lambda p: F.when(F.size(p) > 0, parts(p)).otherwise(whole))

    return let(terms(text), of)


def joined_fingerprint(df: DataFrame, text: str, lex: DataFrame, out: str) -> DataFrame:
    """df with the fingerprint of a text column as one string: what `fingerprint` gives, for a lexicon of any size.

    df is read twice. Distinct texts are fingerprinted once, keyed by digest; what is collected is the terms of one document.
    A term stands once in the lexicon, so a frequent one is a skewed join, which adaptive execution splits.
    """
    digest = F.sha2(text, 256)
    texts = df.select(digest.alias("digest"), terms(F.col(text)).alias("held")).dropDuplicates(["digest"])
    drawn = F.array(*[F.concat(F.lit(str(r)), F.substring("m", 2 * r + 1, 2)) for r in range(ROUNDS)])
    placed = texts.select("digest", F.explode("held").alias("term")).join(lex.select("term"), "term").withColumn("m", F.md5("term")).select("digest", "term", F.explode(drawn).alias("s"))
    each = placed.groupBy("digest", "s").agg(F.array_join(F.sort_array(F.collect_list("term")), " ").alias("of"))
    made = each.groupBy("digest").agg(F.array_join(F.sort_array(F.collect_list(F.concat("s", F.substring(F.md5("of"), 1, 5)))), "").alias("made"))
    whole = F.concat(F.lit("---"), F.substring(F.md5(F.array_join(F.array_sort(terms(F.col(text))), " ")), 1, 5))
    return df.withColumn("digest", digest).join(made, "digest", "left").withColumn(out, F.coalesce("made", whole)).drop("digest", "made")


def likeness(a: Column, b: Column) -> Column:
    """The share of the subsets that either has terms of in which both agree."""
    subsets = lambda x: F.transform(x, lambda e: F.substring(e, 1, 3))
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(subsets(a), subsets(b)))


def entries(printed: Column) -> Column:
    return F.regexp_extract_all(printed, F.lit(".{8}"), F.lit(0))


def above(x: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are above x, by a look at the heads of groups of bounds and at one group."""
    groups = [bounds[i : i + GROUP] for i in range(0, len(bounds), GROUP)]
    literal = lambda v, kind: F.from_json(F.lit(str(v)), kind)
    upto = lambda held: F.size(F.filter(held, lambda b: b <= x))
    group = upto(literal([g[0] for g in groups], "array<bigint>"))
    below = let(group, lambda k: F.when(k == 0, 0).otherwise((k - 1) * GROUP + upto(F.get(literal(groups, "array<array<bigint>>"), k - 1))))
    return F.lit(len(bounds)) - below


def edited_next(keyed: DataFrame, printed: Column) -> DataFrame:
    """keyed (doc_id, text, row_key) with own, which is printed, with edited, each text's last third replaced by the head of the next document's, and next_own.

    Documents are dealt by quantiles of the id, null ids by their hash, so the texts move once. Each
    bucket gets the first document of the next one as a guest, for its last document to look at.
    """
    backwards, missing = F.bitwise_not(F.col("doc_id")), F.col("doc_id").isNull()
    rows, parts = keyed.count(), int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(MOST_BUCKETS, max(parts, rows // BUCKET_ROWS))
    bounds = keyed.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("b")).first()["b"] or [] if buckets > 1 else []
    keyed = keyed.withColumn("tie", F.md5("row_key"))
    by_hash = F.floor(F.conv(F.substring("tie", 1, 6), 16, 10).cast("long") * buckets / (1 << 24)).cast("int") + MOST_BUCKETS
    dealt = keyed.withColumn("bucket", F.when(missing, by_hash).otherwise(above(F.col("doc_id"), sorted(set(bounds)))))
    firsts = dealt.groupBy("bucket").agg(F.min(F.struct(missing.alias("n"), backwards.alias("i"), F.col("tie"), F.col("row_key"))).alias("f"))
    around = Window.orderBy("bucket")  # at most 2 * MOST_BUCKETS rows
    last = F.last("bucket").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    guests = firsts.select(F.col("f.row_key").alias("row_key"), F.coalesce(F.lag("bucket").over(around), last).alias("target"))
    visiting = keyed.join(F.broadcast(guests), "row_key").select(*keyed.columns, F.col("target").alias("bucket"), F.lit(True).alias("guest")).dropDuplicates(["row_key"])
    hosts = dealt.withColumn("guest", F.lit(False)).withColumn("own", printed)
    w = Window.partitionBy("bucket").orderBy("guest", missing, backwards, "tie")
    led = hosts.unionByName(visiting.withColumn("own", printed)).withColumns({"next_text": F.lead("text").over(w), "next_own": F.lead("own").over(w)}).filter("not guest").drop("tie")
    taken = F.floor(F.char_length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - taken), F.substring(F.col("next_text"), F.lit(1), taken))
    return led.withColumn("edited", edited).drop("bucket", "guest", "next_text")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    lex = stash(lexicon(docs), "lexicon")  # counted and looked up, from texts read once
    body = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", body.alias("text"), row_key(F.col("doc_id"), F.col("text")).alias("row_key"))
    if lex.count() <= MOST_TERMS:
        buckets = lookup(lex)
        made = edited_next(keyed, F.array_join(fingerprint(F.col("text"), buckets), "")).withColumn("changed", F.array_join(fingerprint(F.col("edited"), buckets), ""))
    else:
        printed = stash(joined_fingerprint(keyed, "text", lex, "own"), "printed")
        made = joined_fingerprint(stash(edited_next(printed, F.col("own")), "edited"), "edited", lex, "changed")
    return made.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("own").alias("fingerprint"),
        F.col("changed").alias("edited_fingerprint"),
        likeness(entries(F.col("own")), entries(F.col("changed"))).alias("near_edited"),
        likeness(entries(F.col("own")), entries(F.col("next_own"))).alias("near_next"),
    )


_PARTS = lambda t: f"(SELECT rid, list(s || h ORDER BY s) AS fp FROM (SELECT rid, s, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 5) AS h FROM (SELECT rid, term, r::VARCHAR || substr(md5(term), 2 * r::BIGINT + 1, 2) AS s FROM (SELECT rid, unnest({t}) AS term FROM split) JOIN lex USING (term), range({ROUNDS}) x(r)) GROUP BY rid, s) GROUP BY rid)"
_TERMS = lambda t: f"list_distinct(regexp_extract_all(lower({t}), '{TERM}'))"
_LIKE = lambda a, b: f"len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat(list_transform({a}, lambda e: e[1:3]), list_transform({b}, lambda e: e[1:3]))))"
ORACLE = f"""WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id DESC) AS rid, count(*) OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
pairs AS (SELECT a.rid, a.n, a.doc_id, a.text, length(a.text) AS n_chars, b.rid AS next_rid,
    substr(a.text, 1, length(a.text) - length(a.text) // 3) || substr(b.text, 1, length(a.text) // 3) AS edited
  FROM docs a JOIN docs b ON b.rid = a.rid % a.n + 1),
split AS (SELECT rid, {_TERMS("text")} AS own, {_TERMS("edited")} AS changed FROM pairs),
lex AS (SELECT term FROM (SELECT unnest(own) AS term FROM split) GROUP BY term
  HAVING count(*) >= greatest(2, {LEAST_SHARE} * (SELECT count(*) FROM docs)) AND count(*) <= {MOST_SHARE} * (SELECT count(*) FROM docs)),
a AS {_PARTS("own")}, b AS {_PARTS("changed")},
prints AS (SELECT p.*, coalesce(a.fp, ['---' || substr(md5(array_to_string(list_sort(s.own), ' ')), 1, 5)]) AS fa, coalesce(b.fp, ['---' || substr(md5(array_to_string(list_sort(s.changed), ' ')), 1, 5)]) AS fb
  FROM pairs p JOIN split s USING (rid) LEFT JOIN a USING (rid) LEFT JOIN b USING (rid))
SELECT x.doc_id, x.n_chars::BIGINT AS n_chars, sha256(x.edited) AS edited_sha256, array_to_string(x.fa, '') AS fingerprint, array_to_string(x.fb, '') AS edited_fingerprint,
  {_LIKE("x.fa", "x.fb")} AS near_edited, {_LIKE("x.fa", "y.fa")} AS near_next
FROM prints x JOIN prints y ON y.rid = x.next_rid"""
