"""Line dedup by winnowing.

Every line is hashed. A window is a shortest run of consecutive lines that has
MIN_WORDS words, from each line on and up to each line, so a window is measured in
words and one long line fills it alone. The least line hash of each window is
selected, at its leftmost place; neighbouring windows select the same one, so a text has
few selected positions. Equal windows select equal hashes at different positions:
a repeated run of MIN_WORDS words or more is sure to show as a selected hash that has
several positions, and the many that have one position end there. Around each position of
the others the match is extended both ways: by the windows that selected it, each named by the
hash of all its lines, and, where neighbouring windows match too, by overlap to the ends
of the run. All but the first occurrence of a window is deleted, in whatever document that is.

So a line goes if it lies in a run of lines of MIN_WORDS words that occurs earlier,
in any earlier document or before it in its own. Only hashes are shuffled; the texts
move once, to meet the lines they lose.

Edge cases: a null or empty text loses nothing; "earlier" is by doc_id, nulls
first, then by position; rows with the same id and text count as one document,
and each keeps its lines; an empty table stays empty; other columns pass through;
input columns that clash with an output name are replaced in the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playlore.llm.common import WORD, forget, let, marked, read, row_key, stash

#: Production parameter: words of a window. Shorter repeats (headings, greetings) stay.
MIN_WORDS = 10


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")


def windows(hashes: Column, words: Column, least: int = MIN_WORDS) -> Column:
    """(start, stop, print, at, hash) of each shortest run of lines with `least` words, from each line on and up to each line.

    print is the least line hash in it, at its leftmost position, hash is of all of it. Lines without a word neither start nor
    end a run, so a run has at most `least` lines besides those.
    """
    entry = lambda n, i: F.struct(i.alias("pos"), n.alias("n"))
    more = lambda a, x: F.struct((a["sum"] + x["n"]).alias("sum"), (a["k"] + F.when(a["sum"] < least, 1).otherwise(0)).alias("k"))
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("k"))
    needed = lambda part: F.aggregate(part, zero, more, lambda a: F.when(a["sum"] >= least, a["k"]))
    run = lambda a, b: a.cast("long") * (1 << 32) + (b - a)  # noqa: E731  one number, since numbers are made distinct in linear time; start and length, since start and stop alike collide when hashed

    # some elements by their places: a slice would copy the whole array each time
    cut = lambda a, lo, hi: F.transform(F.sequence(lo, hi), lambda k: F.get(a, k))

    def runs(ink: Column) -> Column:
        onward = lambda x, i: let(needed(cut(ink, i, F.least(i + least, F.size(ink)) - 1)), lambda k: F.when(k.isNotNull(), run(x["pos"], F.get(ink, i + k - 1)["pos"])))
        before = lambda i: cut(ink, i, F.greatest(i - least + 1, F.lit(0)))  # noqa: E731  from here back
        backward = lambda x, i: let(needed(before(i)), lambda k: F.when(k.isNotNull(), run(F.get(ink, i - k + 1)["pos"], x["pos"])))
        forth = F.transform(ink, lambda x, i: F.when(x["n"] >= least, run(x["pos"], x["pos"])).otherwise(onward(x, i)))
        back = F.transform(ink, lambda x, i: F.when(x["n"] < least, backward(x, i)))
        return F.array_distinct(F.filter(F.concat(forth, back), lambda r: r.isNotNull()))

    found = let(F.filter(F.transform(words, entry), lambda x: x["n"] > 0), runs)
    first, last = lambda r: F.call_function("div", r, F.lit(1 << 32)).cast("int"), lambda r: first(r) + (r % (1 << 32)).cast("int")
    part = lambda r: cut(hashes, first(r), last(r))
    place = lambda r, p: (first(r) + F.array_position(p, F.array_min(p)) - 1).cast("int")
    return F.transform(found, lambda r: let(part(r), lambda p: F.struct(first(r).alias("start"), last(r).alias("stop"), F.array_min(p).alias("print"), place(r, p).alias("at"), F.xxhash64(p).alias("hash"))))


def sketch(docs: DataFrame) -> DataFrame:
    """(row_key, doc_id, windows), one row for each distinct row_key."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    words = F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD)))
    made = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "doc_id", F.transform(lines, line_hash).alias("hashes"), words.alias("words"))
    return made.dropDuplicates(["row_key"]).select("row_key", "doc_id", windows(F.col("hashes"), F.col("words")).alias("windows"))


def repeated_prints(sketches: DataFrame) -> DataFrame:
    """(print): the selected hashes that stand at several positions, in one document or in many."""
    selected = sketches.select("row_key", F.explode("windows").alias("w")).select("row_key", "w.print", "w.at")
    # neighbouring windows that select one position follow each other, so most repeats of it end within the task
    return selected.groupBy("print").agg(F.min(F.struct("row_key", "at")).alias("lo"), F.max(F.struct("row_key", "at")).alias("hi")).filter("lo < hi").select("print")


def _repeated(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """repeated_lines, and the intermediate results that it reads."""
    made = stash(sketch(docs), "line-sketch")
    again = stash(repeated_prints(made), "line-prints")
    every = made.select("row_key", "doc_id", F.explode("windows").alias("w")).select("w.print", "w.hash", "row_key", "doc_id", "w.start", "w.stop")
    around = marked(every, again, "print").filter("maybe").drop("maybe")
    firsts = around.groupBy("print", "hash").agg(F.min(F.struct("doc_id", "row_key", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = stash(firsts.select("print", "hash", F.col("first.row_key").alias("key0"), F.col("first.start").alias("start0")), "line-firsts")
    # most windows occur once: only those that may occur again move to meet the first
    later = marked(around, firsts.select("hash"), "hash").filter("maybe").join(firsts, ["print", "hash"]).filter("row_key != key0 or start != start0")
    return later.select("row_key", F.explode(F.sequence("start", "stop")).alias("pos")).groupBy("row_key").agg(F.collect_set("pos").alias("removed")), [made, again, firsts]


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(row_key, removed): the positions of the lines that each document loses."""
    return _repeated(docs)[0]


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with n_lines, n_removed and clean_text."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    keyed = docs.drop("n_lines", "n_removed", "clean_text", "removed").withColumn("row_key", row_key(F.col("doc_id"), F.col("text")))
    found, spent = _repeated(docs)
    joined = keyed.join(stash(found, "line-removed"), "row_key", "left")
    for x in spent:
        forget(x)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
    kept = let(lines, lambda x: F.array_join(F.transform(left, lambda i: F.get(x, i)), "\n"))
    return joined.withColumns(
        {
            "n_lines": F.size(lines).cast("long"),
            "n_removed": F.coalesce(F.size("removed"), F.lit(0)).cast("long"),
            "clean_text": F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept),
        }
    ).drop("row_key", "removed")


def op1_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("clean_text", F.lit(""))).alias("clean_md5"), F.char_length(F.coalesce("clean_text", F.lit(""))).cast("long").alias("clean_chars"))


ORACLE = f"""WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT rid, i - 1 AS pos, len(regexp_extract_all(ls[i], '{WORD}')) AS n FROM docs, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)),
inked AS (SELECT rid, pos, sum(n) OVER w AS upto, sum(n) OVER w - n AS before FROM lines WHERE n > 0 WINDOW w AS (PARTITION BY rid ORDER BY pos)),
forth AS (SELECT a.rid, a.pos AS start, b.pos AS stop FROM (SELECT *, before + {MIN_WORDS} AS goal FROM inked) a ASOF JOIN inked b ON a.rid = b.rid AND a.goal <= b.upto),
back AS (SELECT a.rid, b.pos AS start, a.pos AS stop FROM (SELECT *, upto - {MIN_WORDS} AS goal FROM inked) a ASOF JOIN inked b ON a.rid = b.rid AND a.goal >= b.before),
windows AS (SELECT rid, start, stop, md5(array_to_string(ls[start + 1:stop + 1], chr(10))) AS run FROM (SELECT * FROM forth UNION SELECT * FROM back) JOIN docs USING (rid)),
later AS (SELECT rid, start, stop FROM windows QUALIFY row_number() OVER (PARTITION BY run ORDER BY rid, start) > 1),
removed AS (SELECT DISTINCT rid, unnest(range(start, stop + 1)) AS pos FROM later),
made AS (SELECT d.doc_id, len(ls)::BIGINT AS n_lines, coalesce(len(x.gone), 0)::BIGINT AS n_removed,
    array_to_string(list_filter(ls, lambda l, i: NOT coalesce(list_contains(x.gone, i - 1), false)), chr(10)) AS t
  FROM docs d LEFT JOIN (SELECT rid, list(pos) AS gone FROM removed GROUP BY rid) x USING (rid))
SELECT doc_id, n_lines, n_removed, md5(t) AS clean_md5, length(t)::BIGINT AS clean_chars FROM made"""
