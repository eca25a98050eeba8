"""Quality rules, line first.

Every line is judged by rules for navigation, boilerplate, symbols, shouting and
missing punctuation; failing lines are removed; a document that loses too large a
share of its text is rejected. Phrases and separators, which prose has too, fail a
line only if it is short or if they make up a share of its words. A few whole-document counts are rules as well.
All of it is one projection: no shuffle, no Python.

Edge cases: a null or empty text has no words and is rejected; repeated rows are
judged alike; other columns pass through; input columns that clash with an output
name are replaced in the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playlore.llm.common import WORD, let, read

#: Production parameters.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW, MAX_LOST = 10, 20, 5, 0.3
SYMBOL = r"[#*$%&|<>]"
UPPER, LOWER = "[A-ZÀ-ÖØ-Þ]", "[a-zß-öø-ÿ]"
NAVIGATION = "(?:^|[ \\t])[|»›•·>](?:[ \\t]|$)"
BOILERPLATE = (
    "(?i)(?:accept (?:all )?cookies|cookie (?:policy|settings|notice)|(?:enable|requires) javascript|privacy policy|terms of (?:use|service)"
    "|all rights reserved|subscribe (?:to|now)|sign (?:up|in) (?:for|to|now)|log ?in to|click here|share (?:this|on)|read more|skip to (?:main )?content|back to top|powered by|lorem ipsum)"
)
#: A phrase counts if no letter or digit adjoins it. Lines of so many words fail by phrases and separators only if these are so many hundredths of the words.
PHRASE = f"{BOILERPLATE}s?(?![\\p{{L}}\\p{{N}}])".replace("(?i)", "(?i)(?<![\\p{L}\\p{N}])")
LONG_LINE, MARKS_PERCENT = 20, 10
TERMINAL = "[.!?…:;\"'”’»)\\]。！？][ \\t\\r]*$"


def marked(line: Column) -> Column:
    """True if phrases and separators fail the line."""
    n_words = lambda x: F.size(F.regexp_extract_all(x, F.lit(WORD), F.lit(0)))
    marks = F.regexp_count(line, F.lit(NAVIGATION)) + n_words(F.array_join(F.regexp_extract_all(line, F.lit(PHRASE), F.lit(0)), " "))
    share = lambda m: (m > 0) & ((n_words(line) < LONG_LINE) | (100 * m >= MARKS_PERCENT * n_words(line)))
    return F.when(line.rlike(NAVIGATION) | line.rlike(BOILERPLATE), let(marks, share)).otherwise(F.lit(False))


def line_fails(line: Column) -> Column:
    """True for a line that has a word and breaks a rule."""
    upper, lower = F.regexp_count(line, F.lit(UPPER)), F.regexp_count(line, F.lit(LOWER))
    bare = ~line.rlike(TERMINAL) & (F.size(F.regexp_extract_all(line, F.lit(WORD), F.lit(0))) < 5)
    symbols = F.regexp_count(line, F.lit(SYMBOL)) * 10 > F.length(line)
    return marked(line) | symbols | ((upper >= 12) & (upper > 2 * lower)) | bare


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by windows of `window` words that the text has twice or more. Sorting makes it n log n."""

    def covered(grams: Column) -> Column:
        def spread(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            starts = F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
            step = lambda at: F.transform(at, lambda v, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1) - v, F.lit(window))))
            return F.aggregate(let(starts, step), F.lit(0).cast("long"), lambda a, x: a + x)

        paired = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(let(paired, spread))

    grams = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))
    return let(words, lambda w: F.when(F.size(w) < window, F.lit(0).cast("long")).otherwise(let(grams(w), covered)))


def judge(docs: DataFrame, text: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """docs with the counts, the failing share of the text, clean_text and kept."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_share", "clean_text", "kept"]
    body = F.coalesce(F.col(text), F.lit(""))
    step = docs.drop(*[c for c in made if c != text]).withColumns({"_body": body, "_words": F.regexp_extract_all(body, F.lit(WORD), F.lit(0))})
    extra = lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long")
    judged = step.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count("_body", F.lit(SYMBOL)).cast("long"),
            "n_dup_lines": let(F.filter(F.split("_body", "\n"), lambda x: x.rlike(WORD)), extra),
            "n_repeat_words": repeat_words(F.col("_words")),
            "_lines": F.transform(F.split("_body", "\n"), lambda x: F.struct(x.alias("line"), (x.rlike(WORD) & line_fails(x)).alias("fails"))),
        }
    )
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    inked = lambda keep: F.aggregate(F.filter("_lines", keep), F.lit(0).cast("long"), lambda a, x: a + F.length(x["line"]))
    return (
        judged.withColumns(
            {
                "base_failed": base,
                "lost_share": F.when(F.length("_body") == 0, F.lit(1.0)).otherwise(inked(lambda x: x["fails"]) / F.length("_body")),
                "clean_text": F.array_join(F.transform(F.filter("_lines", lambda x: ~x["fails"]), lambda x: x["line"]), "\n"),
            }
        )
        .withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= max_lost))
        .drop("_body", "_words", "_lines")
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("lost_share", 9).alias("lost_share"))


_Q = lambda s: s.replace("'", "''")
_COUNT = lambda what, pattern: f"len(regexp_extract_all({what}, '{_Q(pattern)}'))"
# DuckDB's patterns can't look around, so the characters on either side are matched along; all of that kind are doubled, so that neighbours need not share one.
_WIDE = "regexp_replace(line, '([^\\p{L}\\p{N}])', '\\1\\1', 'g')"
_ALONE = "(?i)(?:^|[^\\p{L}\\p{N}])(" + BOILERPLATE[4:].replace(" ?", "(?:  )?").replace(" ", "  ").replace("(?:    )?", "(?:  )?") + "s?)(?:$|[^\\p{L}\\p{N}])"
_PHRASES = f"array_to_string(regexp_extract_all({_WIDE}, '{_ALONE}', 1), ' ')"
_MARKS = f"({_COUNT('line', NAVIGATION)} + {_COUNT(_PHRASES, WORD)})"
_MARKED = f"""((regexp_matches(line, '{_Q(NAVIGATION)}') OR regexp_matches(line, '{_Q(BOILERPLATE)}')) AND {_MARKS} > 0
      AND ({_COUNT("line", WORD)} < {LONG_LINE} OR 100 * {_MARKS} >= {MARKS_PERCENT} * {_COUNT("line", WORD)}))"""
ORACLE = f"""WITH body AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w FROM body),
grams AS (SELECT rid, i, array_to_string(w[i + 1:i + {WINDOW}], ' ') AS g FROM worded, LATERAL (SELECT unnest(range(greatest(len(w) - {WINDOW - 1}, 0))) AS i)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, range({WINDOW}) r(k) GROUP BY rid),
lined AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM body),
judged AS (SELECT rid, line, regexp_matches(line, '{WORD}') AS inked,
    {_MARKED} OR {_COUNT("line", SYMBOL)} * 10 > length(line)
    OR ({_COUNT("line", UPPER)} >= 12 AND {_COUNT("line", UPPER)} > 2 * {_COUNT("line", LOWER)})
    OR (NOT regexp_matches(line, '{_Q(TERMINAL)}') AND {_COUNT("line", WORD)} < 5) AS broken FROM lined),
by_doc AS (SELECT rid, count(*) FILTER (inked) - count(DISTINCT line) FILTER (inked) AS n_dup, coalesce(sum(length(line)) FILTER (inked AND broken), 0) AS lost FROM judged GROUP BY rid),
counted AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, {_COUNT("t", SYMBOL)}::BIGINT AS n_symbols,
    n_dup::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, CASE WHEN t = '' THEN 1.0::DOUBLE ELSE lost::DOUBLE / length(t) END AS lost_share
  FROM worded JOIN by_doc USING (rid) LEFT JOIN covered USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND lost_share <= {MAX_LOST} AS kept, round(lost_share, 9) AS lost_share
FROM counted"""
