"""Which entry of a catalogue an artist is: evidence in order of its strength, and no answer where there is none.

1. A recording behind one of the artist's most played codes (ISRC) that credits a like name.
2. Of the entries with exactly this name, by name or alias, the only one.
3. Of several, the one whose titles are most of the listener's albums by the artist.
Names are blocked by their normal form, so artists and entries meet by an equi-join on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlore.operators.joins import top_by

#: The least score of a namesake; codes that are asked for an artist; namesakes that are looked at; those whose titles are compared.
SCORE, CODES, NAMESAKES, COMPARED = 80, 2, 10, 5


def normal(name: Column) -> Column:
    """Letters and digits of a name in lower case, words parted by one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def by_code(artists: DataFrame, codes: DataFrame, credits: DataFrame) -> DataFrame:
    """(artist, entry): what the recordings of an artist's codes say; the more played code, then the earlier credit goes first.

    codes: artist, isrc, plays. credits: isrc, position, name, entry.
    """
    asked = top_by(codes, ["artist"], CODES, F.desc("plays"), F.col("isrc")).join(artists.select("artist", normal(F.col("name")).alias("normal")), "artist")
    like = asked.join(credits.select("isrc", "position", "entry", normal(F.col("name")).alias("normal")), ["isrc", "normal"])
    return like.groupBy("artist").agg(F.min_by("entry", F.struct("rank", "position", "entry")).alias("entry"))


def namesakes(artists: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(artist, entry, rank, candidates): entries with the artist's name, the best scores first.

    catalogue: entry, name, aliases (array), score.
    """
    names = F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), normal)))
    entries = catalogue.filter(F.col("score") >= SCORE).select("entry", "score", names.alias("normal")).filter("normal <> ''")
    met = artists.select("artist", normal(F.col("name")).alias("normal")).join(entries, "normal")
    best = top_by(met, ["artist"], NAMESAKES, F.desc("score"), F.col("entry"))
    return best.withColumn("candidates", F.count(F.lit(1)).over(Window.partitionBy("artist"))).select("artist", "entry", "rank", "candidates")


def by_titles(candidates: DataFrame, albums: DataFrame, titles: DataFrame) -> DataFrame:
    """(artist, entry, hits): of several namesakes the one that has most of the artist's albums, the better ranked of equals.

    albums: artist, title. titles: entry, title.
    """
    few = candidates.filter((F.col("candidates") > 1) & (F.col("rank") <= COMPARED))
    mine = albums.select("artist", normal(F.col("title")).alias("title")).distinct()
    theirs = titles.select("entry", normal(F.col("title")).alias("title"))  # repeats count, as each release does
    shared = few.join(theirs, "entry").join(mine, ["artist", "title"]).groupBy("artist", "entry", "rank").agg(F.count(F.lit(1)).alias("hits"))
    return shared.groupBy("artist").agg(F.min_by(F.struct("entry", "hits"), F.struct(-F.col("hits"), "rank")).alias("b")).select("artist", "b.*")


def match(artists: DataFrame, codes: DataFrame, credits: DataFrame, catalogue: DataFrame, albums: DataFrame, titles: DataFrame) -> DataFrame:
    """(artist, entry, method, candidates): method is isrc, name, albums, ambiguous or none; the last two have no entry."""
    coded = by_code(artists, codes, credits).withColumnRenamed("entry", "coded")
    same = namesakes(artists, catalogue)
    only = same.groupBy("artist").agg(F.max("candidates").alias("n"), F.min_by("entry", "rank").alias("first"))
    titled = by_titles(same, albums, titles).select("artist", F.col("entry").alias("titled"))
    x = artists.select("artist").join(coded, "artist", "left").join(only, "artist", "left").join(titled, "artist", "left")
    n = F.coalesce("n", F.lit(0))
    method = F.when(F.col("coded").isNotNull(), "isrc").when(n == 0, "none").when(n == 1, "name").when(F.col("titled").isNotNull(), "albums").otherwise("ambiguous")
    entry = F.when(method == "isrc", F.col("coded")).when(method == "name", F.col("first")).when(method == "albums", F.col("titled"))
    return x.select("artist", entry.alias("entry"), method.alias("method"), F.when(method == "isrc", 0).otherwise(n).cast("long").alias("candidates"))


def verify(matches: DataFrame, coded: DataFrame) -> DataFrame:
    """Matches by name or albums that codes contradict, with the entry that the codes name (W6). coded: as by_code gives."""
    doubtful = matches.filter("method in ('name', 'albums')").select("artist", F.col("entry").alias("was"))
    return doubtful.join(coded, "artist").filter("entry <> was").select("artist", "was", "entry")
