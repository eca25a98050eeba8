"""Search by an inverted index of names, against scans of all names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlore.functions.compat import hours
from playlore.functions.config import Lens
from playlore.functions.scratch import new_folder
from playlore.operators import search
from playlore.operators.joins import top_by
from playlore.plans.base import Catalogue

C = Catalogue()
QUERIES, ORACLE = C.queries, C.oracle
ALL = Lens()
TERMS, LETTERS = ("red", "RING", "er", "brand#1", "lier#0000", "no such name", "x"), ("rin", "b# 1", "s0 7", "gd")
#: How many are listed of each kind.
LISTED = {"artist": 15, "song": 25, "album": 12}


def names(tracks: DataFrame, artists: DataFrame) -> DataFrame:
    song = tracks.select(F.lit("song").alias("kind"), F.col("track").cast("string").alias("id"), "name")
    artist = artists.select(F.lit("artist").alias("kind"), F.col("artist").cast("string").alias("id"), F.col("artist_name").alias("name"))
    return song.unionByName(artist).unionByName(tracks.select(F.lit("album").alias("kind"), F.col("album").alias("id"), F.col("album").alias("name")).distinct())


def indexed(tracks: DataFrame, artists: DataFrame) -> str:
    folder = new_folder(tracks.sparkSession, "names")
    search.write_index(names(tracks, artists), folder)
    return folder


_NAMES = "n AS (SELECT 'song' AS kind, track::VARCHAR AS id, name FROM tracks UNION ALL SELECT 'artist', artist::VARCHAR, artist_name FROM artists UNION ALL SELECT DISTINCT 'album', album, album FROM tracks)"
_HITS = f"t(term) AS (VALUES {', '.join(f"('{t}')" for t in TERMS)}), h AS (SELECT term, kind, id, name FROM n JOIN t ON length(term) > 1 AND contains(lower(name), lower(term)))"


@C.query("f_search_index", "tracks", "artists", sql=f"{_NAMES}, {_HITS} SELECT * FROM h")
def found(tracks: DataFrame, artists: DataFrame) -> DataFrame:
    """Songs, artists and albums by parts of their names (F9): one partition of the index is read for each term."""
    return search.search(tracks.sparkSession, indexed(tracks, artists), list(TERMS))


@C.query("f_search_ranked", "plays", "tracks", "artists", sql=f"""{_NAMES}, {_HITS}, p AS (SELECT p.*, album FROM plays p JOIN tracks USING (track) WHERE attended),
u AS (SELECT 'song' AS kind, track::VARCHAR AS id, count(*) AS plays, sum(ms)::BIGINT AS ms FROM p GROUP BY ALL UNION ALL SELECT 'artist', artist::VARCHAR, count(*), sum(ms)::BIGINT FROM p GROUP BY ALL UNION ALL SELECT 'album', album, count(*), sum(ms)::BIGINT FROM p GROUP BY ALL)
SELECT term, kind, id, plays, ms / 3600000.0::DOUBLE AS hours, (row_number() OVER (PARTITION BY term, kind ORDER BY CASE kind WHEN 'artist' THEN ms ELSE plays END DESC, id))::INTEGER AS rank FROM h JOIN u USING (kind, id)
QUALIFY rank <= CASE kind {" ".join(f"WHEN '{k}' THEN {n}" for k, n in LISTED.items())} END""")
def ranked(plays: DataFrame, tracks: DataFrame, artists: DataFrame) -> DataFrame:
    """What a search lists (F9): artists by hours, songs and albums by plays. Only plays of what was found are counted."""
    hits = search.search(tracks.sparkSession, indexed(tracks, artists), list(TERMS)).select("term", "kind", "id")
    p = ALL.plays(plays).join(tracks.select("track", "album"), "track")
    ids = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("id")) for k, c in (("song", "track"), ("artist", "artist"), ("album", "album"))]))
    heard = p.select("ms", ids.alias("x")).select("ms", "x.*").join(hits.select("kind", "id").distinct(), ["kind", "id"], "left_semi")
    use = heard.groupBy("kind", "id").agg(F.count(F.lit(1)).alias("plays"), F.sum("ms").alias("ms"))
    best = top_by(hits.join(use, ["kind", "id"]), ["term", "kind"], max(LISTED.values()), F.desc(F.when(F.col("kind") == "artist", F.col("ms")).otherwise(F.col("plays"))), F.col("id"))
    most = F.create_map(*[F.lit(x) for kv in LISTED.items() for x in kv])
    return best.filter(F.col("rank") <= most[F.col("kind")]).select("term", "kind", "id", "plays", hours(F.col("ms")).alias("hours"), "rank")


@C.query("f_fuzzy_score", "tracks", "artists", sql=f"""{_NAMES}, t(term) AS (VALUES {", ".join(f"('{t}')" for t in LETTERS)}), q AS (SELECT term, regexp_replace(lower(term), '\\s+', '', 'g') AS q FROM t),
f(term, q, kind, id, name, k, spot, run, first, score) AS (SELECT term, q, kind, id, name, 0, 0, 0, -1, 0 FROM n, q
  UNION ALL SELECT term, q, kind, id, name, k + 1, i + 1, CASE WHEN i = spot THEN run + 1 ELSE 1 END, CASE WHEN first < 0 THEN i ELSE first END,
    score + 1 + CASE WHEN i = 0 OR regexp_matches(lower(name)[i], '[\\s&/·\\-—(]') THEN 3 ELSE 0 END + CASE WHEN i = spot AND run > 0 THEN run + 1 ELSE 0 END
  FROM (SELECT *, spot + strpos(lower(name)[spot + 1:], q[k + 1]) - 1 AS i, strpos(lower(name)[spot + 1:], q[k + 1]) AS hit FROM f WHERE k < length(q)) WHERE hit > 0)
SELECT term, kind, id, name, (100 * (score + CASE WHEN starts_with(lower(name), lower(term)) THEN 10 ELSE 0 END) - 20 * first - 2 * (length(name) - length(q)))::DOUBLE / 100.0::DOUBLE AS score FROM f WHERE k = length(q)""")
def fuzzy(tracks: DataFrame, artists: DataFrame) -> DataFrame:
    """Names that have some letters in order, scored (F216); candidates by the rarest ordered pair of letters."""
    return search.fuzzy(tracks.sparkSession, indexed(tracks, artists), list(LETTERS))
