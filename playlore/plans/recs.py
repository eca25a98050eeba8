"""Recommendations from tables of like artists, tags, relations and releases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlore.functions.compat import text
from playlore.functions.config import Lens
from playlore.functions.scratch import written
from playlore.operators.joins import top_by
from playlore.plans.base import Catalogue

C = Catalogue()
QUERIES, ORACLE = C.queries, C.oracle
ALL = Lens()
TODAY = "2001-06-01"
#: Plays from which an artist counts as owned.
OWNED = 25
_OWN = f"own AS (SELECT owner, artist, sum(ms)::BIGINT AS ms FROM plays WHERE attended GROUP BY ALL HAVING count(*) >= {OWNED})"


def owned(plays: DataFrame) -> DataFrame:
    """(owner, artist, ms) of the artists that a listener has."""
    return ALL.plays(plays).groupBy("owner", "artist").agg(F.sum("ms").alias("ms"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OWNED).drop("n")


def _new(candidates: DataFrame, own: DataFrame) -> DataFrame:
    return candidates.join(own.select("owner", "artist"), ["owner", "artist"], "left_anti")


def _scored(candidates: DataFrame, n: int) -> DataFrame:
    """(owner, artist, s) -> the best n of each owner, as shares of the best."""
    best = candidates.withColumn("score", F.round(F.col("s") / F.max("s").over(Window.partitionBy("owner")), 6))
    return top_by(best, ["owner"], n, F.desc("score"), F.col("artist"))


def by_edges(own: DataFrame, edges: DataFrame) -> DataFrame:
    """(owner, artist, s): the likeness to owned artists, by the logarithm of their hours."""
    return _new(own.join(edges, "artist").groupBy("owner", F.col("other").alias("artist")).agg(F.sum(F.col("match") * F.log10(1 + F.col("ms") / F.lit(3600000.0))).alias("s")), own)


_EDGES = "e AS (SELECT owner, other AS artist, sum(match * log10(1 + ms / 3600000.0::DOUBLE)) AS s FROM own JOIN edges USING (artist) GROUP BY ALL), e1 AS (SELECT e.* FROM e ANTI JOIN own USING (owner, artist))"
_SIGNATURE = "sig AS (SELECT owner, tag, sum(ms * weight)::BIGINT AS w FROM own JOIN artist_tags USING (artist) GROUP BY owner, tag QUALIFY row_number() OVER (PARTITION BY owner ORDER BY sum(ms * weight) DESC, tag) <= 10)"
_TAGGED = _SIGNATURE + ", g AS (SELECT owner, t.artist, count(*) AS tags, arg_max(tag, (w * weight, tag)) AS via, sum((w * weight)::DOUBLE) AS s FROM sig JOIN artist_tags t USING (tag) GROUP BY ALL), g1 AS (SELECT g.* FROM g ANTI JOIN own USING (owner, artist))"
_BEST = lambda source, n, more="": f"SELECT owner, artist, {more} score FROM (SELECT *, round(s / max(s) OVER (PARTITION BY owner), 6) AS score FROM {source}) QUALIFY row_number() OVER (PARTITION BY owner ORDER BY score DESC, artist) <= {n}"


def by_tags(own: DataFrame, artist_tags: DataFrame) -> DataFrame:
    """(owner, artist, tags, via, s): artists that carry the ten tags which weigh most in what a listener has."""
    signature = own.join(artist_tags, "artist").groupBy("owner", "tag").agg(F.sum(F.col("ms") * F.col("weight")).alias("w"))
    sig = top_by(signature, ["owner"], 10, F.desc("w"), F.col("tag")).drop("rank")
    part = F.col("w") * F.col("weight")
    found = sig.join(artist_tags, "tag").groupBy("owner", "artist").agg(F.count(F.lit(1)).alias("tags"), F.max_by("tag", F.struct(part, "tag")).alias("via"), F.sum(part.cast("double")).alias("s"))
    return _new(found, own)


@C.query("f_tag_affinity", "plays", "artist_tags", sql=f"{_OWN}, {_TAGGED} {_BEST('g1', 20, 'tags, via,')}")
def tag_affinity(plays: DataFrame, artist_tags: DataFrame) -> DataFrame:
    """Artists of a listener's own tags whom they don't have."""
    return _scored(by_tags(owned(plays), artist_tags), 20).select("owner", "artist", "tags", "via", "score")


_RELATED = "rel AS (SELECT artist, other, ['member of', 'collaboration', 'founder'][(artist + other) % 3 + 1] AS kind FROM edges WHERE match = 0.5)"
_SIDE = _RELATED + ", p AS (SELECT owner, other AS artist, artist AS via, kind, ms::DOUBLE AS s FROM own JOIN rel USING (artist) QUALIFY row_number() OVER (PARTITION BY owner, other ORDER BY ms DESC, artist) = 1), p1 AS (SELECT p.* FROM p ANTI JOIN own USING (owner, artist))"


def relations(edges: DataFrame) -> DataFrame:
    """(artist, other, kind): the nearest edges as relations of members and founders."""
    kind = F.element_at(F.array(F.lit("member of"), F.lit("collaboration"), F.lit("founder")), ((F.col("artist") + F.col("other")) % 3 + 1).cast("int"))
    return edges.filter("match = 0.5").select("artist", "other", kind.alias("kind"))


def by_relations(own: DataFrame, edges: DataFrame) -> DataFrame:
    """(owner, artist, via, kind, s): others in the bands of owned artists, each by the one most heard."""
    found = own.join(relations(edges), "artist").select("owner", F.col("other").alias("artist"), F.col("artist").alias("via"), "kind", F.col("ms").cast("double").alias("s"))
    return _new(top_by(found, ["owner", "artist"], 1, F.desc("s"), F.col("via")).drop("rank"), own)


@C.query("f_side_projects", "plays", "edges", sql=f"{_OWN}, {_SIDE} {_BEST('p1', 15, 'via, kind,')}")
def side_projects(plays: DataFrame, edges: DataFrame) -> DataFrame:
    """Side projects of artists that a listener has."""
    return _scored(by_relations(owned(plays), edges), 15).select("owner", "artist", "via", "kind", "score")


@C.query("f_release_radar", "plays", "releases", sql=f"""{_OWN} SELECT owner, artist, release, kind, strftime(released, '%Y-%m-%d') AS released, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY ms DESC, released DESC, release) AS rank
  FROM own JOIN releases USING (artist) WHERE released > DATE '{TODAY}' - 180 AND released <= DATE '{TODAY}') WHERE rank <= 20""")
def release_radar(plays: DataFrame, releases: DataFrame, days: int = 180) -> DataFrame:
    """New records of owned artists, most heard first."""
    today = F.lit(TODAY).cast("date")
    new = releases.filter((F.col("released") > F.date_sub(today, days)) & (F.col("released") <= today))
    best = top_by(owned(plays).join(new, "artist"), ["owner"], 20, F.desc("ms"), F.desc("released"), F.col("release"))
    return best.select("owner", "artist", "release", "kind", text(F.col("released")).alias("released"), "rank")


_ENGINES = f"{_OWN}, {_EDGES}, {_TAGGED}, {_SIDE}, u AS (SELECT 1 AS o, 'adjacency' AS engine, * FROM ({_BEST('e1', 20)}) UNION ALL SELECT 2, 'tag', * FROM ({_BEST('g1', 20)}) UNION ALL SELECT 3, 'relation', * FROM ({_BEST('p1', 20)}))"


def engines(plays: DataFrame, edges: DataFrame, artist_tags: DataFrame) -> DataFrame:
    """(o, engine, owner, artist, score) of the three engines, in their order."""
    own = owned(plays)
    parts = [("adjacency", by_edges(own, edges)), ("tag", by_tags(own, artist_tags)), ("relation", by_relations(own, edges))]
    return reduce(DataFrame.unionByName, [_scored(df, 20).select(F.lit(i + 1).alias("o"), F.lit(name).alias("engine"), "owner", "artist", "score") for i, (name, df) in enumerate(parts)])


@C.query("f_inbox", "plays", "edges", "artist_tags", sql=f"{_ENGINES}, one AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY owner, artist ORDER BY o) = 1) SELECT owner, artist, engine, score FROM one QUALIFY row_number() OVER (PARTITION BY owner ORDER BY score DESC, artist) <= 30")
def inbox(plays: DataFrame, edges: DataFrame, artist_tags: DataFrame) -> DataFrame:
    """All engines' finds, each artist once by the first engine that has it."""
    one = top_by(engines(plays, edges, artist_tags), ["owner", "artist"], 1, F.col("o")).drop("rank")
    return top_by(one, ["owner"], 30, F.desc("score"), F.col("artist")).select("owner", "artist", "engine", "score")


@C.query("f_mixtape_artists", "plays", "edges", "artist_tags", sql=f"{_ENGINES} SELECT owner, engine, artist, score FROM u QUALIFY row_number() OVER (PARTITION BY owner, engine ORDER BY score DESC, artist) <= 12")
def mixtape_artists(plays: DataFrame, edges: DataFrame, artist_tags: DataFrame) -> DataFrame:
    """A dozen of each engine, for a mixtape."""
    return top_by(engines(plays, edges, artist_tags), ["owner", "engine"], 12, F.desc("score"), F.col("artist")).select("owner", "engine", "artist", "score")


@C.query("f_blind_spots", "plays", "edges", sql="""k AS (SELECT owner, artist FROM plays WHERE attended GROUP BY ALL HAVING count(*) >= 25) SELECT c.owner, c.artist, c.pointers, c.via FROM (SELECT owner, other AS artist, count(*) AS pointers, array_to_string(list(artist ORDER BY match DESC, artist)[1:4], ',') AS via FROM k JOIN edges USING (artist) GROUP BY ALL HAVING count(*) >= 2) c ANTI JOIN k USING (owner, artist)""")
def blind_spots(plays: DataFrame, edges: DataFrame) -> DataFrame:
    """Artists whom two or more of a listener's own point to (F130)."""
    k = owned(plays).select("owner", "artist")
    via = F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("match")).alias("m"), F.col("artist").alias("a")))), 1, 4), lambda x: x["a"].cast("string")), ",")
    found = k.join(edges, "artist").groupBy("owner", "other").agg(F.count(F.lit(1)).alias("pointers"), via.alias("via")).filter("pointers >= 2").withColumnRenamed("other", "artist")
    return _new(found, k).select("owner", "artist", "pointers", "via")


@C.query("f_doorstep_scenes", "plays", "artists", "edges", sql="""h AS (SELECT owner, scene, sum(ms)::BIGINT AS ms FROM plays JOIN artists USING (artist) WHERE attended GROUP BY ALL), s AS (SELECT owner, scene, ms / sum(ms) OVER (PARTITION BY owner) AS share FROM h),
t AS (SELECT owner, b.scene, count(DISTINCT b.artist) AS touching FROM (SELECT DISTINCT owner, artist FROM plays WHERE attended) k JOIN edges USING (artist) JOIN artists b ON b.artist = other GROUP BY ALL) SELECT t.owner, t.scene, touching, round(coalesce(share, 0), 6) AS share FROM t LEFT JOIN s USING (owner, scene) WHERE touching >= 3 AND coalesce(share, 0) < 0.22""")
def doorstep_scenes(plays: DataFrame, artists: DataFrame, edges: DataFrame, below: float = 0.22) -> DataFrame:
    """Scenes little heard that three or more neighbours of heard artists belong to (F130)."""
    p, scene = ALL.plays(plays), artists.select("artist", "scene")
    h = p.join(scene, "artist").groupBy("owner", "scene").agg(F.sum("ms").alias("ms"))
    share = h.select("owner", "scene", (F.col("ms").cast("double") / F.sum("ms").over(Window.partitionBy("owner"))).alias("share"))
    t = p.select("owner", "artist").distinct().join(edges, "artist").select("owner", F.col("other").alias("artist")).join(scene, "artist").groupBy("owner", "scene").agg(F.count_distinct("artist").alias("touching")).filter("touching >= 3")
    return t.join(share, ["owner", "scene"], "left").withColumn("share", F.round(F.coalesce("share", F.lit(0.0)), 6)).filter(F.col("share") < below)


@C.query("f_genre_discover", "plays", "edges", "artist_tags", sql=f"""{_OWN}, d AS (SELECT owner, tag, other AS artist, sum(match) AS s FROM own JOIN artist_tags USING (artist) JOIN edges USING (artist) GROUP BY ALL), n AS (SELECT d.* FROM d ANTI JOIN own USING (owner, artist))
SELECT owner, tag, artist, score FROM (SELECT *, round(s / max(s) OVER (PARTITION BY owner, tag), 6) AS score FROM n) QUALIFY row_number() OVER (PARTITION BY owner, tag ORDER BY score DESC, artist) <= 5""")
def genre_discover(plays: DataFrame, edges: DataFrame, artist_tags: DataFrame) -> DataFrame:
    """For each tag, new artists next to a listener's own of that tag (F152)."""
    own = owned(plays)
    d = own.join(artist_tags, "artist").join(edges, "artist").groupBy("owner", "tag", F.col("other").alias("artist")).agg(F.sum("match").alias("s"))
    best = _new(d, own).withColumn("score", F.round(F.col("s") / F.max("s").over(Window.partitionBy("owner", "tag")), 6))
    return top_by(best, ["owner", "tag"], 5, F.desc("score"), F.col("artist")).select("owner", "tag", "artist", "score")


@C.query("f_genre_tags", "plays", "artist_tags", sql="SELECT owner, tag, count(DISTINCT artist) AS artists, sum(ms * weight)::DOUBLE / 360000000.0::DOUBLE AS weighted_hours FROM (SELECT owner, artist, sum(ms)::BIGINT AS ms FROM plays WHERE attended GROUP BY ALL) JOIN artist_tags USING (artist) GROUP BY ALL HAVING count(DISTINCT artist) >= 2")
def genre_tags(plays: DataFrame, artist_tags: DataFrame) -> DataFrame:
    """Tags by hours, each artist's by the weight of the tag (F150)."""
    a = ALL.plays(plays).groupBy("owner", "artist").agg(F.sum("ms").alias("ms")).join(artist_tags, "artist")
    return a.groupBy("owner", "tag").agg(F.count(F.lit(1)).alias("artists"), (F.sum(F.col("ms") * F.col("weight")).cast("double") / 360000000.0).alias("weighted_hours")).filter("artists >= 2")


@C.query("f_dig_deeper", "plays", sql="""cat AS (SELECT artist, count(DISTINCT track) AS known FROM plays GROUP BY 1), h AS (SELECT owner, artist, track, count(*) AS n FROM plays WHERE attended GROUP BY ALL)
SELECT owner, artist, known, count(*) AS heard, count(*) FILTER (n = 1) AS barely, known - count(*) AS unplayed, count(*)::DOUBLE / known AS penetration FROM h JOIN cat USING (artist) GROUP BY owner, artist, known""")
def dig_deeper(plays: DataFrame) -> DataFrame:
    """How far into an artist's catalogue a listener has got (F164)."""
    known = plays.groupBy("artist").agg(F.count_distinct("track").alias("known"))
    h = ALL.plays(plays).groupBy("owner", "artist", "track").agg(F.count(F.lit(1)).alias("n")).groupBy("owner", "artist").agg(F.count(F.lit(1)).alias("heard"), F.count_if(F.col("n") == 1).alias("barely"))
    return h.join(known, "artist").select("owner", "artist", "known", "heard", "barely", (F.col("known") - F.col("heard")).alias("unplayed"), (F.col("heard").cast("double") / F.col("known")).alias("penetration"))


@C.query("f_dig_tracks", "plays", sql=f"""{_OWN}, cat AS (SELECT artist, track, count(*) AS n FROM plays GROUP BY ALL), mine AS (SELECT DISTINCT owner, track FROM plays WHERE attended) SELECT c.owner, c.artist, c.track, c.n AS plays_of_others FROM (SELECT owner, artist, track, n FROM own JOIN cat USING (artist)) c ANTI JOIN mine USING (owner, track)
QUALIFY row_number() OVER (PARTITION BY c.owner, c.artist ORDER BY c.n DESC, c.track) <= 3""")
def dig_tracks(plays: DataFrame, first: int = 32) -> DataFrame:
    """Songs of owned artists that others play and the listener never did (F164).

    The first songs of an artist are tried, as many as about make an artist owned, so candidates are no more than plays. Only for a
    listener who knows so many of them that fewer than three stay are more tried, sixteen times as many a round, to the catalogue's end.
    """
    cat = written(plays.groupBy("artist", "track").agg(F.count(F.lit(1)).alias("plays_of_others")), "catalogue")
    left, found = written(owned(plays).select("owner", "artist"), "owned"), []
    order = [F.desc("plays_of_others"), F.col("track")]
    while True:
        mine = ALL.plays(plays).select("owner", "track")
        mine = (mine.join(left.select("owner").distinct(), "owner", "left_semi") if found else mine).distinct()
        ahead = written(top_by(cat.join(left.select("artist").distinct(), "artist", "left_semi"), ["artist"], first, *order, name="place"), "first-songs")
        unheard = left.join(ahead.drop("place"), "artist").join(mine, ["owner", "track"], "left_anti")
        best = written(top_by(unheard, ["owner", "artist"], 3, *order), "unheard")
        more = ahead.filter(F.col("place") == first).select("artist")
        short = written(left.join(more, "artist", "left_semi").join(best.filter("rank = 3"), ["owner", "artist"], "left_anti"), "owned-to-try")
        found.append(best.join(short, ["owner", "artist"], "left_anti"))
        if short.isEmpty():
            return reduce(DataFrame.unionByName, found).select("owner", "artist", "track", "plays_of_others")
        left, first = short, 16 * first


@C.query("f_tree_candidates", "plays", "edges", sql=f"{_RELATED}, h AS (SELECT owner, artist, sum(ms)::BIGINT AS ms FROM plays WHERE attended GROUP BY ALL), r AS (SELECT artist, count(*) AS relations FROM rel GROUP BY 1) SELECT owner, artist, relations, ms / 3600000.0::DOUBLE AS hours FROM h JOIN r USING (artist) QUALIFY row_number() OVER (PARTITION BY owner ORDER BY relations DESC, ms DESC, artist) <= 80")
def tree_candidates(plays: DataFrame, edges: DataFrame) -> DataFrame:
    """Artists with relations to draw a family tree from (F174)."""
    r = relations(edges).groupBy("artist").agg(F.count(F.lit(1)).alias("relations"))
    h = ALL.plays(plays).groupBy("owner", "artist").agg(F.sum("ms").alias("ms")).join(r, "artist")
    return top_by(h, ["owner"], 80, F.desc("relations"), F.desc("ms"), F.col("artist")).select("owner", "artist", "relations", (F.col("ms").cast("double") / 3600000.0).alias("hours"))


@C.query("f_related_records", "plays", "tracks", "edges", sql=f"""a AS (SELECT owner, artist, album, count(*) AS n, max(day) AS last_day FROM plays JOIN tracks USING (track) WHERE attended GROUP BY ALL), x AS (SELECT owner, artist, min(n) AS least, max(last_day) AS last_day FROM a GROUP BY ALL)
SELECT a.owner, a.artist, 'barely opened' AS kind, a.album, NULL::BIGINT AS other FROM a WHERE n = 1 UNION ALL
SELECT x.owner, x.artist, 'dormant neighbour', NULL, other FROM x JOIN edges e ON e.artist = x.artist JOIN x y ON y.owner = x.owner AND y.artist = e.other WHERE match = 0.5 AND y.last_day < DATE '{TODAY}' - 120""")
def related_records(plays: DataFrame, tracks: DataFrame, edges: DataFrame) -> DataFrame:
    """Beside an artist: albums heard once, and next artists that fell silent."""
    a = ALL.plays(plays).join(tracks.select("track", "album"), "track").groupBy("owner", "artist", "album").agg(F.count(F.lit(1)).alias("n"), F.max("day").alias("last_day"))
    last = a.groupBy("owner", "artist").agg(F.max("last_day").alias("last_day"))
    barely = a.filter("n = 1").select("owner", "artist", F.lit("barely opened").alias("kind"), "album", F.lit(None).cast("long").alias("other"))
    silent = last.filter(F.col("last_day") < F.date_sub(F.lit(TODAY).cast("date"), 120)).select("owner", F.col("artist").alias("other"))
    dormant = last.join(edges.filter("match = 0.5"), "artist").join(silent, ["owner", "other"]).select("owner", "artist", F.lit("dormant neighbour").alias("kind"), F.lit(None).cast("string").alias("album"), "other")
    return barely.unionByName(dormant)
