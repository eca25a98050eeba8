"""Detail pages of artists, albums, songs, sessions, scenes and places, for all of them at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlore.functions.compat import arg_max, hours, ratio, share, text, week
from playlore.functions.config import Lens
from playlore.operators import sessions
from playlore.operators.joins import top_by
from playlore.plans.base import Catalogue
from playlore.plans.sessions import _CUT, STREAM

C = Catalogue()
QUERIES, ORACLE = C.queries, C.oracle
ALL = Lens()
H = "3600000.0::DOUBLE"
TODAY = "2001-06-01"


def rows() -> Column:
    return F.count(F.lit(1))


def joined(parts: Column, n: int) -> Column:
    """The ids of the first n of an array of (order, id), as a text."""
    return F.array_join(F.transform(F.slice(F.array_sort(parts), 1, n), lambda x: x["id"].cast("string")), ",")


def best(value: str, key: str) -> Column:
    return F.collect_list(F.struct((-F.col(value)).alias("v"), F.col(key).alias("id")))


@C.query("f_artist_detail", "plays", "tracks", sql=f"""t AS (SELECT owner, artist, track, count(*) AS n FROM plays WHERE attended GROUP BY ALL), a AS (SELECT owner, artist, album, count(*) AS n FROM plays JOIN tracks USING (track) WHERE attended GROUP BY ALL),
ts AS (SELECT owner, artist, array_to_string(list(track ORDER BY n DESC, track)[1:5], ',') AS top_tracks FROM t GROUP BY ALL), al AS (SELECT owner, artist, array_to_string(list(album ORDER BY n DESC, album)[1:3], ',') AS top_albums FROM a GROUP BY ALL)
SELECT owner, artist, count(*) AS plays, sum(ms) / {H} AS hours, count(DISTINCT day) AS days, strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day, mode(hour) IS NOT NULL AS heard, any_value(top_tracks) AS top_tracks, any_value(top_albums) AS top_albums
FROM plays JOIN ts USING (owner, artist) JOIN al USING (owner, artist) WHERE attended GROUP BY owner, artist""")
def artist_detail(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """Totals, best songs and best albums of each artist."""
    p = ALL.plays(plays)
    t = p.groupBy("owner", "artist", "track").agg(rows().alias("n")).groupBy("owner", "artist").agg(joined(best("n", "track"), 5).alias("top_tracks"))
    a = p.join(tracks.select("track", "album"), "track").groupBy("owner", "artist", "album").agg(rows().alias("n")).groupBy("owner", "artist").agg(joined(best("n", "album"), 3).alias("top_albums"))
    n = p.groupBy("owner", "artist").agg(rows().alias("plays"), hours(F.sum("ms")).alias("hours"), F.count_distinct("day").alias("days"), text(F.min("day")).alias("first_day"), text(F.max("day")).alias("last_day"), (F.count("hour") > 0).alias("heard"))
    return n.join(t, ["owner", "artist"]).join(a, ["owner", "artist"])


@C.query("f_track_detail", "plays", "tracks", sql=f"""d AS (SELECT owner, track, count(*) AS plays, sum(ms) / {H} AS hours, avg(skipped::INT) AS skip_rate, min(day) AS f, max(day) AS l, (median(ms))::DOUBLE AS median_ms FROM plays WHERE attended GROUP BY ALL)
SELECT owner, track, name, album, plays, hours, skip_rate, strftime(f, '%Y-%m-%d') AS first_day, strftime(l, '%Y-%m-%d') AS last_day, median_ms, round(median_ms / duration_ms, 6) AS completion FROM d JOIN tracks USING (track)""")
def track_detail(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """Totals of each song, and how far it is usually heard."""
    d = ALL.plays(plays).groupBy("owner", "track").agg(rows().alias("plays"), hours(F.sum("ms")).alias("hours"), share(F.col("skipped")).alias("skip_rate"), text(F.min("day")).alias("first_day"), text(F.max("day")).alias("last_day"), F.median("ms").alias("median_ms"))
    t = d.join(tracks.select("track", "name", "album", "duration_ms"), "track")
    return t.withColumn("completion", F.round(F.col("median_ms") / F.col("duration_ms"), 6)).drop("duration_ms")


@C.query("f_search_all", "tracks", "artists", sql="SELECT 'song' AS kind, track AS id, name FROM tracks WHERE contains(lower(name), 'ring') UNION ALL SELECT 'artist', artist, artist_name FROM artists WHERE contains(lower(artist_name), 'ring') OR contains(artist_name, '7') UNION ALL SELECT DISTINCT 'album', 0::BIGINT, album FROM tracks WHERE contains(lower(album), 'ring') OR contains(album, '7')")
def search_all(tracks: DataFrame, artists: DataFrame, term: str = "ring", mark: str = "7") -> DataFrame:
    """Songs, artists and albums by a part of their name."""
    has = lambda c: F.contains(F.lower(c), F.lit(term))
    song = tracks.filter(has("name")).select(F.lit("song").alias("kind"), F.col("track").alias("id"), "name")
    artist = artists.filter(has("artist_name") | F.contains("artist_name", F.lit(mark))).select(F.lit("artist").alias("kind"), F.col("artist").alias("id"), F.col("artist_name").alias("name"))
    album = tracks.filter(has("album") | F.contains("album", F.lit(mark))).select(F.lit("album").alias("kind"), F.lit(0).cast("long").alias("id"), F.col("album").alias("name")).distinct()
    return song.unionByName(artist).unionByName(album)


@C.query("f_session_detail", "stream_plays", sql=_CUT + """ SELECT owner, session, (row_number() OVER (PARTITION BY owner, session ORDER BY played_at, play_id))::INTEGER AS position, play_id, track, artist, ms FROM s""")
def session_detail(plays: DataFrame) -> DataFrame:
    """The plays of each session in order."""
    s = sessions.sessionize(plays, STREAM)
    return s.select("owner", "session", F.row_number().over(Window.partitionBy("owner", "session").orderBy("played_at", "play_id")).alias("position"), "play_id", "track", "artist", "ms")


@C.query("f_span_tracks", "plays", sql=f"SELECT owner, year(day)::INTEGER AS year, track, sum(ms) / {H} AS hours, (row_number() OVER (PARTITION BY owner, year(day) ORDER BY sum(ms) DESC, track))::INTEGER AS rank FROM plays WHERE attended GROUP BY owner, year(day), track QUALIFY row_number() OVER (PARTITION BY owner, year(day) ORDER BY sum(ms) DESC, track) <= 30")
def span_tracks(plays: DataFrame) -> DataFrame:
    """The thirty songs of each span, here years (F26); those from the eleventh on are its deep cuts."""
    n = ALL.plays(plays).groupBy("owner", F.year("day").alias("year"), "track").agg(F.sum("ms").alias("ms"))
    return top_by(n, ["owner", "year"], 30, F.desc("ms"), F.col("track")).select("owner", "year", "track", hours(F.col("ms")).alias("hours"), "rank")


@C.query("f_span_deep_cuts", "plays", sql="SELECT owner, year(day)::INTEGER AS year, track, (row_number() OVER (PARTITION BY owner, year(day) ORDER BY count(*) DESC, sum(ms) DESC, track))::INTEGER AS rank FROM plays WHERE attended GROUP BY owner, year(day), track QUALIFY row_number() OVER (PARTITION BY owner, year(day) ORDER BY count(*) DESC, sum(ms) DESC, track) BETWEEN 11 AND 30")
def span_deep_cuts(plays: DataFrame) -> DataFrame:
    """What was played much in a year behind its ten favourites."""
    n = ALL.plays(plays).groupBy("owner", F.year("day").alias("year"), "track").agg(rows().alias("n"), F.sum("ms").alias("ms"))
    return top_by(n, ["owner", "year"], 30, F.desc("n"), F.desc("ms"), F.col("track")).filter("rank > 10").select("owner", "year", "track", "rank")


@C.query("f_scene_tracks", "plays", "artists", sql=f"SELECT owner, scene, track, sum(ms) / {H} AS hours FROM plays JOIN artists USING (artist) WHERE attended GROUP BY owner, scene, track QUALIFY row_number() OVER (PARTITION BY owner, scene ORDER BY sum(ms) DESC, track) <= 30")
def scene_tracks(plays: DataFrame, artists: DataFrame) -> DataFrame:
    """The songs of each scene."""
    n = ALL.plays(plays).join(artists.select("artist", "scene"), "artist").groupBy("owner", "scene", "track").agg(F.sum("ms").alias("ms"))
    return top_by(n, ["owner", "scene"], 30, F.desc("ms"), F.col("track")).select("owner", "scene", "track", hours(F.col("ms")).alias("hours"))


@C.query("f_album_tracks", "plays", "tracks", sql="SELECT owner, album, track, count(*) AS plays, avg(skipped::INT) AS skip_rate, (row_number() OVER (PARTITION BY owner, album ORDER BY release_year, track))::INTEGER AS position FROM plays JOIN tracks USING (track) WHERE attended GROUP BY owner, album, track, release_year")
def album_tracks(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """Each album's heard songs in its order."""
    n = ALL.plays(plays).join(tracks.select("track", "album", "release_year"), "track").groupBy("owner", "album", "track", "release_year").agg(rows().alias("plays"), share(F.col("skipped")).alias("skip_rate"))
    return n.withColumn("position", F.row_number().over(Window.partitionBy("owner", "album").orderBy("release_year", "track"))).drop("release_year")


_SHELF = f"sh AS (SELECT owner, album, artist, sum(ms)::BIGINT AS ms, count(*) AS plays, min(release_year) AS year FROM plays JOIN tracks USING (track) WHERE attended GROUP BY ALL)"


def shelf(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    return ALL.plays(plays).join(tracks.select("track", "album", "release_year"), "track").groupBy("owner", "album", "artist").agg(F.sum("ms").alias("ms"), rows().alias("plays"), F.min("release_year").alias("year"))


@C.query("f_crate_sections", "plays", "tracks", sql=_SHELF + f" SELECT owner, (year // 10 * 10)::INTEGER AS section, count(*) AS records, sum(ms) / {H} AS hours FROM sh GROUP BY ALL")
def crate_sections(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """Sections of the shelf, here decades."""
    return shelf(plays, tracks).groupBy("owner", (F.floor(F.col("year") / 10) * 10).cast("int").alias("section")).agg(rows().alias("records"), hours(F.sum("ms")).alias("hours"))


@C.query("f_crate_summary", "plays", "tracks", "artists", sql=_SHELF + " SELECT owner, count(*) AS records, count(*) FILTER (plays >= 5) AS worn, count(*) FILTER (plays = 1) AS barely_opened, arg_min(artist, (listeners, artist, album)) AS rarest_artist, arg_min(album, (listeners, artist, album)) AS rarest_album FROM sh JOIN artists USING (artist) GROUP BY owner")
def crate_summary(plays: DataFrame, tracks: DataFrame, artists: DataFrame) -> DataFrame:
    """How large the shelf is, and its rarest record."""
    s = shelf(plays, tracks).join(artists.select("artist", "listeners"), "artist")
    rarest = lambda c: F.min_by(c, F.struct("listeners", "artist", "album"))
    return s.groupBy("owner").agg(rows().alias("records"), F.count_if(F.col("plays") >= 5).alias("worn"), F.count_if(F.col("plays") == 1).alias("barely_opened"), rarest("artist").alias("rarest_artist"), rarest("album").alias("rarest_album"))


@C.query("f_popularity_trajectory", "plays", sql="m AS (SELECT artist, date_trunc('month', day)::DATE AS m, count(DISTINCT owner) AS listeners FROM plays WHERE attended GROUP BY ALL) SELECT artist, strftime(m, '%Y-%m-%d') AS month, listeners, listeners - lag(listeners) OVER (PARTITION BY artist ORDER BY m) AS change FROM m")
def popularity_trajectory(plays: DataFrame) -> DataFrame:
    """An artist's listeners month by month."""
    m = ALL.plays(plays).groupBy("artist", F.trunc("day", "month").alias("m")).agg(F.count_distinct("owner").alias("listeners"))
    return m.select("artist", text(F.col("m")).alias("month"), "listeners", (F.col("listeners") - F.lag("listeners").over(Window.partitionBy("artist").orderBy("m"))).alias("change"))


@C.query("f_entity_obscurity", "plays", "artists", sql="""h AS (SELECT owner, artist, sum(ms)::BIGINT AS ms FROM plays WHERE attended GROUP BY ALL), r AS (SELECT owner, artist, listeners, sum(ms) OVER (PARTITION BY owner)::BIGINT AS total, coalesce(sum(ms) OVER (PARTITION BY owner ORDER BY listeners RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below FROM h JOIN artists USING (artist))
SELECT owner, artist, round(1 - least(log10(1 + listeners) / 7, 1), 6) AS obscurity, round(below::DOUBLE / total::DOUBLE, 6) AS hours_below FROM r""")
def entity_obscurity(plays: DataFrame, artists: DataFrame) -> DataFrame:
    """How little known an artist is, and the share of hours spent on lesser known ones (F102)."""
    h = ALL.plays(plays).groupBy("owner", "artist").agg(F.sum("ms").alias("ms")).join(artists.select("artist", "listeners"), "artist")
    w = Window.partitionBy("owner")
    below = F.coalesce(F.sum("ms").over(w.orderBy("listeners").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return h.select("owner", "artist", F.round(1 - F.least(F.log10(1 + F.col("listeners")) / 7, F.lit(1.0)), 6).alias("obscurity"), F.round(below.cast("double") / F.sum("ms").over(w).cast("double"), 6).alias("hours_below"))


_LIKED = "lk AS (SELECT l.owner, l.track, l.added, coalesce(n, 0) AS n, coalesce(ms, 0)::BIGINT AS ms FROM liked l LEFT JOIN (SELECT owner, track, count(*) AS n, sum(ms) AS ms FROM plays WHERE attended GROUP BY ALL) u ON u.owner = l.owner AND u.track = l.track)"


def liked_use(liked: DataFrame, plays: DataFrame) -> DataFrame:
    u = ALL.plays(plays).groupBy("owner", "track").agg(rows().alias("n"), F.sum("ms").alias("ms"))
    return liked.join(u, ["owner", "track"], "left").fillna(0, ["n", "ms"])


@C.query("f_liked_artists", "liked", "plays", sql=_LIKED + f", a AS (SELECT DISTINCT owner, artist, track FROM plays WHERE attended) SELECT owner, artist, count(*) AS liked, sum(n)::BIGINT AS plays FROM lk JOIN a USING (owner, track) GROUP BY owner, artist QUALIFY row_number() OVER (PARTITION BY owner ORDER BY count(*) DESC, sum(n) DESC, artist) <= 100")
def liked_artists(liked: DataFrame, plays: DataFrame) -> DataFrame:
    """Liked songs by artist."""
    a = ALL.plays(plays).select("owner", "artist", "track").distinct()
    n = liked_use(liked, plays).join(a, ["owner", "track"]).groupBy("owner", "artist").agg(rows().alias("liked"), F.sum("n").alias("plays"))
    return top_by(n, ["owner"], 100, F.desc("liked"), F.desc("plays"), F.col("artist")).drop("rank")


@C.query("f_liked_albums", "liked", "plays", "tracks", sql=_LIKED + " SELECT owner, album, count(*) AS liked, sum(n)::BIGINT AS plays FROM lk JOIN tracks USING (track) GROUP BY owner, album QUALIFY row_number() OVER (PARTITION BY owner ORDER BY count(*) DESC, sum(n) DESC, album) <= 100")
def liked_albums(liked: DataFrame, plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """Liked songs by album."""
    n = liked_use(liked, plays).join(tracks.select("track", "album"), "track").groupBy("owner", "album").agg(rows().alias("liked"), F.sum("n").alias("plays"))
    return top_by(n, ["owner"], 100, F.desc("liked"), F.desc("plays"), F.col("album")).drop("rank")


@C.query("f_liked_facets", "liked", "tracks", sql="j AS (SELECT * FROM liked JOIN tracks USING (track)) SELECT owner, 'tag' AS facet, tag AS value, count(*) AS n FROM j GROUP BY ALL UNION ALL SELECT owner, 'decade', (release_year // 10 * 10)::VARCHAR, count(*) FROM j GROUP BY ALL UNION ALL SELECT owner, 'year added', year(added)::VARCHAR, count(*) FROM j GROUP BY ALL")
def liked_facets(liked: DataFrame, tracks: DataFrame) -> DataFrame:
    """What liked songs can be filtered by (F56): one explode, one aggregation."""
    j = liked.join(tracks.select("track", "tag", "release_year"), "track")
    facet = lambda name, v: F.struct(F.lit(name).alias("facet"), v.cast("string").alias("value"))
    every = F.array(facet("tag", F.col("tag")), facet("decade", (F.floor(F.col("release_year") / 10) * 10).cast("int")), facet("year added", F.year("added")))
    return j.select("owner", F.explode(every).alias("f")).groupBy("owner", "f.facet", "f.value").agg(rows().alias("n"))


_MARKS = "ms AS (SELECT owner, 'artist' AS kind, artist AS id, day, rn AS value FROM (SELECT owner, artist, day, row_number() OVER (PARTITION BY owner, artist ORDER BY day, play_id) AS rn FROM plays WHERE attended) WHERE rn IN (10, 50, 100, 500))"


@C.query("f_recent_milestones", "plays", sql=_MARKS + f" SELECT owner, kind, id, strftime(day, '%Y-%m-%d') AS day, value FROM ms WHERE day <= DATE '{TODAY}' AND day > DATE '{TODAY}' - 45 QUALIFY row_number() OVER (PARTITION BY owner ORDER BY day DESC, value DESC, id) <= 8")
def recent_milestones(plays: DataFrame, days: int = 45) -> DataFrame:
    """An artist's 10th, 50th, 100th and 500th play of late."""
    nth = ALL.plays(plays).withColumn("value", F.row_number().over(Window.partitionBy("owner", "artist").orderBy("day", "play_id")))
    today = F.lit(TODAY).cast("date")
    late = nth.filter(F.col("value").isin(10, 50, 100, 500) & (F.col("day") <= today) & (F.col("day") > F.date_sub(today, days)))
    return top_by(late, ["owner"], 8, F.desc("day"), F.desc("value"), F.col("artist")).select("owner", F.lit("artist").alias("kind"), F.col("artist").alias("id"), text(F.col("day")).alias("day"), F.col("value").cast("long").alias("value"))


@C.query("f_country_artists", "plays", "artists", sql=f"SELECT owner, country, artist, sum(ms) / {H} AS hours FROM plays JOIN artists USING (artist) WHERE attended GROUP BY owner, country, artist QUALIFY row_number() OVER (PARTITION BY owner, country ORDER BY sum(ms) DESC, artist) <= 40")
def country_artists(plays: DataFrame, artists: DataFrame) -> DataFrame:
    """The artists of each country (F146)."""
    n = ALL.plays(plays).join(artists.select("artist", "country"), "artist").groupBy("owner", "country", "artist").agg(F.sum("ms").alias("ms"))
    return top_by(n, ["owner", "country"], 40, F.desc("ms"), F.col("artist")).select("owner", "country", "artist", hours(F.col("ms")).alias("hours"))


@C.query("f_home_country", "plays", "artists", sql="SELECT owner, arg_max(country, (n, country)) AS home, max(n) AS plays FROM (SELECT owner, country, count(*) AS n FROM plays JOIN artists USING (artist) WHERE attended GROUP BY ALL) GROUP BY owner")
def home_country(plays: DataFrame, artists: DataFrame) -> DataFrame:
    """Where most of what is heard comes from, in place of a setting (F148)."""
    n = ALL.plays(plays).join(artists.select("artist", "country"), "artist").groupBy("owner", "country").agg(rows().alias("n"))
    return n.groupBy("owner").agg(arg_max(F.col("country"), F.col("n"), F.col("country")).alias("home"), F.max("n").alias("plays"))


@C.query("f_wild_recent", "stream_plays", sql="SELECT owner, play_id, track, strftime(played_at, '%Y-%m-%d') AS day FROM stream_plays WHERE platform = 'view' QUALIFY row_number() OVER (PARTITION BY owner ORDER BY played_at DESC, play_id DESC) <= 60")
def wild_recent(plays: DataFrame) -> DataFrame:
    """Each place's newest captures (F140)."""
    return top_by(plays.filter("platform = 'view'"), ["owner"], 60, F.desc("played_at"), F.desc("play_id")).select("owner", "play_id", "track", text(F.col("played_at")).alias("day"))


@C.query("f_wild_by_day", "stream_plays", sql="SELECT strftime(played_at, '%Y-%m-%d') AS day, count(*) AS captures, count(DISTINCT track) AS songs, array_to_string(list_sort(list(DISTINCT track))[1:5], ',') AS first_songs FROM stream_plays WHERE platform = 'view' GROUP BY 1")
def wild_by_day(plays: DataFrame) -> DataFrame:
    """What was captured on each day (F141)."""
    w = plays.filter("platform = 'view'").select(text(F.col("played_at")).alias("day"), "track").groupBy("day", "track").agg(rows().alias("n"))
    some = F.array_join(F.transform(F.slice(F.array_sort(F.collect_list("track")), 1, 5), lambda x: x.cast("string")), ",")
    return w.groupBy("day").agg(F.sum("n").alias("captures"), rows().alias("songs"), some.alias("first_songs"))


@C.query("f_week_extras", "plays", "tracks", "artists", sql=f"""w AS (SELECT owner, date_trunc('week', day)::DATE AS wk, * EXCLUDE (owner) FROM plays JOIN tracks USING (track) JOIN artists USING (artist) WHERE attended),
a AS (SELECT owner, wk, arg_max(artist, (n, -artist)) AS artist FROM (SELECT owner, wk, artist, count(*) AS n FROM w GROUP BY ALL) GROUP BY ALL), s AS (SELECT owner, wk, arg_max(track, (n, -track)) AS song FROM (SELECT owner, wk, track, count(*) AS n FROM w GROUP BY ALL) GROUP BY ALL),
c AS (SELECT owner, wk, arg_max(scene, (n, -scene)) AS scene FROM (SELECT owner, wk, scene, count(*) AS n FROM w GROUP BY ALL) GROUP BY ALL)
SELECT owner, strftime(wk, '%Y-%m-%d') AS week, count(*) AS plays, sum(round(bpm * 1000)::BIGINT)::DOUBLE / count(*) / 1000 AS bpm, sum(round(energy * 1000000)::BIGINT)::DOUBLE / count(*) / 1000000 AS energy, any_value(a.artist) AS top_artist, any_value(song) AS top_song, any_value(c.scene) AS top_scene FROM w JOIN a USING (owner, wk) JOIN s USING (owner, wk) JOIN c USING (owner, wk) GROUP BY owner, wk""")
def week_extras(plays: DataFrame, tracks: DataFrame, artists: DataFrame) -> DataFrame:
    """What each week was about (F160)."""
    w = ALL.plays(plays).withColumn("wk", week(F.col("day"))).join(tracks.select("track", "bpm", "energy"), "track").join(artists.select("artist", "scene"), "artist")
    top = lambda key, name: w.groupBy("owner", "wk", key).agg(rows().alias("n")).groupBy("owner", "wk").agg(arg_max(F.col(key), F.col("n"), -F.col(key)).alias(name))
    mean = lambda c, times: (F.sum(F.round(F.col(c) * times).cast("long")).cast("double") / rows() / times).alias(c)
    total = w.groupBy("owner", "wk").agg(rows().alias("plays"), mean("bpm", 1000), mean("energy", 1_000_000))
    every = total.join(top("artist", "top_artist"), ["owner", "wk"]).join(top("track", "top_song"), ["owner", "wk"]).join(top("scene", "top_scene"), ["owner", "wk"])
    return every.withColumn("week", text(F.col("wk"))).drop("wk")


@C.query("f_travel", "plays", "artists", sql="SELECT owner, platform, count(*) AS plays, count(DISTINCT country) AS countries, strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day FROM plays JOIN artists USING (artist) GROUP BY ALL")
def travel(plays: DataFrame, artists: DataFrame) -> DataFrame:
    """Where and by what a listener listened."""
    return plays.join(artists.select("artist", "country"), "artist").groupBy("owner", "platform").agg(rows().alias("plays"), F.count_distinct("country").alias("countries"), text(F.min("day")).alias("first_day"), text(F.max("day")).alias("last_day"))


#: A scene vocabulary: the tags that are filed, by family; generic tags are no scene.
FAMILIES = {"small": "objects", "red": "colours", "blue": "colours", "green": "colours"}
_FAMILY = "CASE split_part(tag, ' ', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FAMILIES.items()) + " END"


def family(tag: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv]), F.split_part(tag, F.lit(" "), F.lit(1)))


@C.query("f_scene_families", "plays", "artist_tags", sql=f"h AS (SELECT artist, sum(ms)::BIGINT AS ms FROM plays WHERE attended GROUP BY 1), t AS (SELECT *, {_FAMILY} AS family FROM artist_tags) SELECT family, count(DISTINCT tag) AS tags, count(DISTINCT artist) AS artists FROM t LEFT JOIN h USING (artist) WHERE family IS NOT NULL GROUP BY family")
def scene_families(plays: DataFrame, artist_tags: DataFrame) -> DataFrame:
    """Families with their tags and artists (F176, F177)."""
    t = artist_tags.withColumn("family", family(F.col("tag"))).filter("family is not null")
    return t.groupBy("family").agg(F.count_distinct("tag").alias("tags"), F.count_distinct("artist").alias("artists"))


@C.query("f_scene_tags", "plays", "artist_tags", sql=f"h AS (SELECT artist, sum(ms)::BIGINT AS ms FROM plays WHERE attended GROUP BY 1), t AS (SELECT *, {_FAMILY} AS family FROM artist_tags) SELECT family, tag, count(*) AS artists, (sum(coalesce(ms, 0)) / {H}) AS hours FROM t LEFT JOIN h USING (artist) WHERE family IS NOT NULL GROUP BY ALL")
def scene_tags(plays: DataFrame, artist_tags: DataFrame) -> DataFrame:
    """The tags of each family and how much they are heard (F179)."""
    h = ALL.plays(plays).groupBy("artist").agg(F.sum("ms").alias("ms"))
    t = artist_tags.withColumn("family", family(F.col("tag"))).filter("family is not null").join(h, "artist", "left")
    return t.groupBy("family", "tag").agg(rows().alias("artists"), hours(F.sum(F.coalesce("ms", F.lit(0)))).alias("hours"))


@C.query("f_unmapped_tags", "artist_tags", sql=f"SELECT tag, count(*) AS artists, max(weight) AS weight FROM artist_tags WHERE {_FAMILY} IS NULL AND tag NOT IN ('standard', 'economy') AND NOT regexp_matches(tag, '^[0-9]{{4}}s?$') GROUP BY tag")
def unmapped_tags(artist_tags: DataFrame, generic: tuple[str, ...] = ("standard", "economy")) -> DataFrame:
    """Tags not filed yet, but for generic ones and years (F180)."""
    left = artist_tags.filter(family(F.col("tag")).isNull() & ~F.col("tag").isin(*generic) & ~F.col("tag").rlike("^[0-9]{4}s?$"))
    return left.groupBy("tag").agg(rows().alias("artists"), F.max("weight").alias("weight"))


@C.query("f_scene_origins", "artists", "artist_tags", sql=f"f AS (SELECT DISTINCT artist FROM artist_tags WHERE {_FAMILY} IS NOT NULL) SELECT country, scene, count(*) AS artists, count(*) FILTER (NOT EXISTS (SELECT 1 FROM f WHERE f.artist = a.artist)) AS by_origin FROM artists a GROUP BY ALL")
def scene_origins(artists: DataFrame, artist_tags: DataFrame) -> DataFrame:
    """Scenes by country, and for how many artists only that tells the scene (F181)."""
    filed = artist_tags.filter(family(F.col("tag")).isNotNull()).select("artist").distinct().withColumn("filed", F.lit(1))
    return artists.join(filed, "artist", "left").groupBy("country", "scene").agg(rows().alias("artists"), F.count_if(F.col("filed").isNull()).alias("by_origin"))


@C.query("f_unmapped_origins", "artists", sql="SELECT country, count(*) AS artists FROM artists WHERE scene NOT IN (0, 1, 2) GROUP BY country")
def unmapped_origins(artists: DataFrame, mapped: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Countries without a scene of their own (F182)."""
    return artists.filter(~F.col("scene").isin(*mapped)).groupBy("country").agg(rows().alias("artists"))


@C.query("f_artist_meta", "artists", "artist_tags", "releases", sql="t AS (SELECT artist, array_to_string(list(tag ORDER BY weight DESC, tag)[1:5], ', ') AS tags FROM artist_tags GROUP BY 1), r AS (SELECT artist, count(*) AS releases, max(released) AS d FROM releases GROUP BY 1) SELECT artist, artist_name, country, listeners, tags, coalesce(releases, 0) AS releases, strftime(d, '%Y-%m-%d') AS last_release FROM artists LEFT JOIN t USING (artist) LEFT JOIN r USING (artist)")
def artist_meta(artists: DataFrame, artist_tags: DataFrame, releases: DataFrame) -> DataFrame:
    """All that is known of each artist (F183)."""
    t = artist_tags.groupBy("artist").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "tag"))), 1, 5), lambda x: x["tag"]), ", ").alias("tags"))
    r = releases.groupBy("artist").agg(rows().alias("releases"), text(F.max("released")).alias("last_release"))
    return artists.join(t, "artist", "left").join(r, "artist", "left").select("artist", "artist_name", "country", "listeners", "tags", F.coalesce("releases", F.lit(0)).alias("releases"), "last_release")


@C.query("f_album_meta", "tracks", sql="SELECT album, count(*) AS songs, min(release_year) AS first_year, max(release_year) AS last_year, sum(duration_ms)::BIGINT AS ms, count(*) FILTER (explicit) AS explicit, array_to_string(list_sort(list(DISTINCT tag)), ', ') AS tags FROM tracks GROUP BY album")
def album_meta(tracks: DataFrame) -> DataFrame:
    """All that is known of each album (F184)."""
    return tracks.groupBy("album").agg(rows().alias("songs"), F.min("release_year").alias("first_year"), F.max("release_year").alias("last_year"), F.sum("duration_ms").alias("ms"), F.count_if("explicit").alias("explicit"), F.array_join(F.array_sort(F.collect_set("tag")), ", ").alias("tags"))


@C.query("f_track_meta", "tracks", "lyrics", sql="SELECT track, name, album, tag, release_year, bpm, energy, key_number::VARCHAR || key_mode AS key, lang, mood, theme, len(words)::INTEGER AS words FROM tracks LEFT JOIN lyrics USING (track)")
def track_meta(tracks: DataFrame, lyrics: DataFrame) -> DataFrame:
    """All that is known of each song (F185)."""
    l = lyrics.select("track", "lang", "mood", "theme", F.size("words").alias("words"))  # noqa: E741
    return tracks.join(l, "track", "left").select("track", "name", "album", "tag", "release_year", "bpm", "energy", F.concat(F.col("key_number").cast("string"), F.col("key_mode")).alias("key"), "lang", "mood", "theme", "words")


@C.query("v_plays_enriched", "plays", "tracks", "artists", "artist_tags", "liked", sql="g AS (SELECT artist, array_to_string(list(tag ORDER BY weight DESC, tag)[1:5], ', ') AS tags FROM artist_tags GROUP BY 1) SELECT play_id, p.owner, strftime(day, '%Y-%m-%d') AS day, hour, ms, skipped, attended, platform, artist_name, country, name, album, bpm, tags, l.track IS NOT NULL AS liked FROM plays p LEFT JOIN tracks USING (track) LEFT JOIN artists USING (artist) LEFT JOIN g USING (artist) LEFT JOIN liked l ON l.owner = p.owner AND l.track = p.track")
def plays_enriched(plays: DataFrame, tracks: DataFrame, artists: DataFrame, artist_tags: DataFrame, liked: DataFrame) -> DataFrame:
    """Each play with all that describes it, flat, for export (V9)."""
    g = artist_tags.groupBy("artist").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), F.col("tag").alias("t")))), 1, 5), lambda x: x["t"]), ", ").alias("tags"))
    j = plays.join(tracks.select("track", "name", "album", "bpm"), "track", "left").join(artists.select("artist", "artist_name", "country"), "artist", "left").join(g, "artist", "left").join(liked.select("owner", "track", F.lit(True).alias("liked")), ["owner", "track"], "left")
    return j.select("play_id", "owner", text(F.col("day")).alias("day"), "hour", "ms", "skipped", "attended", "platform", "artist_name", "country", "name", "album", "bpm", "tags", F.coalesce("liked", F.lit(False)).alias("liked"))


@C.query("v_playlist_affinity", "plays", "artists", sql="""l AS (SELECT owner, artist AS list, track FROM plays GROUP BY ALL), u AS (SELECT owner, track, count(*) AS n, avg(skipped::INT) AS sr FROM plays WHERE attended GROUP BY ALL),
s AS (SELECT owner, list, CASE WHEN n IS NULL THEN 0 WHEN sr > 0.5 THEN 1 WHEN n >= 5 THEN 4 WHEN n >= 2 THEN 3 ELSE 2 END AS score FROM l LEFT JOIN u USING (owner, track)) SELECT owner, list, scene, count(*) AS items, avg(score)::DOUBLE AS affinity FROM s JOIN artists ON artist = list GROUP BY ALL""")
def playlist_affinity(plays: DataFrame, artists: DataFrame) -> DataFrame:
    """How well a list fits its owner: the mean of five tiers of its items (V8)."""
    l = plays.select("owner", F.col("artist").alias("list"), "track").distinct()  # noqa: E741
    u = ALL.plays(plays).groupBy("owner", "track").agg(rows().alias("n"), share(F.col("skipped")).alias("sr"))
    score = F.when(F.col("n").isNull(), 0).when(F.col("sr") > 0.5, 1).when(F.col("n") >= 5, 4).when(F.col("n") >= 2, 3).otherwise(2)
    s = l.join(u, ["owner", "track"], "left").withColumn("score", score).groupBy("owner", "list").agg(rows().alias("items"), ratio(F.sum("score"), rows()).alias("affinity"))
    return s.join(artists.select(F.col("artist").alias("list"), "scene"), "list").select("owner", "list", "scene", "items", "affinity")


_DOSSIER = lambda name, key, where, order: f"SELECT owner, year, '{name}' AS list, {key}::VARCHAR AS item, n FROM (SELECT owner, year(day)::INTEGER AS year, {key}, {order} AS n FROM plays JOIN tracks USING (track) WHERE attended {where} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY owner, year ORDER BY n DESC, {key}) <= 5"


@C.query("f_dossier", "plays", "tracks", sql=" UNION ALL ".join([_DOSSIER("artists", "artist", "", "count(*)"), _DOSSIER("songs", "track", "", "count(*)"), _DOSSIER("skipped", "track", "AND skipped", "count(*)"), _DOSSIER("albums", "album", "", "count(*)"), _DOSSIER("night", "artist", "AND hour < 5", "count(*)")]).join(["", ""]))
def dossier(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """Top lists of each year (F198)."""
    j = ALL.plays(plays).join(tracks.select("track", "album"), "track").withColumn("year", F.year("day"))

    def part(name: str, key: str, df: DataFrame) -> DataFrame:
        n = df.groupBy("owner", "year", key).agg(rows().alias("n"))
        return top_by(n, ["owner", "year"], 5, F.desc("n"), F.col(key)).select("owner", "year", F.lit(name).alias("list"), F.col(key).cast("string").alias("item"), "n")

    parts = [part("artists", "artist", j), part("songs", "track", j), part("skipped", "track", j.filter("skipped")), part("albums", "album", j), part("night", "artist", j.filter("hour < 5"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
