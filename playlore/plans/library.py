"""Playlists, ambient captures, scenes, concerts, receipts and orderings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlore.functions.compat import arg_max, hours, ratio, share, text, week
from playlore.functions.config import Lens
from playlore.operators import vectors
from playlore.operators.islands import change_runs, day_runs
from playlore.operators.joins import spread, top_by
from playlore.plans.base import Catalogue

C = Catalogue()
QUERIES, ORACLE = C.queries, C.oracle
ALL = Lens()
H = "3600000.0::DOUBLE"
TODAY = "2001-06-01"

#: A playlist of the driver's tables: an artist's tracks as a listener found them, added on the day of the find.
_LISTS = "lists AS (SELECT owner, artist AS list, track, min(day) AS added FROM plays GROUP BY ALL)"


def lists(plays: DataFrame) -> DataFrame:
    return plays.groupBy("owner", F.col("artist").alias("list"), "track").agg(F.min("day").alias("added"))


_ITEMS = _LISTS + f""", u AS (SELECT track, count(*) AS plays, avg(skipped::INT) AS sr, max(day) AS last_day FROM plays WHERE attended GROUP BY track),
items AS (SELECT owner, list, l.track, added, coalesce(plays, 0) AS plays, sr, last_day, CASE WHEN coalesce(plays, 0) = 0 THEN 'unheard' WHEN plays >= 8 AND sr <= 0.2 THEN 'gem' WHEN plays >= 5 AND sr >= 0.5 THEN 'dead' WHEN plays >= 20 THEN 'core' ELSE 'ok' END AS kind FROM lists l LEFT JOIN u USING (track))"""


def items(plays: DataFrame) -> DataFrame:
    """A playlist's items with the plays of all listeners and what they amount to (F136)."""
    use = ALL.plays(plays).groupBy("track").agg(F.count(F.lit(1)).alias("plays"), share(F.col("skipped")).alias("sr"), F.max("day").alias("last_day"))
    joined = lists(plays).join(use, "track", "left").withColumn("plays", F.coalesce("plays", F.lit(0)))
    kind = F.when(F.col("plays") == 0, "unheard").when((F.col("plays") >= 8) & (F.col("sr") <= 0.2), "gem").when((F.col("plays") >= 5) & (F.col("sr") >= 0.5), "dead").when(F.col("plays") >= 20, "core").otherwise("ok")
    return joined.withColumn("kind", kind)


@C.query("f_playlist_items", "plays", sql=_ITEMS + " SELECT owner, list, track, plays, sr AS skip_rate, kind FROM items")
def playlist_items(plays: DataFrame) -> DataFrame:
    return items(plays).select("owner", "list", "track", "plays", F.col("sr").alias("skip_rate"), "kind")


@C.query("f_playlist_health", "plays", sql=_ITEMS + " SELECT owner, list, count(*) AS items, count(*) FILTER (kind = 'gem') AS gems, count(*) FILTER (kind = 'dead') AS dead, count(*) FILTER (kind = 'unheard') AS unheard, count(*) FILTER (plays > 0)::DOUBLE / count(*) AS completion FROM items GROUP BY ALL")
def playlist_health(plays: DataFrame) -> DataFrame:
    """Items first, lists after (F134)."""
    kinds = [F.count_if(F.col("kind") == k).alias(n) for n, k in (("gems", "gem"), ("dead", "dead"), ("unheard", "unheard"))]
    return items(plays).groupBy("owner", "list").agg(F.count(F.lit(1)).alias("items"), *kinds, (F.count_if(F.col("plays") > 0).cast("double") / F.count(F.lit(1))).alias("completion"))


@C.query("f_playlist_totals", "plays", sql=_ITEMS + " SELECT owner, count(DISTINCT list) AS lists, count(*) AS items, count(DISTINCT track) AS tracks, count(*) FILTER (kind = 'gem') AS gems, count(*) FILTER (kind = 'dead') AS dead FROM items GROUP BY owner")
def playlist_totals(plays: DataFrame) -> DataFrame:
    """All of a listener's lists together (F135)."""
    kinds = [F.count_if(F.col("kind") == k).alias(n) for n, k in (("gems", "gem"), ("dead", "dead"))]
    return items(plays).groupBy("owner").agg(F.count_distinct("list").alias("lists"), F.count(F.lit(1)).alias("items"), F.count_distinct("track").alias("tracks"), *kinds)


@C.query("f_playlist_revisit", "plays", sql=_ITEMS + f""", l AS (SELECT owner, list, count(*) AS items, count(*) FILTER (kind = 'gem') AS gems, avg(sr) AS sr, max(last_day) AS last_day FROM items GROUP BY ALL),
s AS (SELECT *, round(CASE WHEN gems >= 3 AND DATE '{TODAY}' - last_day > 30 THEN 3 WHEN sr <= 0.3 AND items >= 5 THEN 2 WHEN items >= 10 THEN 1 ELSE 0 END + gems::DOUBLE / items, 6) AS score FROM l)
SELECT owner, list, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY owner ORDER BY score DESC, list) <= 6""")
def playlist_revisit(plays: DataFrame) -> DataFrame:
    """Lists worth another visit: long left with gems, hardly skipped, or long (F137)."""
    n = items(plays).groupBy("owner", "list").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("kind") == "gem").alias("gems"), F.avg("sr").alias("sr"), F.max("last_day").alias("last_day"))
    away = F.datediff(F.lit(TODAY).cast("date"), "last_day") > 30
    rule = F.when((F.col("gems") >= 3) & away, 3).when((F.col("sr") <= 0.3) & (F.col("items") >= 5), 2).when(F.col("items") >= 10, 1).otherwise(0)
    scored = n.withColumn("score", F.round(rule + F.col("gems").cast("double") / F.col("items"), 6)).filter("score > 0")
    return top_by(scored, ["owner"], 6, F.desc("score"), F.col("list")).select("owner", "list", "score")


@C.query("f_playlist_within", "plays", sql=_LISTS + " SELECT l.owner, list, count(play_id) AS plays_within, count(DISTINCT p.track) AS heard FROM lists l LEFT JOIN plays p ON p.owner = l.owner AND p.track = l.track AND p.day >= l.added AND p.attended GROUP BY ALL")
def playlist_within(plays: DataFrame) -> DataFrame:
    """The owner's plays of a list's items since they were added."""
    p = ALL.plays(plays).select("owner", "track", "day", "play_id")
    since = lists(plays).join(p, ["owner", "track"], "left").withColumn("in", F.col("day") >= F.col("added"))
    return since.groupBy("owner", "list").agg(F.count_if("in").alias("plays_within"), F.count_distinct(F.when(F.col("in"), F.col("track"))).alias("heard"))


_WILD = "w AS (SELECT * FROM stream_plays WHERE platform = 'view'), own AS (SELECT track, count(*) AS plays FROM stream_plays WHERE platform <> 'view' AND ms >= 20000 GROUP BY track)"


@C.query("f_wild_songs", "stream_plays", sql=_WILD + " SELECT w.track, count(*) AS captures, count(DISTINCT w.owner) AS places, coalesce(any_value(own.plays), 0) AS plays, CASE WHEN any_value(own.plays) IS NULL THEN 'never' ELSE 'yours' END AS lens FROM w LEFT JOIN own USING (track) GROUP BY w.track")
def wild_songs(plays: DataFrame) -> DataFrame:
    """Songs heard around, against one's own (F139)."""
    own = plays.filter("platform <> 'view' and ms >= 20000").groupBy("track").agg(F.count(F.lit(1)).alias("plays"))
    w = plays.filter("platform = 'view'").groupBy("track").agg(F.count(F.lit(1)).alias("captures"), F.count_distinct("owner").alias("places"))
    return w.join(own, "track", "left").select("track", "captures", "places", F.coalesce("plays", F.lit(0)).alias("plays"), F.when(F.col("plays").isNull(), "never").otherwise("yours").alias("lens"))


@C.query("f_wild_overview", "stream_plays", sql=_WILD + " SELECT hour(played_at)::INTEGER AS hour, isodow(played_at)::INTEGER AS isodow, count(*) AS captures, count(own.track) AS known FROM w LEFT JOIN own USING (track) GROUP BY 1, 2")
def wild_overview(plays: DataFrame) -> DataFrame:
    """When songs are heard around, and how many are known (F138)."""
    own = plays.filter("platform <> 'view' and ms >= 20000").select("track").distinct().withColumn("known", F.lit(1))
    w = plays.filter("platform = 'view'").join(own, "track", "left")
    return w.groupBy(F.hour("played_at").alias("hour"), (F.weekday("played_at") + 1).alias("isodow")).agg(F.count(F.lit(1)).alias("captures"), F.count("known").alias("known"))


@C.query("f_scenes", "plays", "artists", sql=f"""n AS (SELECT owner, scene, artist, sum(ms)::BIGINT AS ms FROM plays JOIN artists USING (artist) WHERE attended GROUP BY ALL)
SELECT owner, scene, count(*) AS artists, sum(ms) / {H} AS hours, sum(ms)::DOUBLE / sum(sum(ms)) OVER (PARTITION BY owner)::DOUBLE AS share, array_to_string(list(artist ORDER BY ms DESC, artist)[1:4], ',') AS lead FROM n GROUP BY owner, scene""")
def scenes(plays: DataFrame, artists: DataFrame) -> DataFrame:
    """Scenes with their leading artists."""
    n = ALL.plays(plays).join(artists.select("artist", "scene"), "artist").groupBy("owner", "scene", "artist").agg(F.sum("ms").alias("ms"))
    lead = F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("ms")).alias("m"), "artist"))), 1, 4), lambda x: x["artist"].cast("string")), ",")
    s = n.groupBy("owner", "scene").agg(F.count(F.lit(1)).alias("artists"), F.sum("ms").alias("ms"), lead.alias("lead"))
    return s.select("owner", "scene", "artists", hours(F.col("ms")).alias("hours"), (F.col("ms").cast("double") / F.sum("ms").over(Window.partitionBy("owner"))).alias("share"), "lead")


@C.query("f_scene_timeline", "plays", "artists", sql=f"SELECT strftime(date_trunc('week', day), '%Y-%m-%d') AS week, scene, sum(ms) / {H} AS hours FROM plays JOIN artists USING (artist) WHERE attended GROUP BY 1, 2")
def scene_timeline(plays: DataFrame, artists: DataFrame) -> DataFrame:
    return ALL.plays(plays).join(artists.select("artist", "scene"), "artist").groupBy(text(week(F.col("day"))).alias("week"), "scene").agg(hours(F.sum("ms")).alias("hours"))


@C.query("f_scene_phases", "plays", "artists", sql=f"""w AS (SELECT owner, scene, date_trunc('week', day)::DATE AS wk, sum(ms)::BIGINT AS ms FROM plays JOIN artists USING (artist) WHERE attended GROUP BY ALL), b AS (SELECT *, avg(ms) OVER (PARTITION BY owner, scene) AS usual FROM w)
SELECT owner, scene, strftime(wk, '%Y-%m-%d') AS week, ms / {H} AS hours, round(ms / usual, 6) AS times FROM b WHERE ms >= 900000 AND ms >= 3 * usual QUALIFY row_number() OVER (PARTITION BY owner, scene ORDER BY ms DESC, wk) = 1""")
def scene_phases(plays: DataFrame, artists: DataFrame) -> DataFrame:
    """Weeks in which a scene runs at three times its usual."""
    w = ALL.plays(plays).join(artists.select("artist", "scene"), "artist").groupBy("owner", "scene", week(F.col("day")).alias("wk")).agg(F.sum("ms").alias("ms"))
    b = w.withColumn("usual", F.avg("ms").over(Window.partitionBy("owner", "scene"))).filter("ms >= 900000 and ms >= 3 * usual")
    return top_by(b, ["owner", "scene"], 1, F.desc("ms"), F.col("wk")).select("owner", "scene", text(F.col("wk")).alias("week"), hours(F.col("ms")).alias("hours"), F.round(F.col("ms") / F.col("usual"), 6).alias("times"))


@C.query("f_concerts", "plays", "concerts", sql="""c AS (SELECT * FROM concerts)
SELECT c.artist, strftime(c.d, '%Y-%m-%d') AS day, count(play_id) FILTER (p.day < c.d) AS before, count(play_id) FILTER (p.day >= c.d) AS after FROM c LEFT JOIN plays p ON p.artist = c.artist AND p.day >= c.d - 30 AND p.day < c.d + 30 AND attended GROUP BY c.artist, c.d""")
def concerts(plays: DataFrame, concerts: DataFrame) -> DataFrame:
    """Plays in the month before and the month after a concert (F68): days of plays first, then equal on artist and 30-day bucket, so a long history costs no more."""
    c = concerts
    bucket = lambda d: F.floor(F.unix_date(d) / 30)
    near = c.withColumn("b", F.explode(F.sequence(bucket(F.col("d")) - 1, bucket(F.col("d")) + 1)))
    p = ALL.plays(plays).groupBy("artist", "day").agg(F.count(F.lit(1)).alias("k")).withColumn("b", bucket(F.col("day")))
    d = F.datediff("day", "d")
    held = lambda ok: F.coalesce(F.sum(F.when(ok, F.col("k"))), F.lit(0))
    n = near.join(p, ["artist", "b"], "left").groupBy("artist", "d").agg(held((d >= -30) & (d < 0)).alias("before"), held((d >= 0) & (d < 30)).alias("after"))
    return n.select("artist", text(F.col("d")).alias("day"), "before", "after")


@C.query("f_same_song_streak", "plays", sql="d AS (SELECT DISTINCT owner, track, day FROM plays WHERE attended), g AS (SELECT owner, track, day - (row_number() OVER (PARTITION BY owner, track ORDER BY day))::INTEGER AS k FROM d), r AS (SELECT owner, track, count(*) AS days FROM g GROUP BY owner, track, k) SELECT owner, arg_max(track, (days, -track)) AS track, max(days) AS days FROM r GROUP BY owner")
def same_song_streak(plays: DataFrame) -> DataFrame:
    """The song heard the most days running (F197)."""
    r = day_runs(spread(ALL.plays(plays).select("owner", "track", "day"), plays.count(), "owner", "track"), ["owner", "track"])
    return r.groupBy("owner").agg(arg_max(F.col("track"), F.col("length"), -F.col("track")).alias("track"), F.max("length").alias("days"))


@C.query("f_same_artist_run", "plays", sql="s AS (SELECT owner, played_at, play_id, artist, (coalesce(artist <> lag(artist) OVER (PARTITION BY owner ORDER BY played_at, play_id), true))::INT AS o FROM plays WHERE attended), g AS (SELECT *, sum(o) OVER (PARTITION BY owner ORDER BY played_at, play_id ROWS UNBOUNDED PRECEDING) AS k FROM s), r AS (SELECT owner, artist, count(*) AS n FROM g GROUP BY owner, artist, k) SELECT owner, max(n) AS longest, count(*) FILTER (n >= 3) AS runs_of_three FROM r GROUP BY owner")
def same_artist_run(plays: DataFrame) -> DataFrame:
    """Plays of one artist in a row (F197)."""
    w = Window.partitionBy("owner").orderBy("played_at", "play_id")
    p = ALL.plays(plays).withColumn("before", F.lag("artist").over(w))
    r = change_runs(p, ["owner"], ["played_at", "play_id"], F.col("before").isNull() | (F.col("before") != F.col("artist"))).groupBy("owner", "artist", "run").agg(F.count(F.lit(1)).alias("n"))
    return r.groupBy("owner").agg(F.max("n").alias("longest"), F.count_if(F.col("n") >= 3).alias("runs_of_three"))


@C.query("f_title_words", "plays", "tracks", sql="w AS (SELECT owner, unnest(string_split(name, ' ')) AS word FROM plays JOIN tracks USING (track) WHERE attended) SELECT owner, word, count(*) AS plays FROM w GROUP BY ALL")
def title_words(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """Words of titles by plays: counted by track first, split after (F197)."""
    n = ALL.plays(plays).groupBy("owner", "track").agg(F.count(F.lit(1)).alias("n")).join(tracks.select("track", "name"), "track")
    return n.select("owner", "n", F.explode(F.split("name", " ")).alias("word")).groupBy("owner", "word").agg(F.sum("n").alias("plays"))


@C.query("f_commute", "plays", sql="SELECT owner, arg_max(hour, (days, -hour)) AS commute_hour, max(days) AS days FROM (SELECT owner, hour, count(DISTINCT day) AS days FROM plays WHERE attended AND isodow(day) <= 5 GROUP BY ALL) GROUP BY owner")
def commute(plays: DataFrame) -> DataFrame:
    """The weekday hour with a play on most days."""
    n = ALL.plays(plays).filter(F.weekday("day") < 5).groupBy("owner", "hour").agg(F.count_distinct("day").alias("days"))
    return n.groupBy("owner").agg(arg_max(F.col("hour"), F.col("days"), -F.col("hour")).alias("commute_hour"), F.max("days").alias("days"))


@C.query("f_short_outliers", "plays", sql="d AS (SELECT track, day, count(*) AS n FROM plays WHERE ms <= 60000 GROUP BY ALL) SELECT track, sum(n)::BIGINT AS plays, max(n) AS best, strftime(arg_max(day, (n, -epoch(day))), '%Y-%m-%d') AS best_day FROM d GROUP BY track HAVING sum(n) >= 5")
def short_outliers(plays: DataFrame) -> DataFrame:
    """Short plays and the day they peak (F168)."""
    d = plays.filter("ms <= 60000").groupBy("track", "day").agg(F.count(F.lit(1)).alias("n"))
    return d.groupBy("track").agg(F.sum("n").alias("plays"), F.max("n").alias("best"), text(arg_max(F.col("day"), F.col("n"), -F.unix_date("day"))).alias("best_day")).filter("plays >= 5")


@C.query("f_origin_newcomers", "plays", "artists", sql="""y AS (SELECT owner, year(day)::INTEGER AS year, country, sum(ms) AS ms FROM plays JOIN artists USING (artist) WHERE attended GROUP BY ALL HAVING sum(ms) >= 1800000), f AS (SELECT owner, country, min(year) AS f FROM y GROUP BY ALL)
SELECT owner, year, count(*) AS countries, count(*) FILTER (f = year) AS newcomers FROM y JOIN f USING (owner, country) GROUP BY ALL""")
def origin_newcomers(plays: DataFrame, artists: DataFrame) -> DataFrame:
    """Countries of a year, and those never heard before (F147)."""
    y = ALL.plays(plays).join(artists.select("artist", "country"), "artist").groupBy("owner", F.year("day").alias("year"), "country").agg(F.sum("ms").alias("ms")).filter("ms >= 1800000")
    f = y.withColumn("f", F.min("year").over(Window.partitionBy("owner", "country")))
    return f.groupBy("owner", "year").agg(F.count(F.lit(1)).alias("countries"), F.count_if(F.col("f") == F.col("year")).alias("newcomers"))


@C.query("f_genre_library", "plays", "tracks", sql=f"SELECT owner, tag, artist, count(*) AS plays, sum(ms) / {H} AS hours FROM plays JOIN tracks USING (track) WHERE attended GROUP BY owner, tag, artist QUALIFY row_number() OVER (PARTITION BY owner, tag ORDER BY sum(ms) DESC, artist) <= 5")
def genre_library(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """A tag's artists in each library (F151)."""
    n = ALL.plays(plays).join(tracks.select("track", "tag"), "track").groupBy("owner", "tag", "artist").agg(F.count(F.lit(1)).alias("plays"), F.sum("ms").alias("ms"))
    return top_by(n, ["owner", "tag"], 5, F.desc("ms"), F.col("artist")).select("owner", "tag", "artist", "plays", hours(F.col("ms")).alias("hours"))


@C.query("f_popularity_movers", "orders", sql="s AS (SELECT o_custkey AS artist, o_orderdate::DATE AS d, max(o_totalprice) AS v FROM orders GROUP BY ALL) SELECT artist, arg_max(v, d) - arg_min(v, d) AS change, (max(d) - min(d))::INTEGER AS days FROM s GROUP BY artist HAVING max(d) - min(d) >= 7")
def popularity_movers(orders: DataFrame) -> DataFrame:
    """First and last snapshot of each (F100)."""
    s = orders.groupBy(F.col("o_custkey").alias("artist"), F.to_date("o_orderdate").alias("d")).agg(F.max("o_totalprice").alias("v"))
    a = s.groupBy("artist").agg((F.max_by("v", "d") - F.min_by("v", "d")).alias("change"), F.datediff(F.max("d"), F.min("d")).alias("days"))
    return a.filter("days >= 7")


@C.query("f_source_coverage", "plays", sql="SELECT platform, count(*) AS plays, count(*) FILTER (EXISTS (SELECT 1 FROM plays b WHERE b.owner = a.owner AND b.track = a.track AND b.platform <> a.platform AND b.day BETWEEN a.day - 60 AND a.day + 60)) AS covered FROM plays a GROUP BY platform")
def source_coverage(plays: DataFrame) -> DataFrame:
    """How many of a source's plays another source has as well, about that time (F165): the least and the greatest source of a window of days differ. No pairs are formed."""
    near = Window.partitionBy("owner", "track").orderBy(F.unix_date("day")).rangeBetween(-60, 60)
    seen = plays.select("owner", "track", "platform", "day").withColumn("other", F.min("platform").over(near) != F.max("platform").over(near))
    return seen.groupBy("platform").agg(F.count(F.lit(1)).alias("plays"), F.count_if("other").alias("covered"))



@C.query("f_activities", "plays", sql="""d AS (SELECT owner, day, count(*) AS n, min(hour) AS h, avg(skipped::INT) AS sr FROM plays WHERE attended GROUP BY ALL), a AS (SELECT owner, CASE WHEN n >= 4 AND sr <= 0.2 THEN 'focus' WHEN h >= 22 THEN 'wind-down' WHEN h BETWEEN 6 AND 9 AND isodow(day) <= 5 THEN 'commute' WHEN n >= 4 AND isodow(day) >= 6 THEN 'party' ELSE 'everyday' END AS activity, n FROM d)
SELECT owner, activity, count(*) AS days, sum(n)::BIGINT AS plays FROM a GROUP BY ALL""")
def activities(plays: DataFrame) -> DataFrame:
    """Days named by rules, the first that fits (F132)."""
    d = ALL.plays(plays).groupBy("owner", "day").agg(F.count(F.lit(1)).alias("n"), F.min("hour").alias("h"), share(F.col("skipped")).alias("sr"))
    n, h, free = F.col("n"), F.col("h"), F.weekday("day") >= 5
    activity = F.when((n >= 4) & (F.col("sr") <= 0.2), "focus").when(h >= 22, "wind-down").when(h.between(6, 9) & ~free, "commute").when((n >= 4) & free, "party").otherwise("everyday")
    return d.groupBy("owner", activity.alias("activity")).agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("plays"))


@C.query("f_missing_days", "plays", sql="d AS (SELECT DISTINCT owner, day FROM plays), o AS (SELECT owner, min(day) AS lo, max(day) AS hi FROM d GROUP BY 1), g AS (SELECT owner, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day FROM o), m AS (SELECT owner, day, day - (row_number() OVER (PARTITION BY owner ORDER BY day))::INTEGER AS k FROM g ANTI JOIN d USING (owner, day)) SELECT owner, strftime(min(day), '%Y-%m-%d') AS start, strftime(max(day), '%Y-%m-%d') AS end_day, count(*) AS days FROM m GROUP BY owner, k")
def missing_days(plays: DataFrame) -> DataFrame:
    """Ranges of days without data between a listener's first and last (F210)."""
    d = plays.select("owner", "day").distinct()
    grid = d.groupBy("owner").agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select("owner", F.explode(F.expr("sequence(lo, hi, interval 1 day)")).alias("day"))
    m = grid.join(d, ["owner", "day"], "left_anti")
    return day_runs(m, ["owner"]).select("owner", text(F.col("start")).alias("start"), text(F.col("end")).alias("end_day"), F.col("length").alias("days"))


@C.query("f_words_playlist", "plays", "tracks", sql="""u AS (SELECT artist, track, count(*) AS plays, avg(skipped::INT) AS sr FROM plays WHERE attended GROUP BY ALL), s AS (SELECT artist, track, round((bpm BETWEEN 100 AND 140)::INT * 2 + energy * 3 + (release_year >= 1980 AND release_year < 1990)::INT * 2 - sr * 2 + log10(1 + plays), 6) AS score FROM u JOIN tracks USING (track) WHERE NOT explicit AND sr <= 0.8),
a AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY artist ORDER BY score DESC, track) <= 3) SELECT artist, track, score FROM a ORDER BY score DESC, track, artist LIMIT 30""")
def words_playlist(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """A playlist from a wish (F194): hard limits, a score of several criteria, at most three of an artist."""
    u = ALL.plays(plays).groupBy("artist", "track").agg(F.count(F.lit(1)).alias("plays"), share(F.col("skipped")).alias("sr")).filter("sr <= 0.8")
    t = u.join(tracks.filter("not explicit"), "track")
    is_ = lambda c: c.cast("int")
    score = is_(F.col("bpm").between(100, 140)) * 2 + F.col("energy") * 3 + is_((F.col("release_year") >= 1980) & (F.col("release_year") < 1990)) * 2 - F.col("sr") * 2 + F.log10(1 + F.col("plays"))
    best = top_by(t.withColumn("score", F.round(score, 6)), ["artist"], 3, F.desc("score"), F.col("track"))
    return best.select("artist", "track", "score").orderBy(F.desc("score"), "track", "artist").limit(30)


@C.query("f_lineage", "tracks", sql="SELECT track AS cover, original FROM (SELECT track, release_year, first_value(track) OVER w AS original, first_value(release_year) OVER w AS year FROM tracks WINDOW w AS (PARTITION BY name, tag ORDER BY release_year, track)) WHERE release_year > year")
def lineage(tracks: DataFrame) -> DataFrame:
    """Each song with the oldest of its title, if that is older (F187)."""
    first = tracks.groupBy("name", "tag").agg(F.min(F.struct("release_year", "track")).alias("f"))
    return tracks.join(first, ["name", "tag"]).filter(F.col("release_year") > F.col("f.release_year")).select(F.col("track").alias("cover"), F.col("f.track").alias("original"))


@C.query("f_call_stats", "orders", sql="SELECT o_orderpriority AS purpose, count(*) AS calls, round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.9), 6) AS p90, max(o_totalprice) FILTER (o_orderstatus = 'F') AS worst FROM orders GROUP BY 1")
def call_stats(orders: DataFrame) -> DataFrame:
    """Quantiles by purpose (F204)."""
    q = lambda p: F.round(F.percentile("o_totalprice", F.lit(p)), 6)
    return orders.groupBy(F.col("o_orderpriority").alias("purpose")).agg(F.count(F.lit(1)).alias("calls"), q(0.5).alias("p50"), q(0.9).alias("p90"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("worst"))


@C.query("f_taste_map", "plays")
def taste_map(plays: DataFrame) -> DataFrame:
    """Years in the plane by classical scaling of their cosines (F46). The matrix has a row for each pair of years; scaling it is one small task."""
    m = ALL.plays(plays).groupBy(F.year("day").alias("y"), "artist").agg(F.sum("ms").alias("ms"))
    pairs = vectors.cosine_matrix(m.withColumn("value", F.col("ms") / F.sum("ms").over(Window.partitionBy("y"))), "y", "artist")

    def scale(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {y: i for i, y in enumerate(ids)}
        d = np.zeros((len(ids), len(ids)))
        for a, b, c in zip(pdf["a"], pdf["b"], pdf["cos"], strict=True):
            d[at[a], at[b]] = d[at[b], at[a]] = 1 - c
        centre = np.eye(len(ids)) - 1 / len(ids)
        values, axes = np.linalg.eigh(-0.5 * centre @ (d**2) @ centre)
        best = np.argsort(values)[::-1][:2]
        xy = axes[:, best] * np.sqrt(np.maximum(values[best], 0))
        xy *= np.where(xy[np.abs(xy).argmax(axis=0), range(2)] < 0, -1, 1)
        return pd.DataFrame({"year": ids, "x": xy[:, 0].round(6), "y": xy[:, 1].round(6)})

    return pairs.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(scale, "year int, x double, y double")


@C.query("f_smooth_order", "plays", "tracks")
def smooth_order(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """Each listener's ten favourites in an order of small steps in key and tempo (F214): nearest next, then swaps. One small group for each listener."""
    n = top_by(ALL.plays(plays).groupBy("owner", "track").agg(F.count(F.lit(1)).alias("n")), ["owner"], 10, F.desc("n"), F.col("track")).join(tracks.select("track", "bpm", "key_number"), "track")

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("track")
        bpm, key = np.log2(pdf["bpm"].to_numpy()), pdf["key_number"].to_numpy()
        apart = np.abs(key[:, None] - key)
        ratio_ = np.abs(bpm[:, None] - bpm)
        d = np.minimum(apart, 12 - apart) + np.minimum(ratio_ * 12, np.abs(ratio_ - 1) * 12 + 0.15)
        path, left = [0], set(range(1, len(pdf)))
        while left:
            path.append(min(left, key=lambda j: (d[path[-1], j], j)))
            left.remove(path[-1])
        cost = lambda p: sum(d[a, b] for a, b in zip(p, p[1:]))
        better = True
        while better:
            better = False
            for i in range(1, len(path) - 1):
                for j in range(i + 1, len(path)):
                    swapped = path[:i] + path[i : j + 1][::-1] + path[j + 1 :]
                    if cost(swapped) < cost(path) - 1e-9:
                        path, better = swapped, True
        return pd.DataFrame({"owner": pdf["owner"].to_numpy()[path], "track": pdf["track"].to_numpy()[path], "place": range(1, len(path) + 1)})

    return n.groupBy("owner").applyInPandas(order, "owner long, track long, place int")


@C.query("f_hygiene_ratio", "plays", sql="SELECT owner, count(*) FILTER (ms < 30000)::DOUBLE / nullif(count(*) FILTER (ms >= 30000), 0) AS short_to_long FROM plays GROUP BY owner")
def hygiene_ratio(plays: DataFrame) -> DataFrame:
    return plays.groupBy("owner").agg(ratio(F.count_if(F.col("ms") < 30_000), F.count_if(F.col("ms") >= 30_000)).alias("short_to_long"))
