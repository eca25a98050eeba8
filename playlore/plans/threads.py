"""Threads: runs of weeks in which a tag, a scene or a decade holds a share of what is heard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlore.functions.compat import hours, text, week
from playlore.functions.config import Lens
from playlore.operators.joins import top_by
from playlore.plans.base import Catalogue

C = Catalogue()
QUERIES, ORACLE = C.queries, C.oracle
ALL = Lens()
H = "3600000.0::DOUBLE"
#: Weeks of less are too thin to speak of shares; a thread needs so large a share for so many weeks.
WEEK_MS, FLOOR, WEEKS = 600_000, 0.2, 3


def week_shares(heard: DataFrame, kind: Column, least_ms: int = WEEK_MS) -> DataFrame:
    """(owner, wk, kind, ms, share) of weeks with enough in them."""
    w = heard.groupBy("owner", week(F.col("day")).alias("wk"), kind.alias("kind")).agg(F.sum("ms").alias("ms"))
    total = F.sum("ms").over(Window.partitionBy("owner", "wk"))
    return w.withColumn("total", total).filter(F.col("total") >= least_ms).select("owner", "wk", "kind", "ms", (F.col("ms").cast("double") / F.col("total")).alias("share"))


_SHARES = lambda source, kind: f"sh AS (SELECT owner, wk, kind, ms, ms::DOUBLE / total::DOUBLE AS share FROM (SELECT *, sum(ms) OVER (PARTITION BY owner, wk) AS total FROM (SELECT owner, date_trunc('week', day)::DATE AS wk, {kind} AS kind, sum(ms)::BIGINT AS ms FROM plays JOIN {source} WHERE attended GROUP BY ALL)) WHERE total >= {WEEK_MS})"
_OUT = " SELECT owner, strftime(wk, '%Y-%m-%d') AS week, kind, share FROM sh"


def _out(shares: DataFrame) -> DataFrame:
    return shares.select("owner", text(F.col("wk")).alias("week"), "kind", "share")


@C.query("f_tag_week_shares", "plays", "tracks", sql=_SHARES("tracks USING (track)", "tag") + _OUT)
def tag_week_shares(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """Each week's shares of tags."""
    return _out(week_shares(ALL.plays(plays).join(tracks.select("track", "tag"), "track"), F.col("tag")))


@C.query("f_scene_week_shares", "plays", "artists", sql=_SHARES("artists USING (artist)", "scene") + _OUT)
def scene_week_shares(plays: DataFrame, artists: DataFrame) -> DataFrame:
    """Each week's shares of scenes."""
    return _out(week_shares(ALL.plays(plays).join(artists.select("artist", "scene"), "artist"), F.col("scene")))


@C.query("f_decade_week_shares", "plays", "tracks", sql=_SHARES("tracks USING (track)", "release_year // 10 * 10") .replace("WHERE attended GROUP", "WHERE attended AND release_year < 2000 GROUP") + _OUT)
def decade_week_shares(plays: DataFrame, tracks: DataFrame, before: int = 2000) -> DataFrame:
    """Each week's shares of release decades but the current one."""
    old = tracks.filter(F.col("release_year") < before).select("track", (F.floor(F.col("release_year") / 10) * 10).cast("int").alias("decade"))
    return _out(week_shares(ALL.plays(plays).join(old, "track"), F.col("decade")))


@C.query("f_thread_labels", "scene_names", sql="SELECT scene, label FROM scene_names")
def thread_labels(scene_names: DataFrame) -> DataFrame:
    """What a thread of a scene is called (F88, F178)."""
    return scene_names.select("scene", "label")


def threads(shares: DataFrame, floor: float = FLOOR, least: int = WEEKS) -> DataFrame:
    """(owner, kind, start, until, weeks, ms, mean_share); until is the first day after."""
    run = shares.filter(F.col("share") >= floor).withColumn("g", F.date_sub("wk", (7 * F.row_number().over(Window.partitionBy("owner", "kind").orderBy("wk"))).cast("int")))
    held = run.groupBy("owner", "kind", "g").agg(F.min("wk").alias("start"), F.date_add(F.max("wk"), 7).alias("until"), F.count(F.lit(1)).alias("weeks"), F.sum("ms").alias("ms"), F.round(F.avg("share"), 6).alias("mean_share"))
    return held.filter(F.col("weeks") >= least).drop("g")


_THREADS = f"""th AS (SELECT owner, kind, min(wk) AS start, max(wk) + 7 AS until, count(*) AS weeks, sum(ms)::BIGINT AS ms, round(avg(share), 6) AS mean_share FROM (SELECT *, wk - 7 * (row_number() OVER (PARTITION BY owner, kind ORDER BY wk))::INTEGER AS g FROM sh WHERE share >= {FLOOR}) GROUP BY owner, kind, g HAVING count(*) >= {WEEKS})"""
_TAGS = _SHARES("tracks USING (track)", "tag") + ", " + _THREADS


@C.query("f_genre_threads", "plays", "tracks", sql=_TAGS + f""", r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY start DESC, kind) AS recent, row_number() OVER (PARTITION BY owner, year(start) ORDER BY ms DESC, kind, start) AS of_year, row_number() OVER (PARTITION BY owner ORDER BY ms DESC, kind, start) AS by_hours FROM th)
SELECT owner, kind AS tag, strftime(start, '%Y-%m-%d') AS start, weeks, ms / {H} AS hours, mean_share, CASE WHEN recent <= 4 THEN 'recent' WHEN of_year = 1 THEN 'year' ELSE 'hours' END AS why FROM r WHERE recent <= 4 OR of_year = 1 OR by_hours <= 6""")
def genre_threads(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """The threads to show (F91): the latest, the strongest that began in each year, and those of the most hours."""
    th = threads(week_shares(ALL.plays(plays).join(tracks.select("track", "tag"), "track"), F.col("tag")))
    at = lambda *keys, order: F.row_number().over(Window.partitionBy("owner", *keys).orderBy(*order))
    strongest = (F.desc("ms"), "kind", "start")
    r = th.withColumns({"recent": at(order=(F.desc("start"), "kind")), "of_year": at(F.year("start"), order=strongest), "by_hours": at(order=strongest)}).filter("recent <= 4 or of_year = 1 or by_hours <= 6")
    why = F.when(F.col("recent") <= 4, "recent").when(F.col("of_year") == 1, "year").otherwise("hours")
    return r.select("owner", F.col("kind").alias("tag"), text(F.col("start")).alias("start"), "weeks", hours(F.col("ms")).alias("hours"), "mean_share", why.alias("why"))


def within(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """Plays of a thread's tag within it: equal on owner and tag, which have few threads, and then by day."""
    heard = ALL.plays(plays).join(tracks.select("track", F.col("tag").alias("kind")), "track")
    th = threads(week_shares(heard, F.col("kind"))).select("owner", "kind", "start", "until")
    return heard.join(th, ["owner", "kind"]).filter((F.col("day") >= F.col("start")) & (F.col("day") < F.col("until")))


_WITHIN = _TAGS + ", w AS (SELECT p.owner, tag, start, artist, p.track, ms FROM (SELECT * FROM plays JOIN tracks USING (track) WHERE attended) p JOIN (SELECT owner, kind, start, until FROM th) t ON t.owner = p.owner AND t.kind = p.tag AND p.day >= start AND p.day < until)"


@C.query("f_thread_artists", "plays", "tracks", sql=_WITHIN + f" SELECT owner, tag, strftime(start, '%Y-%m-%d') AS start, artist, sum(ms) / {H} AS hours FROM w GROUP BY owner, tag, w.start, artist QUALIFY row_number() OVER (PARTITION BY owner, tag, w.start ORDER BY sum(ms) DESC, artist) <= 3")
def thread_artists(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """The three artists most heard in each thread."""
    n = within(plays, tracks).groupBy("owner", "kind", "start", "artist").agg(F.sum("ms").alias("ms"))
    return top_by(n, ["owner", "kind", "start"], 3, F.desc("ms"), F.col("artist")).select("owner", F.col("kind").alias("tag"), text(F.col("start")).alias("start"), "artist", hours(F.col("ms")).alias("hours"))


@C.query("f_thread_tracks", "plays", "tracks", sql=_WITHIN + " SELECT owner, tag, strftime(start, '%Y-%m-%d') AS start, track, count(*) AS plays FROM w GROUP BY owner, tag, w.start, track QUALIFY row_number() OVER (PARTITION BY owner, tag, w.start ORDER BY count(*) DESC, sum(ms) DESC, track) <= 30")
def thread_tracks(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """The songs of each thread."""
    n = within(plays, tracks).groupBy("owner", "kind", "start", "track").agg(F.count(F.lit(1)).alias("plays"), F.sum("ms").alias("ms"))
    return top_by(n, ["owner", "kind", "start"], 30, F.desc("plays"), F.desc("ms"), F.col("track")).select("owner", F.col("kind").alias("tag"), text(F.col("start")).alias("start"), "track", "plays")
