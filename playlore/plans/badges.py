"""Badges with tiers, and yearly awards with a runner-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlore.functions.config import Lens
from playlore.operators.islands import day_runs
from playlore.operators.joins import top_by
from playlore.plans.base import Catalogue

C = Catalogue()
QUERIES, ORACLE = C.queries, C.oracle
ALL = Lens()

#: badge: bronze, silver, gold.
TIERS = {
    "hours": (10, 100, 1000), "artists": (50, 100, 500), "songs": (500, 1500, 5000), "favourite": (10, 25, 100), "marathon": (60, 180, 480), "streak": (7, 14, 30), "explorer": (20, 50, 100), "night": (50, 200, 1000),
    "countries": (5, 15, 25), "decades": (3, 4, 5), "keys": (12, 20, 24), "tempo range": (60, 100, 120), "reunion": (180, 365, 730), "new year": (1, 5, 20), "loyalist": (2, 3, 5), "quiet listener": (10, 50, 100), "albums": (10, 20, 25), "full album": (10, 30, 60),
}


def _tier(badge: Column, value: Column) -> Column:
    levels = F.create_map(*[x for k, v in TIERS.items() for x in (F.lit(k), F.array(*map(F.lit, map(float, v))))])
    at = F.element_at(levels, badge)
    return F.when(value >= F.get(at, F.lit(2)), "gold").when(value >= F.get(at, F.lit(1)), "silver").when(value >= F.get(at, F.lit(0)), "bronze").otherwise("locked")


_LEVELS = "(VALUES " + ", ".join(f"('{k}', {a}, {b}, {c})" for k, (a, b, c) in TIERS.items()) + ") lv(badge, bronze, silver, gold)"
_P = "p AS (SELECT * FROM plays WHERE attended), j AS (SELECT * FROM p JOIN tracks USING (track))"
_BADGES = {
    "hours": "SELECT owner, sum(ms) / 3600000.0::DOUBLE AS v FROM p GROUP BY 1",
    "artists": "SELECT owner, count(DISTINCT artist)::DOUBLE FROM p GROUP BY 1",
    "songs": "SELECT owner, count(DISTINCT track)::DOUBLE FROM p GROUP BY 1",
    "favourite": "SELECT owner, max(n)::DOUBLE FROM (SELECT owner, track, count(*) AS n FROM p GROUP BY ALL) GROUP BY 1",
    "marathon": "SELECT owner, max(ms) / 60000.0::DOUBLE FROM (SELECT owner, day, sum(ms) AS ms FROM p GROUP BY ALL) GROUP BY 1",
    "streak": "SELECT owner, max(n)::DOUBLE FROM (SELECT owner, k, count(*) AS n FROM (SELECT owner, day - (row_number() OVER (PARTITION BY owner ORDER BY day))::INTEGER AS k FROM (SELECT DISTINCT owner, day FROM p)) GROUP BY ALL) GROUP BY 1",
    "explorer": "SELECT owner, max(n)::DOUBLE FROM (SELECT owner, date_trunc('month', d) AS m, count(*) AS n FROM (SELECT owner, artist, min(day) AS d FROM p GROUP BY ALL) GROUP BY ALL) GROUP BY 1",
    "night": "SELECT owner, (count(*) FILTER (hour < 5))::DOUBLE FROM p GROUP BY 1",
    "countries": "SELECT owner, count(DISTINCT country)::DOUBLE FROM p JOIN artists USING (artist) GROUP BY 1",
    "decades": "SELECT owner, count(DISTINCT release_year // 10)::DOUBLE FROM j GROUP BY 1",
    "keys": "SELECT owner, count(DISTINCT (key_number, key_mode))::DOUBLE FROM j GROUP BY 1",
    "tempo range": "SELECT owner, round(max(bpm) - min(bpm), 3) FROM j GROUP BY 1",
    "reunion": "SELECT owner, max(gap)::DOUBLE FROM (SELECT owner, day - lag(day) OVER (PARTITION BY owner, artist ORDER BY day) AS gap FROM (SELECT DISTINCT owner, artist, day FROM p)) GROUP BY 1",
    "new year": "SELECT owner, (count(*) FILTER (month(day) = 1 AND dayofmonth(day) = 1))::DOUBLE FROM p GROUP BY 1",
    "loyalist": "SELECT owner, max(n)::DOUBLE FROM (SELECT owner, artist, k, count(*) AS n FROM (SELECT owner, artist, y - row_number() OVER (PARTITION BY owner, artist ORDER BY y) AS k FROM (SELECT owner, year(day) AS y, artist FROM p GROUP BY owner, year(day), artist QUALIFY row_number() OVER (PARTITION BY owner, year(day) ORDER BY sum(ms) DESC, artist) = 1)) GROUP BY ALL) GROUP BY 1",
    "quiet listener": "SELECT owner, (count(*) FILTER (loudness < -25))::DOUBLE FROM j GROUP BY 1",
    "albums": "SELECT owner, count(DISTINCT album)::DOUBLE FROM j GROUP BY 1",
    "full album": "SELECT owner, max(n)::DOUBLE FROM (SELECT owner, album, count(DISTINCT track) AS n FROM j GROUP BY ALL) GROUP BY 1",
}


def values(plays: DataFrame, tracks: DataFrame, artists: DataFrame) -> dict[str, DataFrame]:
    """badge -> (owner, v)."""
    p = ALL.plays(plays)
    j = p.join(tracks.select("track", "album", "release_year", "key_number", "key_mode", "bpm", "loudness"), "track")
    n = F.count(F.lit(1))
    most = lambda df, c="n": df.groupBy("owner").agg(F.max(c).cast("double").alias("v"))
    of = lambda c, df=p: df.groupBy("owner").agg(c.cast("double").alias("v"))
    firsts = p.groupBy("owner", "artist").agg(F.min("day").alias("d"))
    days = p.select("owner", "artist", "day").distinct()
    heads = top_by(p.groupBy("owner", F.year("day").alias("y"), "artist").agg(F.sum("ms").alias("ms")), ["owner", "y"], 1, F.desc("ms"), F.col("artist"))
    years = heads.withColumn("k", F.col("y") - F.row_number().over(Window.partitionBy("owner", "artist").orderBy("y")))
    return {
        "hours": of(F.sum("ms").cast("double") / 3600000.0),
        "artists": of(F.count_distinct("artist")),
        "songs": of(F.count_distinct("track")),
        "favourite": most(p.groupBy("owner", "track").agg(n.alias("n"))),
        "marathon": most(p.groupBy("owner", "day").agg((F.sum("ms").cast("double") / 60000.0).alias("n"))),
        "streak": most(day_runs(p, ["owner"]), "length"),
        "explorer": most(firsts.groupBy("owner", F.trunc("d", "month").alias("m")).agg(n.alias("n"))),
        "night": of(F.count_if(F.col("hour") < 5)),
        "countries": of(F.count_distinct("country"), p.join(artists.select("artist", "country"), "artist")),
        "decades": of(F.count_distinct(F.floor(F.col("release_year") / 10)), j),
        "keys": of(F.count_distinct("key_number", "key_mode"), j),
        "tempo range": of(F.round(F.max("bpm") - F.min("bpm"), 3), j),
        "reunion": most(days.withColumn("n", F.datediff("day", F.lag("day").over(Window.partitionBy("owner", "artist").orderBy("day"))))),
        "new year": of(F.count_if((F.month("day") == 1) & (F.dayofmonth("day") == 1))),
        "loyalist": most(years.groupBy("owner", "artist", "k").agg(n.alias("n"))),
        "quiet listener": of(F.count_if(F.col("loudness") < -25), j),
        "albums": of(F.count_distinct("album"), j),
        "full album": most(j.groupBy("owner", "album").agg(F.count_distinct("track").alias("n"))),
    }


@C.query("f_badges", "plays", "tracks", "artists", sql=f"{_P}, u AS ({' UNION ALL '.join(f'''SELECT '{k}' AS badge, * FROM ({q})''' for k, q in _BADGES.items())}) SELECT owner, badge, v AS value, CASE WHEN v >= gold THEN 'gold' WHEN v >= silver THEN 'silver' WHEN v >= bronze THEN 'bronze' ELSE 'locked' END AS tier FROM u JOIN {_LEVELS} USING (badge)")
def badges(plays: DataFrame, tracks: DataFrame, artists: DataFrame) -> DataFrame:
    """Every badge of every listener, with its tier (F41, F42). Each stands alone, so an empty table only locks its own."""
    every = [df.select("owner", F.lit(k).alias("badge"), F.col("v").alias("value")) for k, df in values(plays, tracks, artists).items()]
    return reduce(DataFrame.unionByName, every).withColumn("tier", F.coalesce(_tier(F.col("badge"), F.col("value")), F.lit("locked")))


#: award: what wins, and the SQL of (owner, y, who, v).
_A = "p AS (SELECT *, year(day)::INTEGER AS y FROM plays WHERE attended), j AS (SELECT * FROM p JOIN tracks USING (track)), f AS (SELECT owner, artist, min(year(day)) AS y0 FROM plays WHERE attended GROUP BY ALL), gd AS (SELECT owner, artist, day, day - lag(day) OVER (PARTITION BY owner, artist ORDER BY day) AS gap FROM (SELECT DISTINCT owner, artist, day FROM p))"
_AWARDS = {
    "most played song": "SELECT owner, y, track AS who, count(*)::DOUBLE AS v FROM p GROUP BY ALL",
    "most skipped song": "SELECT owner, y, track, count(*)::DOUBLE FROM p WHERE skipped GROUP BY ALL",
    "artist of the year": "SELECT owner, y, artist, sum(ms) / 3600000.0::DOUBLE FROM p GROUP BY ALL",
    "newcomer": "SELECT owner, y, artist, sum(ms) / 3600000.0::DOUBLE FROM p JOIN f USING (owner, artist) WHERE y = y0 GROUP BY ALL",
    "comeback": "SELECT owner, year(day)::INTEGER, artist, max(gap)::DOUBLE FROM gd WHERE gap >= 120 GROUP BY ALL",
    "quiet obsession": "SELECT owner, y, track, count(*)::DOUBLE / count(DISTINCT day) FROM p GROUP BY ALL HAVING count(*) >= 3",
    "longest listen": "SELECT owner, y, track, max(ms) / 60000.0::DOUBLE FROM p GROUP BY ALL",
    "obsessive day": "SELECT owner, y, track, max(n)::DOUBLE FROM (SELECT owner, y, day, track, count(*) AS n FROM p GROUP BY ALL) GROUP BY ALL",
    "night companion": "SELECT owner, y, artist, count(*)::DOUBLE FROM p WHERE hour < 5 GROUP BY ALL",
    "supporting artist": "SELECT owner, y, artist, count(DISTINCT day)::DOUBLE FROM p GROUP BY ALL",
    "deep cuts": "SELECT owner, y, artist, count(DISTINCT track)::DOUBLE FROM p GROUP BY ALL",
    "tag of the year": "SELECT owner, y, 0::BIGINT, count(DISTINCT tag)::DOUBLE FROM j GROUP BY ALL",
}


def candidates(plays: DataFrame, tracks: DataFrame) -> dict[str, DataFrame]:
    """award -> (owner, y, who, v)."""
    p = ALL.plays(plays).withColumn("y", F.year("day"))
    by = lambda key, v, df=p: df.groupBy("owner", "y", F.col(key).alias("who")).agg(v.cast("double").alias("v"))
    n, h = F.count(F.lit(1)), F.sum("ms").cast("double") / 3600000.0
    first = p.groupBy("owner", "artist").agg(F.min("y").alias("y0"))
    days = p.select("owner", "artist", "day", "y").distinct()
    gaps = days.withColumn("gap", F.datediff("day", F.lag("day").over(Window.partitionBy("owner", "artist").orderBy("day")))).filter("gap >= 120")
    a_day = p.groupBy("owner", "y", "day", "track").agg(n.alias("n"))
    return {
        "most played song": by("track", n),
        "most skipped song": by("track", n, p.filter("skipped")),
        "artist of the year": by("artist", h),
        "newcomer": by("artist", h, p.join(first, ["owner", "artist"]).filter("y = y0")),
        "comeback": by("artist", F.max("gap"), gaps),
        "quiet obsession": p.groupBy("owner", "y", F.col("track").alias("who")).agg(n.alias("n"), (n.cast("double") / F.count_distinct("day")).alias("v")).filter("n >= 3").drop("n"),
        "longest listen": by("track", F.max("ms").cast("double") / 60000.0),
        "obsessive day": by("track", F.max("n"), a_day),
        "night companion": by("artist", n, p.filter("hour < 5")),
        "supporting artist": by("artist", F.count_distinct("day")),
        "deep cuts": by("artist", F.count_distinct("track")),
        "tag of the year": p.join(tracks.select("track", "tag"), "track").groupBy("owner", "y").agg(F.count_distinct("tag").cast("double").alias("v")).withColumn("who", F.lit(0).cast("long")).select("owner", "y", "who", "v"),
    }


@C.query("f_year_awards", "plays", "tracks", sql=f"{_A}, u AS ({' UNION ALL '.join(f'''SELECT '{k}' AS award, * FROM ({q})''' for k, q in _AWARDS.items())}) SELECT owner, y AS year, award, who, v AS value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY owner, y, award ORDER BY round(v, 9) DESC, who) AS rank FROM u) WHERE rank <= 2")
def year_awards(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """Twelve awards of every year, each with its runner-up (F161)."""
    every = [df.select("owner", "y", F.lit(k).alias("award"), "who", "v") for k, df in candidates(plays, tracks).items()]
    best = [top_by(df, ["owner", "y"], 2, F.round("v", 9).desc(), F.col("who")) for df in every]
    return reduce(DataFrame.unionByName, best).select("owner", F.col("y").alias("year"), "award", "who", F.col("v").alias("value"), "rank")
