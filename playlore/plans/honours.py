"""Badges beyond those of plays alone, the record's counters of confidence, weather words for a weekday, and what is due to be rebuilt.

Customers stand for playlists and for their definitions, orders for builds and for stays abroad.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlore.functions.compat import dow0
from playlore.functions.config import Lens
from playlore.operators import sessions as op
from playlore.plans import worklists as lists
from playlore.plans.base import Catalogue
from playlore.plans.sessions import _CUT, _MARKS, STREAM, _marks
from playlore.sources import adapters, ingest
from playlore.sources import worklists as work

C = Catalogue()
QUERIES, ORACLE = C.queries, C.oracle
ALL = Lens()
HOUR = 3_600_000
#: Listeners below which an artist is little known, plays of one that count, songs of a language, and tracks of a catalogue that is large enough.
FEW_LISTENERS, HEARD, SUNG, CATALOGUE = 2_000_000, 5, 5, 20

#: badge: bronze, silver, gold.
TIERS = {
    "days": (365, 1000, 2000), "early bird": (100, 500, 2000), "scene hopper": (3, 4, 5), "crate digger": (5, 15, 50), "polyglot": (2, 3, 4), "deep diver": (0.2, 0.5, 0.8), "big heart": (100, 1000, 3000), "album rider": (1, 5, 20), "globetrotter": (2, 3, 5), "architect": (5, 25, 75),
}
_LEVELS = "(VALUES " + ", ".join(f"('{k}', {a}, {b}, {c})" for k, (a, b, c) in TIERS.items()) + ") lv(badge, bronze, silver, gold)"


def values(plays: DataFrame, artists: DataFrame, liked: DataFrame, lyrics: DataFrame, stream: DataFrame, log: DataFrame, customers: DataFrame) -> dict[str, DataFrame]:
    """badge -> (owner, v)."""
    p, n = ALL.plays(plays), F.count(F.lit(1))
    of = lambda c, df: df.groupBy("owner").agg(c.cast("double").alias("v"))
    acts = p.join(artists.select("artist", "scene", "listeners"), "artist")
    small = acts.filter(F.col("listeners") < FEW_LISTENERS).groupBy("owner", "artist").agg(n.alias("n")).filter(F.col("n") >= HEARD)
    scenes = acts.groupBy("owner", "scene").agg(F.sum("ms").alias("ms")).filter(F.col("ms") >= HOUR)
    sung = p.select("owner", "track").distinct().join(lyrics.filter("lang is not null and lang <> 'und'").select("track", "lang"), "track").groupBy("owner", "lang").agg(n.alias("n")).filter(F.col("n") >= SUNG)
    known = plays.select("artist", "track").distinct().groupBy("artist").agg(n.alias("size")).filter(F.col("size") >= CATALOGUE)
    dived = p.select("owner", "artist", "track").distinct().groupBy("owner", "artist").agg(n.alias("n")).join(known, "artist")
    abroad = log.select(F.col("owner").cast("long").alias("owner"), F.from_json("payload", ingest.PAYLOAD)["country"].alias("country"))
    return {
        "days": of(F.count_distinct("day"), p),
        "early bird": of(F.count_if(F.col("hour").between(5, 7)), p),
        "scene hopper": of(n, scenes),
        "crate digger": of(n, small),
        "polyglot": of(n, sung),
        "deep diver": of(F.max(F.col("n") / F.col("size")), dived),
        "big heart": of(n, liked),
        "album rider": of(F.count_if(F.col("shape") == "album_ride"), op.build(stream, STREAM)),
        "globetrotter": of(F.count_distinct("country"), abroad),
        "architect": of(n, customers.filter("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") % adapters.OWNERS).alias("owner"))),
    }


_P = "p AS (SELECT * FROM plays WHERE attended), ac AS (SELECT * FROM p JOIN artists USING (artist))"
_VALUES = {
    "days": "SELECT owner, count(DISTINCT day)::DOUBLE AS v FROM p GROUP BY 1",
    "early bird": "SELECT owner, (count(*) FILTER (hour BETWEEN 5 AND 7))::DOUBLE FROM p GROUP BY 1",
    "scene hopper": f"SELECT owner, count(*)::DOUBLE FROM (SELECT owner, scene FROM ac GROUP BY ALL HAVING sum(ms) >= {HOUR}) GROUP BY 1",
    "crate digger": f"SELECT owner, count(*)::DOUBLE FROM (SELECT owner, artist FROM ac WHERE listeners < {FEW_LISTENERS} GROUP BY ALL HAVING count(*) >= {HEARD}) GROUP BY 1",
    "polyglot": f"SELECT owner, count(*)::DOUBLE FROM (SELECT owner, lang FROM (SELECT DISTINCT owner, track FROM p) JOIN lyrics USING (track) WHERE lang <> 'und' GROUP BY ALL HAVING count(*) >= {SUNG}) GROUP BY 1",
    "deep diver": f"SELECT owner, max(n / size)::DOUBLE FROM (SELECT owner, artist, count(DISTINCT track) AS n FROM p GROUP BY ALL) JOIN (SELECT artist, count(DISTINCT track) AS size FROM plays GROUP BY 1 HAVING count(DISTINCT track) >= {CATALOGUE}) USING (artist) GROUP BY 1",
    "big heart": "SELECT owner, count(*)::DOUBLE FROM liked GROUP BY 1",
    "album rider": "SELECT owner, (count(*) FILTER (shape = 'album_ride'))::DOUBLE FROM ses GROUP BY 1",
    "globetrotter": "SELECT owner::BIGINT, count(DISTINCT country)::DOUBLE FROM log GROUP BY 1",
    "architect": f"SELECT c_custkey % {adapters.OWNERS}, count(*)::DOUBLE FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1",
}


def tier(badge: Column, value: Column) -> Column:
    level = lambda i: F.element_at(F.create_map(*[x for k, v in TIERS.items() for x in (F.lit(k), F.lit(float(v[i])))]), badge)
    return F.when(value >= level(2), "gold").when(value >= level(1), "silver").when(value >= level(0), "bronze").otherwise("locked")


@C.query("f_more_badges", "plays", "artists", "liked", "lyrics", "stream_plays", "log", "customers", sql=f"{_CUT}, {_P}, u AS ({' UNION ALL '.join(f'''SELECT '{k}' AS badge, * FROM ({q})''' for k, q in _VALUES.items())}) SELECT owner, badge, round(v, 6) AS value, CASE WHEN v >= gold THEN 'gold' WHEN v >= silver THEN 'silver' WHEN v >= bronze THEN 'bronze' ELSE 'locked' END AS tier FROM u JOIN {_LEVELS} USING (badge)")
def more_badges(plays: DataFrame, artists: DataFrame, liked: DataFrame, lyrics: DataFrame, stream: DataFrame, log: DataFrame, customers: DataFrame) -> DataFrame:
    """Ten badges of other tables, each alone, so an empty table only locks its own."""
    every = [df.select("owner", F.lit(k).alias("badge"), F.col("v")) for k, df in values(plays, artists, liked, lyrics, stream, log, customers).items()]
    return reduce(DataFrame.unionByName, every).select("owner", "badge", F.round("v", 6).alias("value"), tier(F.col("badge"), F.col("v")).alias("tier"))


@C.query("f_confidence", "plays", "tracks", "stream_plays", "orders", "overrides", "concerts", sql=_CUT + "," + _MARKS + f""", {lists._SONGS}
SELECT 'plays' AS counter, count(*)::DOUBLE AS value FROM plays UNION ALL SELECT 'unattended share', round((count(*) FILTER (NOT attended))::DOUBLE / count(*), 6) FROM plays
UNION ALL SELECT 'stuck sessions', (count(*) FILTER (stuck))::DOUBLE FROM ses UNION ALL SELECT 'stuck hours', round(coalesce(sum(ms) FILTER (stuck), 0)::DOUBLE / {HOUR}, 6) FROM ses
UNION ALL SELECT 'overridden sessions', count(*)::DOUBLE FROM nm UNION ALL SELECT 'impossible days', count(*)::DOUBLE FROM (SELECT owner, day FROM plays GROUP BY ALL HAVING sum(ms) > 24 * {HOUR})
UNION ALL SELECT 'overrun plays', count(*)::DOUBLE FROM plays JOIN tracks USING (track) WHERE duration_ms > 0 AND ms > 1.1 * duration_ms + 2000
UNION ALL SELECT 'enriched share', round((count(*) FILTER (track IN (SELECT track FROM log_)))::DOUBLE / count(*), 6) FROM song WHERE NOT local
UNION ALL SELECT 'zone overrides', count(*)::DOUBLE FROM orders UNION ALL SELECT 'hand-made marks', count(*)::DOUBLE FROM overrides WHERE hidden UNION ALL SELECT 'captures', count(*)::DOUBLE FROM concerts""")
def confidence(plays: DataFrame, tracks: DataFrame, stream: DataFrame, orders: DataFrame, overrides: DataFrame, concerts: DataFrame) -> DataFrame:
    """Eleven counters of how clean the record is, each an aggregate of its own table (F170). Orders stand for zone overrides, marks on lyrics for merges, concerts for captures."""
    n, d = F.count(F.lit(1)), "double"
    built = op.build(stream, STREAM)
    songs = lists._songs(tracks).filter("not local").select("track")
    asked = lists._attempts(orders).select("track", F.lit(True).alias("asked")).distinct()
    counter = lambda name, df, c: df.agg(F.round(c.cast(d), 6).alias("value")).select(F.lit(name).alias("counter"), "value")
    every = [
        counter("plays", plays, n),
        counter("unattended share", plays, F.count_if(~F.col("attended")) / n),
        counter("stuck sessions", built, F.count_if("stuck")),
        counter("stuck hours", built, F.coalesce(F.sum(F.when(F.col("stuck"), F.col("ms"))), F.lit(0)) / HOUR),
        counter("overridden sessions", op.marks_of(built, _marks(orders, built)), n),
        counter("impossible days", plays.groupBy("owner", "day").agg(F.sum("ms").alias("ms")).filter(F.col("ms") > 24 * HOUR), n),
        counter("overrun plays", plays.join(tracks.filter("duration_ms > 0").select("track", "duration_ms"), "track").filter("ms > 1.1 * duration_ms + 2000"), n),
        counter("enriched share", songs.join(asked, "track", "left"), F.count_if("asked") / n),
        counter("zone overrides", orders, n),
        counter("hand-made marks", overrides.filter("hidden"), n),
        counter("captures", concerts, n),
    ]
    return reduce(DataFrame.unionByName, every)


def condition(p_any: Column, minutes: Column) -> Column:
    """Weather words for how much music is coming."""
    return F.when(p_any < 0.35, "clear").when(minutes >= 150, "downpour").when(minutes >= 75, "showers").when(minutes >= 30, "scattered").otherwise("drizzle")


@C.query("f_conditions", "plays", sql="""p AS (SELECT * FROM plays WHERE attended), r AS (SELECT owner, min(day) AS a, max(day) AS b FROM p GROUP BY 1), c AS (SELECT owner, dayofweek(d) AS weekday, count(*) AS days FROM (SELECT owner, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d FROM r) GROUP BY ALL),
h AS (SELECT owner, dayofweek(day) AS weekday, count(DISTINCT day) AS heard, sum(ms)::BIGINT AS ms FROM p GROUP BY ALL), q AS (SELECT owner, weekday, days, heard, ms, heard::DOUBLE / days AS p_any, ms::DOUBLE / (60000 * days) AS minutes FROM h JOIN c USING (owner, weekday))
SELECT owner, weekday::INTEGER AS weekday, days::BIGINT AS days, heard, round(minutes, 4) AS minutes, CASE WHEN p_any < 0.35 THEN 'clear' WHEN minutes >= 150 THEN 'downpour' WHEN minutes >= 75 THEN 'showers' WHEN minutes >= 30 THEN 'scattered' ELSE 'drizzle' END AS sky FROM q""")
def conditions(plays: DataFrame) -> DataFrame:
    """Each weekday of a listener in weather words, silent days included (F80). Days are counted by arithmetic, without a calendar."""
    p = ALL.plays(plays).withColumn("weekday", dow0("day").cast("int"))
    span = p.groupBy("owner").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    heard = p.groupBy("owner", "weekday").agg(F.count_distinct("day").alias("heard"), F.sum("ms").alias("ms")).join(span, "owner")
    ahead = F.pmod(F.col("weekday") - dow0("a"), F.lit(7))
    q = heard.withColumn("days", (F.floor((F.datediff("b", "a") - ahead) / 7) + 1).cast("long"))
    minutes = F.col("ms").cast("double") / (60_000 * F.col("days"))
    return q.select("owner", "weekday", "days", "heard", F.round(minutes, 4).alias("minutes"), condition(F.col("heard").cast("double") / F.col("days"), minutes).alias("sky"))


NOW = "2001-07-01"


@C.query("f_refresh_due", "customers", "orders", sql=f"""d AS (SELECT c_custkey AS definition, CASE WHEN c_nationkey % 2 = 0 THEN 'daily' ELSE 'weekly' END AS cadence, CASE c_mktsegment WHEN 'BUILDING' THEN 'rain' WHEN 'MACHINERY' THEN 'clear' END AS gate, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey AND o_orderdate <= TIMESTAMP '{NOW}') AS built FROM customer)
SELECT definition, cadence, gate FROM d WHERE (built IS NULL OR epoch(TIMESTAMP '{NOW}') - epoch(built) >= 3600 * CASE cadence WHEN 'daily' THEN 20 ELSE 164 END) AND (gate IS NULL OR gate = 'rain')""")
def refresh_due(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Playlists by rule that are due on a rainy day (F191)."""
    cadence = F.when(F.col("c_nationkey") % 2 == 0, "daily").otherwise("weekly")
    gate = F.when(F.col("c_mktsegment") == "BUILDING", "rain").when(F.col("c_mktsegment") == "MACHINERY", "clear")
    built = orders.filter(F.col("o_orderdate") <= F.lit(NOW).cast("timestamp_ntz")).groupBy(F.col("o_custkey").alias("definition")).agg(F.max(F.col("o_orderdate").cast("timestamp_ntz")).alias("built"))
    held = customers.select(F.col("c_custkey").alias("definition"), cadence.alias("cadence"), gate.alias("gate")).join(built, "definition", "left")
    return work.refresh_due(held, NOW, "rain").select("definition", "cadence", "gate")


@C.query("f_made_playlists", "liked", sql="""m AS (SELECT owner, strftime(added, '%Y-%m') AS month, to_json(list(track ORDER BY added, track)) AS tracks FROM liked GROUP BY ALL)
SELECT owner, month, json_array_length(tracks)::INTEGER AS tracks, (row_number() OVER (PARTITION BY owner ORDER BY month DESC))::INTEGER AS rank FROM m""")
def made_playlists(liked: DataFrame) -> DataFrame:
    """Playlists that were made, latest first, by the length of their lists of tracks (F63). A listener's likes of a month are one."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("added", "track"))), lambda x: x["track"])
    made = liked.groupBy("owner", F.date_format("added", "yyyy-MM").alias("month")).agg(F.to_json(ids).alias("tracks"))
    rank = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("month")))
    return made.select("owner", "month", F.json_array_length("tracks").alias("tracks"), rank.alias("rank"))
