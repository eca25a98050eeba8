"""Receipts of habits, playlists by rules, named eras and searches that forgive."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlore.functions.compat import ratio, text
from playlore.functions.config import Lens
from playlore.operators.islands import day_runs
from playlore.operators.joins import top_by
from playlore.plans import insights
from playlore.plans.base import Catalogue

C = Catalogue()
QUERIES, ORACLE = C.queries, C.oracle
ALL = Lens()
TODAY = "2001-06-01"

#: rule: the SQL of (owner, subject, value) and the weight of a unit of value.
_P = "p AS (SELECT * FROM plays WHERE attended), j AS (SELECT * FROM p JOIN tracks USING (track))"
_RULES = {
    "skips an artist they keep playing": (2.0, "SELECT owner, artist::VARCHAR AS subject, (count(*) FILTER (skipped))::DOUBLE / count(*) AS value FROM p GROUP BY owner, artist HAVING count(*) >= 5"),
    "days running with one song": (0.2, "SELECT owner, track::VARCHAR, count(*)::DOUBLE FROM (SELECT owner, track, day - (row_number() OVER (PARTITION BY owner, track ORDER BY day))::INTEGER AS k FROM (SELECT DISTINCT owner, track, day FROM p)) GROUP BY owner, track, k"),
    "plays of one song in a day": (0.3, "SELECT owner, track::VARCHAR, count(*)::DOUBLE FROM p GROUP BY owner, track, day"),
    "up at night": (1.5, "SELECT owner, 'night', (count(*) FILTER (hour < 5))::DOUBLE / count(*) FROM p GROUP BY owner"),
    "one tag for everything": (1.2, "SELECT owner, tag, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY owner) FROM j GROUP BY owner, tag"),
    "lives in one decade": (1.1, "SELECT owner, (release_year // 10 * 10)::VARCHAR, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY owner) FROM j GROUP BY owner, release_year // 10"),
    "hears albums by one song": (1.0, "SELECT owner, album, max(n)::DOUBLE / sum(n) FROM (SELECT owner, album, track, count(*) AS n FROM j GROUP BY ALL) GROUP BY owner, album HAVING sum(n) >= 10"),
    "away for days": (0.002, "SELECT owner, artist::VARCHAR, max(gap)::DOUBLE FROM (SELECT owner, artist, day - lag(day) OVER (PARTITION BY owner, artist ORDER BY day) AS gap FROM (SELECT DISTINCT owner, artist, day FROM p)) WHERE gap IS NOT NULL GROUP BY owner, artist"),
}


def evidence(plays: DataFrame, tracks: DataFrame) -> dict[str, DataFrame]:
    """rule -> (owner, subject, value)."""
    p = ALL.plays(plays)
    j = p.join(tracks.select("track", "tag", "album", "release_year"), "track")
    n = F.count(F.lit(1))
    s = lambda c: c.cast("string").alias("subject")
    part = lambda df, key: df.groupBy("owner", key.alias("k")).agg(n.alias("n")).select("owner", s(F.col("k")), ratio(F.col("n"), F.sum("n").over(Window.partitionBy("owner"))).alias("value"))
    by_song = j.groupBy("owner", "album", "track").agg(n.alias("n")).groupBy("owner", "album").agg(F.max("n").alias("m"), F.sum("n").alias("n")).filter("n >= 10")
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy("owner", "artist").orderBy("day")))
    return {
        "skips an artist they keep playing": p.groupBy("owner", "artist").agg(F.count_if("skipped").alias("k"), n.alias("n")).filter("n >= 5").select("owner", s(F.col("artist")), ratio(F.col("k"), F.col("n")).alias("value")),
        "days running with one song": day_runs(p, ["owner", "track"]).select("owner", s(F.col("track")), F.col("length").cast("double").alias("value")),
        "plays of one song in a day": p.groupBy("owner", "track", "day").agg(n.cast("double").alias("value")).select("owner", s(F.col("track")), "value"),
        "up at night": p.groupBy("owner").agg(ratio(F.count_if(F.col("hour") < 5), n).alias("value")).select("owner", F.lit("night").alias("subject"), "value"),
        "one tag for everything": part(j, F.col("tag")),
        "lives in one decade": part(j, (F.floor(F.col("release_year") / 10) * 10).cast("int")),
        "hears albums by one song": by_song.select("owner", s(F.col("album")), ratio(F.col("m"), F.col("n")).alias("value")),
        "away for days": p.select("owner", "artist", "day").distinct().withColumn("gap", gap).filter("gap is not null").groupBy("owner", "artist").agg(F.max("gap").cast("double").alias("value")).select("owner", s(F.col("artist")), "value"),
    }


@C.query("f_receipts", "plays", "tracks", sql=f"{_P}, u AS ({' UNION ALL '.join(f'''SELECT '{k}' AS rule, {w}::DOUBLE AS w, * FROM ({q})''' for k, (w, q) in _RULES.items())}), one AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY owner, rule ORDER BY round(value, 9) DESC, subject) = 1) SELECT owner, rule, subject, value, round(w * value, 6) AS score FROM one QUALIFY row_number() OVER (PARTITION BY owner ORDER BY round(w * value, 6) DESC, rule) <= 5")
def receipts(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """The strongest evidence of each listener's habits (F196, F197): the best of each rule, then the best rules."""
    every = [top_by(df, ["owner"], 1, F.round("value", 9).desc(), F.col("subject")).select("owner", F.lit(k).alias("rule"), "subject", "value", F.round(F.lit(_RULES[k][0]) * F.col("value"), 6).alias("score")) for k, df in evidence(plays, tracks).items()]
    return top_by(reduce(DataFrame.unionByName, every), ["owner"], 5, F.desc("score"), F.col("rule")).drop("rank")


#: Playlists by rules, as they are kept.
DEFINITIONS = ('{"name": "on repeat", "rule": "rotation", "size": 10}', '{"name": "long unheard", "rule": "rediscover", "size": 8}', '{"name": "running", "rule": "tempo", "size": 6}', '{"name": "broken", "rule": ')
_USE = f"u AS (SELECT owner, track, count(*) AS n, count(*) FILTER (day > DATE '{TODAY}' - 120) AS late, max(day) AS last_day FROM plays WHERE attended AND day <= DATE '{TODAY}' GROUP BY ALL)"
_DAILY = f"md5(owner || ':' || track || ':{TODAY}')"
_RULE = lambda rule, where, order, size, name: f"SELECT owner, '{name}' AS playlist, track FROM (SELECT owner, track, {order} AS o FROM u JOIN tracks USING (track) WHERE {where}) QUALIFY row_number() OVER (PARTITION BY owner ORDER BY o DESC, track) <= {size}"


@C.query("f_dynamic_playlists", "plays", "tracks", sql=f"""{_USE}, l AS ({_RULE('rotation', 'late > 0', 'late', 10, 'on repeat')} UNION ALL {_RULE('rediscover', f"n >= 2 AND last_day < DATE '{TODAY}' - 180", 'n', 8, 'long unheard')} UNION ALL {_RULE('tempo', 'bpm BETWEEN 150 AND 180', 'n', 6, 'running')})
SELECT owner, playlist, track, (row_number() OVER (PARTITION BY owner, playlist ORDER BY {_DAILY}, track))::INTEGER AS position FROM l""")
def dynamic_playlists(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """Playlists from their kept definitions (F188-F190): parsed, dispatched by rule, and shuffled anew each day. What doesn't parse gives no list."""
    spark, today = plays.sparkSession, F.lit(TODAY).cast("date")
    kept = spark.createDataFrame([(d,) for d in DEFINITIONS], "body string").select(F.from_json("body", "name string, rule string, size int").alias("d")).filter("d.rule is not null").select("d.*").collect()  # a handful of a listener's own
    late = F.count_if(F.col("day") > F.date_sub(today, 120))
    u = ALL.plays(plays).filter(F.col("day") <= today).groupBy("owner", "track").agg(F.count(F.lit(1)).alias("n"), late.alias("late"), F.max("day").alias("last_day")).join(tracks.select("track", "bpm"), "track")
    rules = {
        "rotation": (F.col("late") > 0, F.desc("late")),
        "rediscover": ((F.col("n") >= 2) & (F.col("last_day") < F.date_sub(today, 180)), F.desc("n")),
        "tempo": (F.col("bpm").between(150, 180), F.desc("n")),
    }
    lists = [top_by(u.filter(rules[k.rule][0]), ["owner"], k.size, rules[k.rule][1], F.col("track")).select("owner", F.lit(k.name).alias("playlist"), "track") for k in kept]
    daily = F.md5(F.concat_ws(":", F.col("owner").cast("string"), F.col("track").cast("string"), F.lit(TODAY)))
    return reduce(DataFrame.unionByName, lists).withColumn("position", F.row_number().over(Window.partitionBy("owner", "playlist").orderBy(daily, "track")))


@C.query("f_era_names", "plays", sql=f"SELECT owner, era, CASE WHEN late_share >= 0.25 THEN 'the night' WHEN skip_rate >= 0.4 THEN 'the restless' WHEN weeks >= 20 THEN 'the long' ELSE 'the quiet' END || ' ' || ['winter', 'spring', 'summer', 'autumn'][(month(start::DATE) % 12) // 3 + 1] || ' of ' || year(start::DATE) AS title FROM ({insights.ORACLE['f_eras']})")
def era_names(plays: DataFrame) -> DataFrame:
    """A title for each era, from how and when it was."""
    e = insights.eras(plays).withColumn("d", F.to_date("start"))
    how = F.when(F.col("late_share") >= 0.25, "the night").when(F.col("skip_rate") >= 0.4, "the restless").when(F.col("weeks") >= 20, "the long").otherwise("the quiet")
    season = F.element_at(F.array(*map(F.lit, ("winter", "spring", "summer", "autumn"))), (F.floor(F.month("d") % 12 / 3) + 1).cast("int"))
    return e.select("owner", "era", F.concat_ws(" ", how, season, F.lit("of"), F.year("d").cast("string")).alias("title"))


@C.query("f_earworm_feedback", "plays", "overrides", sql=f"SELECT owner, e.track, score, coalesce(o.valence IS NOT NULL, false) AS confirmed FROM ({insights.ORACLE['f_earworms']}) e LEFT JOIN overrides o ON o.track = e.track WHERE NOT coalesce(o.hidden, false) QUALIFY row_number() OVER (PARTITION BY owner ORDER BY score DESC, e.track) <= 40")
def earworm_feedback(plays: DataFrame, overrides: DataFrame) -> DataFrame:
    """Songs that keep coming back, with the listener's verdict; dismissed ones are hidden."""
    o = overrides.select("track", "hidden", F.col("valence").isNotNull().alias("confirmed"))
    e = insights.earworms(plays).join(o, "track", "left").filter(~F.coalesce("hidden", F.lit(False)))
    return top_by(e, ["owner"], 40, F.desc("score"), F.col("track")).select("owner", "track", "score", F.coalesce("confirmed", F.lit(False)).alias("confirmed"))


_FUZZY = "r.*?i.*?n"


@C.query("f_fuzzy", "tracks", "artists", sql=f"n AS (SELECT 'song' AS kind, track AS id, lower(name) AS name FROM tracks UNION ALL SELECT 'artist', artist, lower(artist_name) FROM artists), s AS (SELECT *, regexp_extract(name, '{_FUZZY}') AS hit FROM n) SELECT kind, id, round(3.0::DOUBLE / length(hit) + CASE WHEN starts_with(name, hit) THEN 0.5 ELSE 0 END - 0.01 * length(name), 6) AS score FROM s WHERE hit <> ''")
def fuzzy(tracks: DataFrame, artists: DataFrame, letters: str = "rin") -> DataFrame:
    """Names that have some letters in order (F216): the closer together, the nearer the front and the shorter the name, the better."""
    names = tracks.select(F.lit("song").alias("kind"), F.col("track").alias("id"), F.lower("name").alias("name")).unionByName(artists.select(F.lit("artist").alias("kind"), F.col("artist").alias("id"), F.lower("artist_name").alias("name")))
    s = names.withColumn("hit", F.regexp_extract("name", ".*?".join(letters), 0)).filter("hit <> ''")
    score = F.lit(3.0) / F.length("hit") + F.when(F.startswith("name", F.col("hit")), 0.5).otherwise(0.0) - 0.01 * F.length("name")
    return s.select("kind", "id", F.round(score, 6).alias("score"))


@C.query("f_seasons", "plays", sql="SELECT owner, strftime(date_trunc('quarter', day + INTERVAL 1 MONTH)::DATE - INTERVAL 1 MONTH, '%Y-%m-%d') AS start, ['winter', 'spring', 'summer', 'autumn'][(month(day) % 12) // 3 + 1] AS season, count(*) AS plays, count(DISTINCT artist) AS artists FROM plays WHERE attended GROUP BY ALL")
def seasons(plays: DataFrame) -> DataFrame:
    """Plays by season, each from its first day (F153)."""
    start = F.add_months(F.trunc(F.add_months("day", 1), "quarter"), -1)
    name = F.element_at(F.array(*map(F.lit, ("winter", "spring", "summer", "autumn"))), (F.floor(F.month("day") % 12 / 3) + 1).cast("int"))
    return ALL.plays(plays).groupBy("owner", text(start).alias("start"), name.alias("season")).agg(F.count(F.lit(1)).alias("plays"), F.count_distinct("artist").alias("artists"))


@C.query("f_weather_ahead", "plays", sql=f"""d AS (SELECT owner, day, CASE WHEN abs(dayofyear(day) - 183) < 60 THEN 'sun' WHEN dayofyear(day) % 3 = 0 THEN 'rain' ELSE 'cloud' END AS sky, sum(ms)::BIGINT AS ms FROM plays WHERE attended AND day < DATE '{TODAY}' GROUP BY ALL),
s AS (SELECT owner, sky, sum(ms)::DOUBLE / count(*) AS of_sky FROM d GROUP BY ALL), o AS (SELECT owner, sum(ms)::DOUBLE / count(*) AS usual FROM d GROUP BY 1), g AS (SELECT owner, usual, unnest(generate_series(DATE '{TODAY}', DATE '{TODAY}' + 6, INTERVAL 1 DAY))::DATE AS day FROM o),
w AS (SELECT *, CASE WHEN abs(dayofyear(day) - 183) < 60 THEN 'sun' WHEN dayofyear(day) % 3 = 0 THEN 'rain' ELSE 'cloud' END AS sky FROM g) SELECT w.owner, strftime(day, '%Y-%m-%d') AS day, w.sky, round(least(1.5, greatest(0.7, coalesce(of_sky / usual, 1))), 6) AS factor FROM w LEFT JOIN s ON s.owner = w.owner AND s.sky = w.sky""")
def weather_ahead(plays: DataFrame) -> DataFrame:
    """The week's skies and how much more or less is heard under them, between 0.7 and 1.5 (F143)."""
    today, n = F.lit(TODAY).cast("date"), F.dayofyear("day")
    sky = F.when(F.abs(n - 183) < 60, "sun").when(n % 3 == 0, "rain").otherwise("cloud")
    d = ALL.plays(plays).filter(F.col("day") < today).groupBy("owner", "day").agg(F.sum("ms").alias("ms")).withColumn("sky", sky)
    mean = lambda name: (F.sum("ms").cast("double") / F.count(F.lit(1))).alias(name)
    ahead = d.groupBy("owner").agg(mean("usual")).withColumn("day", F.explode(F.sequence(today, F.date_add(today, 6)))).withColumn("sky", sky)
    factor = F.least(F.lit(1.5), F.greatest(F.lit(0.7), F.coalesce(F.col("of_sky") / F.col("usual"), F.lit(1.0))))
    return ahead.join(d.groupBy("owner", "sky").agg(mean("of_sky")), ["owner", "sky"], "left").select("owner", text(F.col("day")).alias("day"), "sky", F.round(factor, 6).alias("factor"))
