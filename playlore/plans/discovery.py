"""Recommendations, forecasts, shelves and loyalties."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlore.functions.compat import arg_max, hours, ratio, share, text, week
from playlore.functions.config import Lens
from playlore.functions.scratch import written
from playlore.operators import vectors
from playlore.operators.joins import any_of, spread, top_by
from playlore.plans.base import Catalogue

C = Catalogue()
QUERIES, ORACLE = C.queries, C.oracle
ALL = Lens()
TODAY = "2001-06-01"
H = "3600000.0::DOUBLE"


def _today():
    return F.lit(TODAY).cast("date")


@C.query("f_adjacency", "plays", "edges", sql=f"""own AS (SELECT owner, artist, sum(ms) / {H} AS h FROM plays WHERE attended GROUP BY ALL HAVING count(*) >= 25),
sc AS (SELECT owner, other AS artist, sum(match * log10(1 + h)) AS s, count(*) AS seeds FROM own JOIN edges USING (artist) GROUP BY ALL)
SELECT sc.owner, sc.artist, seeds, round(s / max(s) OVER (PARTITION BY sc.owner), 6) AS score FROM sc ANTI JOIN own USING (owner, artist) QUALIFY row_number() OVER (PARTITION BY sc.owner ORDER BY round(s, 9) DESC, sc.artist) <= 20""")
def adjacency(plays: DataFrame, edges: DataFrame) -> DataFrame:
    """Artists like many of those a listener has, whom they don't have (F69): the table of edges, joined to owned artists only."""
    own = ALL.plays(plays).groupBy("owner", "artist").agg(hours(F.sum("ms")).alias("h"), F.count(F.lit(1)).alias("n")).filter("n >= 25")
    scored = own.join(edges, "artist").groupBy("owner", F.col("other").alias("artist")).agg(F.sum(F.col("match") * F.log10(1 + F.col("h"))).alias("s"), F.count(F.lit(1)).alias("seeds"))
    new = scored.join(own.select("owner", "artist"), ["owner", "artist"], "left_anti").withColumn("score", F.round(F.col("s") / F.max("s").over(Window.partitionBy("owner")), 6))
    return top_by(new, ["owner"], 20, F.round("s", 9).desc(), F.col("artist")).select("owner", "artist", "seeds", "score")


@C.query("f_tag_signature", "plays", "tracks", sql="""g AS (SELECT tag, count(*)::DOUBLE / sum(count(*)) OVER () AS base FROM plays JOIN tracks USING (track) WHERE attended GROUP BY tag), o AS (SELECT owner, tag, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY owner) AS part FROM plays JOIN tracks USING (track) WHERE attended GROUP BY owner, tag)
SELECT owner, tag, n AS plays, part AS share, round(part / base, 6) AS lift FROM o JOIN g USING (tag)""")
def tag_signature(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """What a listener hears more of than all do."""
    n = ALL.plays(plays).join(tracks.select("track", "tag"), "track").groupBy("owner", "tag").agg(F.count(F.lit(1)).alias("plays"))
    base = n.groupBy("tag").agg(F.sum("plays").alias("t"))
    base = base.crossJoin(F.broadcast(base.agg(F.sum("t").alias("z")))).select("tag", (F.col("t").cast("double") / F.col("z")).alias("base"))
    s = n.withColumn("share", F.col("plays").cast("double") / F.sum("plays").over(Window.partitionBy("owner")))
    return s.join(base, "tag").select("owner", "tag", "plays", "share", F.round(F.col("share") / F.col("base"), 6).alias("lift"))


@C.query("f_underserved", "plays", sql="SELECT owner, artist, count(*) AS plays, avg(skipped::INT) AS skip_rate FROM plays WHERE attended GROUP BY ALL HAVING count(*) BETWEEN 8 AND 40 AND avg(skipped::INT) <= 0.2")
def underserved(plays: DataFrame) -> DataFrame:
    """Artists hardly ever skipped and not yet much played."""
    return ALL.plays(plays).groupBy("owner", "artist").agg(F.count(F.lit(1)).alias("plays"), share(F.col("skipped")).alias("skip_rate")).filter("plays between 8 and 40 and skip_rate <= 0.2")


@C.query("f_forgotten", "plays", sql=f"SELECT owner, artist, sum(ms) / {H} AS hours, (DATE '{TODAY}' - max(day))::INTEGER AS days_silent FROM plays WHERE attended GROUP BY ALL HAVING sum(ms) >= 3600000 AND DATE '{TODAY}' - max(day) >= 180")
def forgotten(plays: DataFrame) -> DataFrame:
    a = ALL.plays(plays).groupBy("owner", "artist").agg(F.sum("ms").alias("ms"), F.max("day").alias("l"))
    return a.filter((F.col("ms") >= 3_600_000) & (F.datediff(_today(), "l") >= 180)).select("owner", "artist", hours(F.col("ms")).alias("hours"), F.datediff(_today(), "l").alias("days_silent"))


@C.query("f_one_track_wonders", "plays", sql="""n AS (SELECT owner, artist, track, count(*) AS c, sum(count(*)) OVER (PARTITION BY owner, artist)::BIGINT AS t FROM plays WHERE attended GROUP BY owner, artist, track)
SELECT owner, artist, track, c AS plays, c::DOUBLE / t AS share FROM n WHERE t >= 5 AND c >= 2 AND c * 10 >= t QUALIFY row_number() OVER (PARTITION BY owner, artist ORDER BY c DESC, track) = 1""")
def one_track_wonders(plays: DataFrame) -> DataFrame:
    n = ALL.plays(plays).groupBy("owner", "artist", "track").agg(F.count(F.lit(1)).alias("plays")).withColumn("t", F.sum("plays").over(Window.partitionBy("owner", "artist")))
    hit = n.filter("t >= 5 and plays >= 2 and plays * 10 >= t")
    return top_by(hit, ["owner", "artist"], 1, F.desc("plays"), F.col("track")).select("owner", "artist", "track", "plays", ratio(F.col("plays"), F.col("t")).alias("share"))


@C.query("f_beyond_favourites", "plays", sql="""c AS (SELECT owner, artist, track, count(*) AS n, row_number() OVER (PARTITION BY owner, artist ORDER BY count(*) DESC, track) AS r FROM plays WHERE attended GROUP BY owner, artist, track)
SELECT owner, artist, sum(n)::BIGINT AS plays, (coalesce(sum(n) FILTER (r > 5), 0))::DOUBLE / sum(n)::DOUBLE AS deep_share FROM c GROUP BY ALL HAVING sum(n) >= 10""")
def beyond_favourites(plays: DataFrame) -> DataFrame:
    """How much of an artist is heard beyond the five favourites (F32)."""
    c = ALL.plays(plays).groupBy("owner", "artist", "track").agg(F.count(F.lit(1)).alias("n"))
    r = c.withColumn("r", F.row_number().over(Window.partitionBy("owner", "artist").orderBy(F.desc("n"), "track")))
    a = r.groupBy("owner", "artist").agg(F.sum("n").alias("plays"), F.coalesce(F.sum(F.when(F.col("r") > 5, F.col("n"))), F.lit(0)).alias("deep"))
    return a.filter("plays >= 10").select("owner", "artist", "plays", ratio(F.col("deep"), F.col("plays")).alias("deep_share"))


@C.query("f_album_loyalty", "plays", "tracks", sql="""n AS (SELECT owner, artist, album, count(*) AS c, sum(count(*)) OVER (PARTITION BY owner, artist)::BIGINT AS t, count(*) OVER (PARTITION BY owner, artist) AS k FROM plays JOIN tracks USING (track) WHERE attended GROUP BY owner, artist, album)
SELECT owner, artist, album, t AS plays, c::DOUBLE / t AS share FROM n WHERE t >= 15 AND k >= 3 QUALIFY row_number() OVER (PARTITION BY owner, artist ORDER BY c DESC, album) = 1""")
def album_loyalty(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """The album that an artist is mostly heard by."""
    n = ALL.plays(plays).join(tracks.select("track", "album"), "track").groupBy("owner", "artist", "album").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("owner", "artist")
    k = n.withColumns({"plays": F.sum("c").over(w), "k": F.count(F.lit(1)).over(w)}).filter("plays >= 15 and k >= 3")
    return top_by(k, ["owner", "artist"], 1, F.desc("c"), F.col("album")).select("owner", "artist", "album", "plays", ratio(F.col("c"), F.col("plays")).alias("share"))


@C.query("f_explicit_share", "plays", "tracks", sql="SELECT year(day)::INTEGER AS year, count(*) AS known, avg(explicit::INT) AS explicit_share FROM plays JOIN tracks USING (track) WHERE attended GROUP BY 1 HAVING count(*) >= 50")
def explicit_share(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    return ALL.plays(plays).join(tracks.select("track", "explicit"), "track").groupBy(F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("known"), share(F.col("explicit")).alias("explicit_share")).filter("known >= 50")


@C.query("f_album_completeness", "plays", "tracks", sql="""k AS (SELECT album, count(*) AS known FROM tracks GROUP BY 1), d AS (SELECT owner, date_trunc('month', day)::DATE AS mo, album, count(DISTINCT track) AS heard FROM plays JOIN tracks USING (track) WHERE attended GROUP BY ALL)
SELECT owner, strftime(mo, '%Y-%m-%d') AS month, album, heard, known, heard::DOUBLE / known AS part FROM d JOIN k USING (album) WHERE heard * 25 >= known""")
def album_completeness(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """Albums of which much was heard within a month."""
    known = tracks.groupBy("album").agg(F.count(F.lit(1)).alias("known"))
    d = ALL.plays(plays).join(tracks.select("track", "album"), "track").groupBy("owner", F.trunc("day", "month").alias("mo"), "album").agg(F.count_distinct("track").alias("heard"))
    return d.join(known, "album").filter("heard * 25 >= known").select("owner", text(F.col("mo")).alias("month"), "album", "heard", "known", ratio(F.col("heard"), F.col("known")).alias("part"))


def slot():
    return F.concat(F.when(F.weekday("day") >= 5, "weekend").otherwise("weekday"), F.lit("-"), F.when(F.col("hour") < 5, "late").when(F.col("hour") < 11, "morning").when(F.col("hour") < 15, "midday").when(F.col("hour") < 20, "evening").otherwise("night"))
_SLOT = "CASE WHEN isodow(day) >= 6 THEN 'weekend' ELSE 'weekday' END || '-' || CASE WHEN hour < 5 THEN 'late' WHEN hour < 11 THEN 'morning' WHEN hour < 15 THEN 'midday' WHEN hour < 20 THEN 'evening' ELSE 'night' END"


@C.query("f_mood_map", "plays", sql=f"""n AS (SELECT owner, artist, {_SLOT} AS slot, count(*) AS n FROM plays WHERE attended GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY owner, artist)::BIGINT AS an, sum(n) OVER (PARTITION BY owner, slot)::BIGINT AS sn, sum(n) OVER (PARTITION BY owner)::BIGINT AS t FROM n),
l AS (SELECT *, n * t / (an * sn)::DOUBLE AS lift FROM w WHERE n >= 2)
SELECT owner, slot, artist, n AS plays, round(lift, 6) AS lift FROM l QUALIFY row_number() OVER (PARTITION BY owner, slot ORDER BY round(lift * log10(1 + n), 9) DESC, artist) <= 5""")
def mood_map(plays: DataFrame) -> DataFrame:
    """What goes with ten times of the week (F44): one pass with a slot column."""
    n = ALL.plays(plays).groupBy("owner", "artist", slot().alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    over = lambda *k: F.sum("n").over(Window.partitionBy("owner", *k))
    w = n.withColumns({"an": over("artist"), "sn": over("slot"), "t": over()}).filter("n >= 2").withColumn("lift", F.col("n") * F.col("t") / (F.col("an") * F.col("sn")).cast("double"))
    return top_by(w, ["owner", "slot"], 5, F.round(F.col("lift") * F.log10(1 + F.col("n")), 9).desc(), F.col("artist")).select("owner", "slot", "artist", F.col("n").alias("plays"), F.round("lift", 6).alias("lift"))


@C.query("f_hour_lift", "plays", sql="""n AS (SELECT owner, artist, hour // 6 AS g, count(*) AS n FROM plays GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY owner, artist) AS a, sum(n) OVER (PARTITION BY owner, g) AS b, sum(n) OVER (PARTITION BY owner) AS t FROM n)
SELECT owner, artist, g::BIGINT AS quarter, n, round((n * t)::DOUBLE / (a * b)::DOUBLE, 6) AS lift FROM w""")
def hour_lift(plays: DataFrame) -> DataFrame:
    """How much more than usual an artist is heard in a quarter of the day."""
    return vectors.lift(plays, "owner", "artist", F.floor(F.col("hour") / 6)).select("owner", "artist", F.col("group").alias("quarter"), "n", "lift")


@C.query("f_liked_unplayed", "plays", "liked", sql=f"SELECT l.owner, l.track, (DATE '{TODAY}' - added)::INTEGER AS days FROM liked l ANTI JOIN (SELECT p.owner, p.track, p.day FROM plays p WHERE attended) p ON p.owner = l.owner AND p.track = l.track AND p.day > l.added WHERE DATE '{TODAY}' - added > 90")
def liked_unplayed(plays: DataFrame, liked: DataFrame) -> DataFrame:
    """Liked long ago and not heard since."""
    p = ALL.plays(plays).select(F.col("owner").alias("o"), F.col("track").alias("t"), "day")
    since = liked.join(p, (F.col("owner") == F.col("o")) & (F.col("track") == F.col("t")) & (F.col("day") > F.col("added")), "left_anti")
    return since.filter(F.datediff(_today(), "added") > 90).select("owner", "track", F.datediff(_today(), "added").alias("days"))


@C.query("f_liked_songs", "plays", "liked", sql="SELECT l.owner, l.track, count(p.play_id) FILTER (p.day >= l.added) AS since, count(p.play_id) FILTER (p.day < l.added) AS before, count(p.play_id) FILTER (p.day >= l.added AND p.day < l.added + 90) AS momentum FROM liked l LEFT JOIN plays p ON p.owner = l.owner AND p.track = l.track GROUP BY ALL")
def liked_songs(plays: DataFrame, liked: DataFrame) -> DataFrame:
    """Plays before and since a song was liked (F49): one equal join and conditional counts."""
    d = F.datediff("day", "added")
    return liked.join(plays.select("owner", "track", "day"), ["owner", "track"], "left").groupBy("owner", "track").agg(F.count_if(d >= 0).alias("since"), F.count_if(d < 0).alias("before"), F.count_if((d >= 0) & (d < 90)).alias("momentum"))


@C.query("f_blend", "plays", sql="""t AS (SELECT owner % 2 AS who, track, count(*) AS n FROM plays WHERE attended GROUP BY ALL), a AS (SELECT track, n FROM t WHERE who = 0), b AS (SELECT track, n FROM t WHERE who = 1)
SELECT track, a.n AS mine, b.n AS theirs, 2.0::DOUBLE * a.n * b.n / (a.n + b.n) AS score FROM a JOIN b USING (track)""")
def blend(plays: DataFrame) -> DataFrame:
    """Tracks that two listeners share, by harmonic mean."""
    t = ALL.plays(plays).groupBy((F.col("owner") % 2).alias("who"), "track").agg(F.count(F.lit(1)).alias("n"))
    a, b = t.filter("who = 0").select("track", F.col("n").alias("mine")), t.filter("who = 1").select("track", F.col("n").alias("theirs"))
    return a.join(b, "track").withColumn("score", F.lit(2.0) * F.col("mine") * F.col("theirs") / (F.col("mine") + F.col("theirs")))


@C.query("f_blend_any", "tracks", sql="SELECT a.track AS track, min(b.track) AS other FROM tracks a JOIN tracks b ON a.track <> b.track AND ((a.name = b.name AND a.album = b.album) OR a.duration_ms = b.duration_ms) GROUP BY a.track")
def blend_any(tracks: DataFrame) -> DataFrame:
    """The first other track of the same name and album, or of the same length (F54): an OR of equalities as the two least of each group, without pairs."""

    def first_other(*keys: str) -> DataFrame:
        two = tracks.groupBy(*keys).agg(F.min("track").alias("m")).join(tracks, list(keys)).filter("track > m").groupBy(*keys).agg(F.min("m").alias("m"), F.min("track").alias("second"))
        return tracks.join(two, list(keys)).select("track", F.when(F.col("track") == F.col("m"), F.col("second")).otherwise(F.col("m")).alias("other"))

    return first_other("name", "album").unionByName(first_other("duration_ms")).groupBy("track").agg(F.min("other").alias("other"))


@C.query("f_forecast", "plays", sql=f"""d AS (SELECT unnest(generate_series(1, 26))::INTEGER AS i), days AS (SELECT (DATE '{TODAY}' - 7 * i)::DATE AS day FROM d), p AS (SELECT p.* FROM plays p SEMI JOIN days USING (day) WHERE attended)
SELECT owner, count(DISTINCT day) / 26.0::DOUBLE AS p_any, sum(ms) / 60000.0::DOUBLE / 26 AS minutes, count(DISTINCT day) FILTER (hour >= 18) / 26.0::DOUBLE AS p_evening FROM p GROUP BY owner""")
def forecast(plays: DataFrame, weeks: int = 26) -> DataFrame:
    """Base rates of a weekday, from the last half year of that weekday."""
    days = plays.sparkSession.range(1, weeks + 1).select(F.date_sub(_today(), (F.col("id") * 7).cast("int")).alias("day"))
    p = ALL.plays(plays).join(F.broadcast(days), "day", "left_semi")
    return p.groupBy("owner").agg((F.count_distinct("day") / F.lit(float(weeks))).alias("p_any"), (F.sum("ms") / F.lit(60_000.0) / weeks).alias("minutes"), (F.count_distinct(F.when(F.col("hour") >= 18, F.col("day"))) / F.lit(float(weeks))).alias("p_evening"))


@C.query("f_fronts", "plays", sql=f"""a AS (SELECT owner, artist, coalesce(sum(ms) FILTER (day >= DATE '{TODAY}' - 28), 0)::BIGINT AS r, coalesce(sum(ms) FILTER (day < DATE '{TODAY}' - 28), 0)::BIGINT AS b FROM plays WHERE attended AND day >= DATE '{TODAY}' - 112 AND day < DATE '{TODAY}' GROUP BY ALL),
s AS (SELECT *, r / nullif(sum(r) OVER (PARTITION BY owner), 0) AS rs, b / nullif(sum(b) OVER (PARTITION BY owner), 0) AS bs FROM a), f AS (SELECT owner, artist, round((rs + 0.005) / (bs + 0.005), 6) AS ratio FROM s)
SELECT owner, artist, ratio, CASE WHEN ratio >= 1.5 THEN 'warm' ELSE 'cold' END AS front FROM f WHERE ratio >= 1.5 OR ratio <= 0.6""")
def fronts(plays: DataFrame) -> DataFrame:
    """What is coming and what is going: four weeks against twelve."""
    d, ms = F.col("day"), F.col("ms")
    recent = d >= F.date_sub(_today(), 28)
    a = ALL.plays(plays).filter((d >= F.date_sub(_today(), 112)) & (d < _today())).groupBy("owner", "artist").agg(F.coalesce(F.sum(F.when(recent, ms)), F.lit(0)).alias("r"), F.coalesce(F.sum(F.when(~recent, ms)), F.lit(0)).alias("b"))
    w = Window.partitionBy("owner")
    part = lambda c: F.col(c) / F.nullif(F.sum(c).over(w), F.lit(0))
    f = a.withColumn("ratio", F.round((part("r") + 0.005) / (part("b") + 0.005), 6))
    return f.filter("ratio >= 1.5 or ratio <= 0.6").select("owner", "artist", "ratio", F.when(F.col("ratio") >= 1.5, "warm").otherwise("cold").alias("front"))


@C.query("f_backtest", "plays", sql=f"""t AS (SELECT (DATE '{TODAY}' - i::INTEGER)::DATE AS target FROM range(1, 29) r(i)), da AS (SELECT owner, day, artist, count(*) AS n FROM plays WHERE attended GROUP BY ALL), e AS (SELECT owner, target, artist, sum(n) AS n FROM t JOIN da ON day < target AND day >= target - 182 GROUP BY ALL),
top AS (SELECT owner, target, artist FROM e QUALIFY row_number() OVER (PARTITION BY owner, target ORDER BY n DESC, artist) <= 10), act AS (SELECT owner, day AS target, artist FROM da JOIN t ON target = day)
SELECT act.owner, count(*) AS heard, count(top.artist) AS hits FROM act LEFT JOIN top USING (owner, target, artist) GROUP BY act.owner""")
def backtest(plays: DataFrame, days: int = 28, history: int = 182) -> DataFrame:
    """Would the ten favourites of the half year before have met each day (F84)? Days are summed up first; a day is handed to the targets that it precedes."""
    per_day = ALL.plays(plays).filter((F.col("day") < _today()) & (F.col("day") >= F.date_sub(_today(), days + history))).groupBy("owner", "day", "artist").agg(F.count(F.lit(1)).alias("n"))
    first = F.greatest(F.date_add("day", 1), F.date_sub(_today(), days))
    last = F.least(F.date_add("day", history), F.date_sub(_today(), 1))
    e = per_day.filter(first <= last).withColumn("target", F.explode(F.sequence(first, last, F.expr("interval 1 day")))).groupBy("owner", "target", "artist").agg(F.sum("n").alias("n"))
    top = top_by(e, ["owner", "target"], 10, F.desc("n"), F.col("artist")).select("owner", "target", "artist", F.lit(1).alias("hit"))
    actual = per_day.filter(F.col("day") >= F.date_sub(_today(), days)).select("owner", F.col("day").alias("target"), "artist")
    return actual.join(top, ["owner", "target", "artist"], "left").groupBy("owner").agg(F.count(F.lit(1)).alias("heard"), F.count("hit").alias("hits"))


@C.query("f_brier", "plays", sql="""d AS (SELECT DISTINCT owner, day FROM plays WHERE attended), b AS (SELECT owner, year(day) + 1 AS y, isodow(day) AS dow, count(*)::DOUBLE / 53 AS p FROM d GROUP BY ALL), e AS (SELECT min(day) AS lo, max(day) AS hi FROM d),
g AS (SELECT owner, unnest(generate_series((SELECT lo FROM e), (SELECT hi FROM e), INTERVAL 1 DAY))::DATE AS day FROM (SELECT DISTINCT owner FROM d)), s AS (SELECT g.owner, year(g.day) AS y, month(g.day) AS m, pow(coalesce(p, 0) - (d.day IS NOT NULL)::INT, 2) AS e FROM g LEFT JOIN d USING (owner, day) LEFT JOIN b ON b.owner = g.owner AND b.y = year(g.day) AND b.dow = isodow(g.day))
SELECT y::INTEGER AS year, m::INTEGER AS month, round(avg(e), 6) AS brier, count(*) AS n FROM s GROUP BY y, m""")
def brier(plays: DataFrame) -> DataFrame:
    """How good the weekday rates of the year before are, day by day."""
    d = ALL.plays(plays).select("owner", "day").distinct()
    base = d.groupBy("owner", (F.year("day") + 1).alias("year"), F.weekday("day").alias("dow")).agg((F.count(F.lit(1)).cast("double") / 53).alias("p"))
    span = d.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))  # one row
    grid = d.select("owner").distinct().crossJoin(F.broadcast(span)).select("owner", F.explode(F.expr("sequence(lo, hi, interval 1 day)")).alias("day")).withColumns({"dow": F.weekday("day"), "year": F.year("day")})
    e = grid.join(d.withColumn("hit", F.lit(1)), ["owner", "day"], "left").join(base, ["owner", "year", "dow"], "left")
    err = F.pow(F.coalesce("p", F.lit(0.0)) - F.coalesce("hit", F.lit(0)), F.lit(2))
    return e.groupBy("year", F.month("day").alias("month")).agg(F.round(F.avg(err), 6).alias("brier"), F.count(F.lit(1)).alias("n"))


@C.query("f_crate", "plays", "tracks", sql=f"""n AS (SELECT owner, album, count(*) AS plays, count(DISTINCT day) AS days, max(day) AS l, avg(skipped::INT) AS sr FROM plays JOIN tracks USING (track) WHERE attended GROUP BY ALL)
SELECT owner, album, plays, days, (DATE '{TODAY}' - l)::INTEGER AS silence, round(log10(1 + plays) / max(log10(1 + plays)) OVER (PARTITION BY owner), 6) AS wear, plays < 60 AND DATE '{TODAY}' - l > 60 AS abandoned, plays >= 100 AND DATE '{TODAY}' - l > 30 AS rediscover FROM n""")
def crate(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """Albums as a shelf: wear, silence, flags."""
    n = ALL.plays(plays).join(tracks.select("track", "album"), "track").groupBy("owner", "album").agg(F.count(F.lit(1)).alias("plays"), F.count_distinct("day").alias("days"), F.max("day").alias("l"))
    silence = F.datediff(_today(), "l")
    worn = F.log10(1 + F.col("plays"))
    return n.select("owner", "album", "plays", "days", silence.alias("silence"), F.round(worn / F.max(worn).over(Window.partitionBy("owner")), 6).alias("wear"), ((F.col("plays") < 60) & (silence > 60)).alias("abandoned"), ((F.col("plays") >= 100) & (silence > 30)).alias("rediscover"))


@C.query("f_daily_dig", "tracks", sql="a AS (SELECT DISTINCT album FROM tracks) SELECT d::INTEGER AS day_number, arg_min(album, md5(album || '//' || d)) AS album FROM a, range(1, 8) r(d) GROUP BY d")
def daily_dig(tracks: DataFrame) -> DataFrame:
    """One album a day, by a hash that any engine has."""
    a = tracks.select("album").distinct().withColumn("day_number", F.explode(F.sequence(F.lit(1), F.lit(7))))
    return a.groupBy("day_number").agg(F.min_by("album", F.md5(F.concat("album", F.lit("//"), F.col("day_number").cast("string")))).alias("album"))


@C.query("f_obscurity", "plays", "artists", sql=f"""o AS (SELECT artist, country, round(least(1, greatest(0, 1 - log10(listeners + 1) / 7)), 6) AS obscurity, CASE WHEN listeners < 10000 THEN 'tiny' WHEN listeners < 1000000 THEN 'small' ELSE 'big' END AS room FROM artists)
SELECT owner, room, count(*) AS plays, sum(ms) / {H} AS hours, round(avg(obscurity), 6) AS obscurity FROM plays JOIN o USING (artist) WHERE attended GROUP BY owner, room""")
def obscurity(plays: DataFrame, artists: DataFrame) -> DataFrame:
    """How little known what is heard is (V5, F101)."""
    o = artists.select("artist", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.log10(F.col("listeners") + 1) / 7)), 6).alias("obscurity"), F.when(F.col("listeners") < 10_000, "tiny").when(F.col("listeners") < 1_000_000, "small").otherwise("big").alias("room"))
    return ALL.plays(plays).join(o, "artist").groupBy("owner", "room").agg(F.count(F.lit(1)).alias("plays"), hours(F.sum("ms")).alias("hours"), F.round(F.avg("obscurity"), 6).alias("obscurity"))


@C.query("f_origins", "plays", "artists", sql=f"""n AS (SELECT owner, country, artist, sum(ms)::BIGINT AS ms FROM plays JOIN artists USING (artist) WHERE attended GROUP BY ALL)
SELECT owner, country, count(*) AS artists, sum(ms) / {H} AS hours, array_to_string(list(artist ORDER BY ms DESC, artist)[1:5], ',') AS top_artists FROM n GROUP BY ALL""")
def origins(plays: DataFrame, artists: DataFrame) -> DataFrame:
    """Countries of origin, with their leading artists (F145)."""
    n = ALL.plays(plays).join(artists.select("artist", "country"), "artist").groupBy("owner", "country", "artist").agg(F.sum("ms").alias("ms"))
    top = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("ms")).alias("m"), "artist"))), 1, 5)
    return n.groupBy("owner", "country").agg(F.count(F.lit(1)).alias("artists"), hours(F.sum("ms")).alias("hours"), F.array_join(F.transform(top, lambda x: x["artist"].cast("string")), ",").alias("top_artists"))


@C.query("f_trips", "plays", "artists", sql="""d AS (SELECT owner, day, country, sum(ms) AS ms FROM plays JOIN artists USING (artist) WHERE owner < 5 GROUP BY ALL HAVING sum(ms) >= 300000), s AS (SELECT owner, country, day, (coalesce(day - lag(day) OVER (PARTITION BY owner, country ORDER BY day) > 3, true))::INT AS opens FROM d), t AS (SELECT *, sum(opens) OVER (PARTITION BY owner, country ORDER BY day ROWS UNBOUNDED PRECEDING) AS trip FROM s)
SELECT owner, country, strftime(min(day), '%Y-%m-%d') AS since, (max(day) - min(day) + 1)::INTEGER AS days, count(*) AS active_days FROM t GROUP BY owner, country, trip HAVING count(*) >= 2""")
def trips(plays: DataFrame, artists: DataFrame) -> DataFrame:
    """Runs of days of one country with gaps of three days at most (F149)."""
    from playlore.operators.islands import change_runs

    d = plays.filter("owner < 5").join(artists.select("artist", "country"), "artist").groupBy("owner", "day", "country").agg(F.sum("ms").alias("ms")).filter("ms >= 300000")
    w = Window.partitionBy("owner", "country").orderBy("day")
    gap = d.withColumn("gap", F.datediff("day", F.lag("day").over(w)))
    t = change_runs(gap, ["owner", "country"], ["day"], F.col("gap").isNull() | (F.col("gap") > 3), "trip")
    return t.groupBy("owner", "country", "trip").agg(F.min("day").alias("a"), F.max("day").alias("z"), F.count(F.lit(1)).alias("active_days")).filter("active_days >= 2").select("owner", "country", text(F.col("a")).alias("since"), (F.datediff("z", "a") + 1).alias("days"), "active_days")


@C.query("f_bubble", "plays", "artists", sql="""n AS (SELECT owner, year(day)::INTEGER AS year, scene, sum(ms)::BIGINT AS ms FROM plays JOIN artists USING (artist) WHERE attended GROUP BY ALL), p AS (SELECT *, ms / sum(ms) OVER (PARTITION BY owner, year) AS p FROM n)
SELECT owner, year, round(-sum(p * log2(p)), 6) AS entropy, round(max(p), 6) AS top_share FROM p GROUP BY ALL""")
def bubble(plays: DataFrame, artists: DataFrame) -> DataFrame:
    """How many scenes a year is spread over (F129)."""
    n = ALL.plays(plays).join(artists.select("artist", "scene"), "artist").groupBy("owner", F.year("day").alias("year"), "scene").agg(F.sum("ms").alias("ms"))
    return vectors.entropy(n, ["owner", "year"], "ms")


@C.query("f_anti_recommendations", "plays", "artists", sql="""b AS (SELECT owner, avg(skipped::INT) AS base FROM plays WHERE attended GROUP BY 1), a AS (SELECT owner, artist, count(*) AS plays, avg(skipped::INT) AS sr FROM plays WHERE attended GROUP BY ALL HAVING count(*) >= 10)
SELECT owner, artist, country, plays, sr AS skip_rate FROM a JOIN b USING (owner) JOIN artists USING (artist) WHERE sr >= greatest(0.5, base + 0.15)""")
def anti_recommendations(plays: DataFrame, artists: DataFrame) -> DataFrame:
    """Artists that should please and don't (F131)."""
    p = ALL.plays(plays)
    base = p.groupBy("owner").agg(share(F.col("skipped")).alias("base"))
    a = p.groupBy("owner", "artist").agg(F.count(F.lit(1)).alias("plays"), share(F.col("skipped")).alias("skip_rate")).filter("plays >= 10")
    return a.join(base, "owner").filter(F.col("skip_rate") >= F.greatest(F.lit(0.5), F.col("base") + 0.15)).join(artists.select("artist", "country"), "artist").select("owner", "artist", "country", "plays", "skip_rate")


@C.query("f_length_bands", "plays", "tracks", sql="SELECT owner, CASE WHEN duration_ms < 150000 THEN 'short' WHEN duration_ms < 210000 THEN 'radio' WHEN duration_ms < 300000 THEN 'long' ELSE 'epic' END AS band, count(*) AS plays, (median(duration_ms))::DOUBLE AS median_ms FROM plays JOIN tracks USING (track) WHERE attended GROUP BY ALL")
def length_bands(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """Which lengths are heard (F133)."""
    d = F.col("duration_ms")
    band = F.when(d < 150_000, "short").when(d < 210_000, "radio").when(d < 300_000, "long").otherwise("epic")
    return ALL.plays(plays).join(tracks.select("track", "duration_ms"), "track").groupBy("owner", band.alias("band")).agg(F.count(F.lit(1)).alias("plays"), F.median("duration_ms").alias("median_ms"))


@C.query("f_skip_hall", "plays", sql="""s AS (SELECT owner, day FROM plays GROUP BY ALL HAVING count(*) FILTER (skipped) >= 3 AND avg(skipped::INT) >= 0.9) SELECT owner, track, count(*) AS shown, avg(skipped::INT) AS skip_rate FROM plays ANTI JOIN s USING (owner, day) GROUP BY ALL HAVING count(*) >= 3 AND avg(skipped::INT) >= 0.85""")
def skip_hall(plays: DataFrame) -> DataFrame:
    """Tracks that are nearly always skipped, sprees of skipping left out (F162)."""
    sprees = plays.groupBy("owner", "day").agg(F.count_if("skipped").alias("n"), share(F.col("skipped")).alias("r")).filter("n >= 3 and r >= 0.9").select("owner", "day")
    left = plays.select("owner", "day", "track", "skipped").join(written(sprees, "sprees"), ["owner", "day"], "left_anti")
    return spread(left.drop("day"), plays.count(), "owner", "track").groupBy("owner", "track").agg(F.count(F.lit(1)).alias("shown"), share(F.col("skipped")).alias("skip_rate")).filter("shown >= 3 and skip_rate >= 0.85")


@C.query("f_awards", "plays", sql="""y AS (SELECT owner, year(day)::INTEGER AS year, artist, count(*) AS n, sum(skipped::INT)::BIGINT AS k, min(day) AS f FROM plays WHERE attended GROUP BY ALL)
SELECT owner, year, 'most_played' AS award, artist, n AS value, (row_number() OVER (PARTITION BY owner, year ORDER BY n DESC, artist))::INTEGER AS place FROM y QUALIFY place <= 2
UNION ALL SELECT owner, year, 'most_skipped', artist, k, (row_number() OVER (PARTITION BY owner, year ORDER BY k DESC, artist))::INTEGER AS place FROM y QUALIFY place <= 2""")
def awards(plays: DataFrame) -> DataFrame:
    """Each year's superlatives with their runners-up (F161)."""
    y = ALL.plays(plays).groupBy("owner", F.year("day").alias("year"), "artist").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("skipped").cast("long")).alias("k"))
    each = y.select("owner", "year", "artist", F.explode(F.array(F.struct(F.lit("most_played").alias("award"), F.col("n").alias("value")), F.struct(F.lit("most_skipped").alias("award"), F.col("k").alias("value")))).alias("a")).select("owner", "year", "artist", "a.*")
    return top_by(each, ["owner", "year", "award"], 2, F.desc("value"), F.col("artist"), name="place").select("owner", "year", "award", "artist", "value", "place")


@C.query("f_achievements", "plays", sql=f"""t AS (SELECT owner, count(*) AS plays, count(DISTINCT artist) AS artists, (sum(ms) / {H})::DOUBLE AS hours FROM plays WHERE attended GROUP BY 1), e AS (SELECT owner, unnest([{{'k': 'plays', 'v': plays::DOUBLE, 'b': 1000, 's': 2500, 'g': 5000}}, {{'k': 'artists', 'v': artists::DOUBLE, 'b': 50, 's': 90, 'g': 100}}, {{'k': 'hours', 'v': hours, 'b': 50, 's': 100, 'g': 200}}]) AS x FROM t)
SELECT owner, x.k AS badge, x.v AS value, CASE WHEN x.v >= x.g THEN 'gold' WHEN x.v >= x.s THEN 'silver' WHEN x.v >= x.b THEN 'bronze' ELSE 'locked' END AS tier FROM e""")
def achievements(plays: DataFrame) -> DataFrame:
    """Badges with three tiers."""
    t = ALL.plays(plays).groupBy("owner").agg(F.count(F.lit(1)).cast("double").alias("plays"), F.count_distinct("artist").cast("double").alias("artists"), hours(F.sum("ms")).alias("hours"))
    tiers = {"plays": (1000, 2500, 5000), "artists": (50, 90, 100), "hours": (50, 100, 200)}
    row = lambda k, b, s, g: F.struct(F.lit(k).alias("badge"), F.col(k).alias("value"), F.when(F.col(k) >= g, "gold").when(F.col(k) >= s, "silver").when(F.col(k) >= b, "bronze").otherwise("locked").alias("tier"))
    return t.select("owner", F.explode(F.array(*[row(k, *v) for k, v in tiers.items()])).alias("a")).select("owner", "a.*")


@C.query("f_week_notes", "plays", sql=f"""n AS (SELECT owner, artist, date_trunc('week', day)::DATE AS wk, count(*) AS c FROM plays WHERE attended AND day >= DATE '1999-01-04' AND day < DATE '1999-03-01' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY owner, wk ORDER BY c DESC, artist) AS rank FROM n),
x AS (SELECT *, lag(rank) OVER (PARTITION BY owner, artist ORDER BY wk) AS before, lag(wk) OVER (PARTITION BY owner, artist ORDER BY wk) AS bw FROM r)
SELECT owner, strftime(wk, '%Y-%m-%d') AS week, artist, c AS plays, rank::INTEGER AS rank, CASE WHEN bw = wk - 7 THEN before END::INTEGER AS last_rank FROM x WHERE rank <= 3""")
def week_notes(plays: DataFrame) -> DataFrame:
    """The week's leaders and where they stood the week before (F156)."""
    n = ALL.plays(plays).filter("day >= date '1999-01-04' and day < date '1999-03-01'").groupBy("owner", "artist", week(F.col("day")).alias("wk")).agg(F.count(F.lit(1)).alias("c"))
    r = n.withColumn("rank", F.row_number().over(Window.partitionBy("owner", "wk").orderBy(F.desc("c"), "artist")))
    w = Window.partitionBy("owner", "artist").orderBy("wk")
    x = r.withColumns({"before": F.lag("rank").over(w), "bw": F.lag("wk").over(w)})
    return x.filter("rank <= 3").select("owner", text(F.col("wk")).alias("week"), "artist", F.col("c").alias("plays"), "rank", F.when(F.col("bw") == F.date_sub("wk", 7), F.col("before")).alias("last_rank"))


@C.query("f_curated_b_sides", "plays", sql="""n AS (SELECT owner, artist, track, count(*) AS c, avg(skipped::INT) AS sr FROM plays WHERE attended GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY owner, artist ORDER BY c DESC, track) AS r FROM n)
SELECT owner, artist, track, c AS plays FROM r WHERE r BETWEEN 6 AND 7 AND sr = 0""")
def b_sides(plays: DataFrame) -> DataFrame:
    """Never skipped, and just outside an artist's favourites."""
    n = ALL.plays(plays).groupBy("owner", "artist", "track").agg(F.count(F.lit(1)).alias("plays"), share(F.col("skipped")).alias("sr"))
    r = n.withColumn("r", F.row_number().over(Window.partitionBy("owner", "artist").orderBy(F.desc("plays"), "track")))
    return r.filter("r between 6 and 7 and sr = 0").select("owner", "artist", "track", "plays")


@C.query("f_followed_gems", "plays", "liked", sql="""n AS (SELECT owner, track, count(*) AS c FROM plays WHERE attended AND NOT skipped GROUP BY ALL) SELECT n.owner, n.track, c AS plays FROM n ANTI JOIN liked USING (owner, track) QUALIFY row_number() OVER (PARTITION BY n.owner ORDER BY c DESC, n.track) <= 5""")
def gems(plays: DataFrame, liked: DataFrame) -> DataFrame:
    """Regulars that were never saved (F64, F163)."""
    n = ALL.plays(plays).filter("not skipped").groupBy("owner", "track").agg(F.count(F.lit(1)).alias("plays"))
    return top_by(n.join(liked, ["owner", "track"], "left_anti"), ["owner"], 5, F.desc("plays"), F.col("track")).drop("rank")


@C.query("f_supporting_artist", "plays", sql="""n AS (SELECT owner, date_trunc('month', day)::DATE AS mo, artist, count(*) AS c FROM plays WHERE attended GROUP BY ALL) SELECT owner, strftime(mo, '%Y-%m-%d') AS month, arg_max(artist, (c, -artist)) AS lead, max(c) AS plays FROM n GROUP BY owner, mo""")
def monthly_leads(plays: DataFrame) -> DataFrame:
    n = ALL.plays(plays).groupBy("owner", F.trunc("day", "month").alias("mo"), "artist").agg(F.count(F.lit(1)).alias("c"))
    return n.groupBy("owner", "mo").agg(arg_max(F.col("artist"), F.col("c"), -F.col("artist")).alias("lead"), F.max("c").alias("plays")).select("owner", text(F.col("mo")).alias("month"), "lead", "plays")
