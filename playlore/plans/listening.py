"""Totals, rankings, calendars, streaks and records of plays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlore.functions.compat import arg_max, hours, minutes, month, ratio, share, text, week
from playlore.functions.config import Lens
from playlore.operators.islands import day_runs
from playlore.operators.joins import top_by
from playlore.plans.base import Catalogue

C = Catalogue()
QUERIES, ORACLE = C.queries, C.oracle
ALL = Lens()
#: The queries' "today": the day after the record ends is as good as any, and it is a parameter everywhere.
TODAY = "2001-11-01"
H = "3600000.0::DOUBLE"


@C.query("f_artist_rank", "plays", sql=f"""SELECT owner, artist, count(*) AS plays, (sum(ms) / {H}) AS hours, avg(skipped::INT) AS skip_rate, strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day,
  (rank() OVER (PARTITION BY owner ORDER BY sum(ms) DESC))::INTEGER AS rank FROM plays WHERE attended GROUP BY owner, artist""")
def artist_rank(plays: DataFrame) -> DataFrame:
    """Every artist of every listener, ranked by hours."""
    a = ALL.plays(plays).groupBy("owner", "artist").agg(F.count(F.lit(1)).alias("plays"), F.sum("ms").alias("ms"), share(F.col("skipped")).alias("skip_rate"), text(F.min("day")).alias("first_day"), text(F.max("day")).alias("last_day"))
    return a.withColumn("rank", F.rank().over(Window.partitionBy("owner").orderBy(F.desc("ms")))).select("owner", "artist", "plays", hours(F.col("ms")).alias("hours"), "skip_rate", "first_day", "last_day", "rank")


@C.query("f_top_tracks", "plays", "tracks", sql=f"""n AS (SELECT owner, track, count(*) AS plays, sum(ms) AS ms FROM plays WHERE attended GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY plays DESC, ms DESC, track) AS rank FROM n)
SELECT owner, track, name, plays, (ms / {H}) AS hours, rank::INTEGER AS rank FROM r JOIN tracks USING (track) WHERE rank <= 10""")
def top_tracks(plays: DataFrame, tracks: DataFrame, n: int = 10) -> DataFrame:
    """Names are joined to the few rows that are left."""
    counted = ALL.plays(plays).groupBy("owner", "track").agg(F.count(F.lit(1)).alias("plays"), F.sum("ms").alias("ms"))
    return top_by(counted, ["owner"], n, F.desc("plays"), F.desc("ms"), F.col("track")).join(tracks, "track").select("owner", "track", "name", "plays", hours(F.col("ms")).alias("hours"), "rank")


@C.query("f_top_albums", "plays", "tracks", sql=f"""n AS (SELECT owner, album, count(*) AS plays, sum(ms) AS ms, count(DISTINCT track) AS tracks FROM plays JOIN tracks USING (track) WHERE attended AND day >= DATE '1998-01-01' AND day < DATE '1999-01-01' GROUP BY ALL)
SELECT owner, album, plays, (ms / {H}) AS hours, tracks FROM n QUALIFY row_number() OVER (PARTITION BY owner ORDER BY ms DESC, album) <= 5""")
def top_albums(plays: DataFrame, tracks: DataFrame, n: int = 5) -> DataFrame:
    """The most heard albums of one year."""
    heard = Lens(first_year=1998, last_year=1998).plays(plays).join(tracks.select("track", "album"), "track")
    counted = heard.groupBy("owner", "album").agg(F.count(F.lit(1)).alias("plays"), F.sum("ms").alias("ms"), F.count_distinct("track").alias("tracks"))
    return top_by(counted, ["owner"], n, F.desc("ms"), F.col("album")).select("owner", "album", "plays", hours(F.col("ms")).alias("hours"), "tracks")


def daily(plays: DataFrame) -> DataFrame:
    """View V1: (owner, day, ms, plays, artists)."""
    return plays.groupBy("owner", "day").agg(F.sum("ms").alias("ms"), F.count(F.lit(1)).alias("plays"), F.count_distinct("artist").alias("artists"))


@C.query("v_daily_minutes", "plays", sql="SELECT owner, strftime(day, '%Y-%m-%d') AS day, (sum(ms) / 60000.0::DOUBLE) AS minutes, count(*) AS plays, count(DISTINCT artist) AS artists FROM plays WHERE attended GROUP BY ALL")
def daily_minutes(plays: DataFrame) -> DataFrame:
    return daily(ALL.plays(plays)).select("owner", text(F.col("day")).alias("day"), minutes(F.col("ms")).alias("minutes"), "plays", "artists")


@C.query("f_calendar", "plays", sql="""d AS (SELECT owner, day, sum(ms) AS ms, count(*) AS plays FROM plays WHERE attended AND day >= DATE '1999-01-01' AND day < DATE '2000-01-01' GROUP BY ALL),
o AS (SELECT DISTINCT owner FROM plays WHERE attended AND day >= DATE '1999-01-01' AND day < DATE '2000-01-01'), c AS (SELECT owner, unnest(generate_series(DATE '1999-01-01', DATE '1999-12-31', INTERVAL 1 DAY))::DATE AS day FROM o)
SELECT owner, strftime(day, '%Y-%m-%d') AS day, (coalesce(ms, 0) / 60000.0::DOUBLE) AS minutes, coalesce(plays, 0) AS plays FROM c LEFT JOIN d USING (owner, day)""")
def calendar(plays: DataFrame, year: int = 1999) -> DataFrame:
    """Every day of a year, silent ones with 0 (F1)."""
    d = daily(Lens(first_year=year, last_year=year).plays(plays))
    span = F.sequence(F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year}-12-31").cast("date"))
    grid = d.select("owner").distinct().withColumn("day", F.explode(span))
    return grid.join(d, ["owner", "day"], "left").select("owner", text(F.col("day")).alias("day"), minutes(F.coalesce("ms", F.lit(0))).alias("minutes"), F.coalesce("plays", F.lit(0)).alias("plays"))


@C.query("v_hourly_profile", "plays", sql=f"SELECT owner, hour, (sum(ms) / {H}) AS hours, count(*) AS plays FROM plays WHERE attended GROUP BY ALL")
def hourly_profile(plays: DataFrame) -> DataFrame:
    return ALL.plays(plays).groupBy("owner", "hour").agg(hours(F.sum("ms")).alias("hours"), F.count(F.lit(1)).alias("plays"))


@C.query("f_dashboard", "plays", sql=f"""SELECT owner, count(*) AS plays, (sum(ms) / {H}) AS hours, count(DISTINCT artist) AS artists, count(DISTINCT track) AS tracks, count(DISTINCT day) AS days, avg(skipped::INT) AS skip_rate,
  strftime(min(day), '%Y-%m-%d') AS since, strftime(max(day), '%Y-%m-%d') AS until FROM plays WHERE attended GROUP BY owner""")
def dashboard(plays: DataFrame) -> DataFrame:
    """Totals of each listener (F2)."""
    return ALL.plays(plays).groupBy("owner").agg(
        F.count(F.lit(1)).alias("plays"), hours(F.sum("ms")).alias("hours"), F.count_distinct("artist").alias("artists"), F.count_distinct("track").alias("tracks"), F.count_distinct("day").alias("days"),
        share(F.col("skipped")).alias("skip_rate"), text(F.min("day")).alias("since"), text(F.max("day")).alias("until"),
    )


_RUNS = "d AS (SELECT DISTINCT owner, day FROM plays WHERE attended), g AS (SELECT owner, day, day - (row_number() OVER (PARTITION BY owner ORDER BY day))::INTEGER AS grp FROM d), runs AS (SELECT owner, min(day) AS s, max(day) AS e, count(*) AS length FROM g GROUP BY owner, grp)"


@C.query("f_streaks", "plays", sql=_RUNS + ", r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY length DESC, s) AS rank FROM runs) SELECT owner, strftime(s, '%Y-%m-%d') AS start, strftime(e, '%Y-%m-%d') AS end_day, length, rank::INTEGER AS rank FROM r WHERE rank <= 3")
def streaks(plays: DataFrame, n: int = 3) -> DataFrame:
    """The longest runs of days with a play."""
    runs = day_runs(ALL.plays(plays).select("owner", "day"), ["owner"])
    return top_by(runs, ["owner"], n, F.desc("length"), F.col("start")).select("owner", text(F.col("start")).alias("start"), text(F.col("end")).alias("end_day"), "length", "rank")


@C.query("f_current_streak", "plays", sql=_RUNS + ", last AS (SELECT owner, arg_max(length, e) AS length, max(e) AS e FROM runs GROUP BY owner) SELECT owner, CASE WHEN e >= DATE '1999-06-30' - 1 THEN length ELSE 0 END AS streak FROM last")
def current_streak(plays: DataFrame, today: str = "1999-06-30") -> DataFrame:
    """The last run's length if it reaches yesterday, else 0."""
    runs = day_runs(ALL.plays(plays).select("owner", "day"), ["owner"])
    last = runs.groupBy("owner").agg(F.max_by("length", "end").alias("length"), F.max("end").alias("end"))
    return last.select("owner", F.when(F.col("end") >= F.date_sub(F.lit(today).cast("date"), 1), F.col("length")).otherwise(F.lit(0)).cast("long").alias("streak"))


@C.query("f_on_this_day", "plays", sql="""y AS (SELECT owner, year(day)::INTEGER AS year, track, count(*) AS n FROM plays WHERE attended AND month(day) = 6 AND dayofmonth(day) = 15 GROUP BY ALL)
SELECT owner, year, sum(n)::BIGINT AS plays, arg_max(track, (n, -track)) AS top_track FROM y GROUP BY owner, year""")
def on_this_day(plays: DataFrame, month_: int = 6, day_: int = 15) -> DataFrame:
    y = ALL.plays(plays).filter((F.month("day") == month_) & (F.dayofmonth("day") == day_)).groupBy("owner", F.year("day").alias("year"), "track").agg(F.count(F.lit(1)).alias("n"))
    return y.groupBy("owner", "year").agg(F.sum("n").alias("plays"), arg_max(F.col("track"), F.col("n"), -F.col("track")).alias("top_track"))


@C.query("f_records", "plays", sql="""d AS (SELECT owner, day, sum(ms) AS ms FROM plays WHERE attended GROUP BY ALL), t AS (SELECT owner, track, count(*) AS n FROM plays WHERE attended GROUP BY ALL), l AS (SELECT owner, artist, count(*) AS n FROM plays WHERE attended AND (hour >= 23 OR hour < 4) GROUP BY ALL)
SELECT owner, strftime(ld, '%Y-%m-%d') AS loudest_day, minutes, top_track, top_plays, late_artist FROM (SELECT owner, arg_max(day, (ms, -epoch(day))) AS ld, (max(ms) / 60000.0::DOUBLE) AS minutes FROM d GROUP BY 1)
JOIN (SELECT owner, arg_max(track, (n, -track)) AS top_track, max(n) AS top_plays FROM t GROUP BY 1) USING (owner) LEFT JOIN (SELECT owner, arg_max(artist, (n, -artist)) AS late_artist FROM l GROUP BY 1) USING (owner)""")
def records(plays: DataFrame) -> DataFrame:
    """Loudest day, most played track, late-night companion."""
    p = ALL.plays(plays)
    days = daily(p).groupBy("owner").agg(arg_max(F.col("day"), F.col("ms"), -F.unix_date("day")).alias("d"), F.max("ms").alias("ms"))
    tracks = p.groupBy("owner", "track").agg(F.count(F.lit(1)).alias("n")).groupBy("owner").agg(arg_max(F.col("track"), F.col("n"), -F.col("track")).alias("top_track"), F.max("n").alias("top_plays"))
    late = p.filter("hour >= 23 or hour < 4").groupBy("owner", "artist").agg(F.count(F.lit(1)).alias("n")).groupBy("owner").agg(arg_max(F.col("artist"), F.col("n"), -F.col("artist")).alias("late_artist"))
    return days.join(tracks, "owner").join(late, "owner", "left").select("owner", text(F.col("d")).alias("loudest_day"), minutes(F.col("ms")).alias("minutes"), "top_track", "top_plays", "late_artist")


@C.query("f_day_detail", "plays", sql="""t AS (SELECT owner, count(*) FILTER (day = DATE '1998-05-20') AS plays, coalesce(sum(ms) FILTER (day = DATE '1998-05-20'), 0)::BIGINT AS ms, max(day) FILTER (day < DATE '1998-05-20') AS p, min(day) FILTER (day > DATE '1998-05-20') AS n FROM plays WHERE attended GROUP BY owner)
SELECT owner, plays, ms, strftime(p, '%Y-%m-%d') AS previous_day, strftime(n, '%Y-%m-%d') AS next_day FROM t""")
def day_detail(plays: DataFrame, day: str = "1998-05-20") -> DataFrame:
    """One day's totals, and the active days around it."""
    d, at = F.col("day"), F.lit(day).cast("date")
    return ALL.plays(plays).groupBy("owner").agg(F.count_if(d == at).alias("plays"), F.coalesce(F.sum(F.when(d == at, F.col("ms"))), F.lit(0)).alias("ms"), text(F.max(F.when(d < at, d))).alias("previous_day"), text(F.min(F.when(d > at, d))).alias("next_day"))


@C.query("f_month_detail", "plays", sql=f"""f AS (SELECT owner, track, min(day) AS first_day FROM plays WHERE attended GROUP BY ALL)
SELECT owner, strftime(date_trunc('month', day), '%Y-%m-%d') AS month, count(*) AS plays, (sum(ms) / {H}) AS hours, count(DISTINCT track) FILTER (date_trunc('month', first_day) = date_trunc('month', day)) AS new_tracks, count(DISTINCT artist) AS artists
FROM plays JOIN f USING (owner, track) WHERE attended GROUP BY 1, 2""")
def month_detail(plays: DataFrame) -> DataFrame:
    """Each month's totals, first plays among them."""
    p = ALL.plays(plays).withColumn("first_day", F.min("day").over(Window.partitionBy("owner", "track")))
    new = F.when(month(F.col("first_day")) == month(F.col("day")), F.col("track"))
    return p.groupBy("owner", text(month(F.col("day"))).alias("month")).agg(F.count(F.lit(1)).alias("plays"), hours(F.sum("ms")).alias("hours"), F.count_distinct(new).alias("new_tracks"), F.count_distinct("artist").alias("artists"))


@C.query("f_exit_points", "plays", sql="SELECT track, ((ms // 10000) * 10)::BIGINT AS second, count(*) AS skips FROM plays WHERE attended AND skipped GROUP BY ALL")
def exit_points(plays: DataFrame) -> DataFrame:
    """Where tracks are skipped, in steps of ten seconds."""
    return ALL.plays(plays).filter("skipped").groupBy("track", (F.floor(F.col("ms") / 10_000) * 10).cast("long").alias("second")).agg(F.count(F.lit(1)).alias("skips"))


@C.query("f_early_exits", "plays", sql="SELECT track, count(*) AS skips, avg(ms) / 1000 AS mean_s, round(stddev_samp(ms) / 1000, 4) AS sd_s FROM plays WHERE skipped AND ms > 5000 GROUP BY track HAVING count(*) >= 6 AND stddev_samp(ms) < 120000")
def early_exits(plays: DataFrame) -> DataFrame:
    """Tracks that are always left at about the same point."""
    g = plays.filter("skipped and ms > 5000").groupBy("track").agg(F.count(F.lit(1)).alias("skips"), (F.avg("ms") / 1000).alias("mean_s"), F.stddev_samp("ms").alias("sd"))
    return g.filter("skips >= 6 and sd < 120000").select("track", "skips", "mean_s", F.round(F.col("sd") / 1000, 4).alias("sd_s"))


@C.query("f_search", "plays", "tracks", sql="SELECT track, name, count(play_id) AS plays FROM tracks LEFT JOIN plays USING (track) WHERE name ILIKE '%red%' GROUP BY track, name")
def search(plays: DataFrame, tracks: DataFrame, term: str = "red") -> DataFrame:
    """Tracks whose name has the term, whatever its case."""
    found = tracks.filter(F.col("name").ilike(f"%{term}%")).select("track", "name")
    return found.join(plays.select("track", "play_id"), "track", "left").groupBy("track", "name").agg(F.count("play_id").alias("plays"))


@C.query("f_years", "plays", sql="SELECT DISTINCT owner, year(day)::INTEGER AS year FROM plays")
def years(plays: DataFrame) -> DataFrame:
    return plays.select("owner", F.year("day").alias("year")).distinct()


@C.query("f_weekly_series", "plays", sql=f"""w AS (SELECT owner, date_trunc('week', day)::DATE AS wk, sum(ms) AS ms FROM plays WHERE attended GROUP BY ALL), b AS (SELECT owner, min(wk) AS a, max(wk) AS z FROM w GROUP BY 1), g AS (SELECT owner, unnest(generate_series(a, z, INTERVAL 7 DAY))::DATE AS wk FROM b)
SELECT owner, strftime(wk, '%Y-%m-%d') AS week, (coalesce(ms, 0) / {H}) AS hours, avg(coalesce(ms, 0)) OVER (PARTITION BY owner ORDER BY wk ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) / {H} AS mean12 FROM g LEFT JOIN w USING (owner, wk)""")
def weekly_series(plays: DataFrame) -> DataFrame:
    """Every week from first to last, silent ones with 0, and the mean of twelve."""
    w = ALL.plays(plays).groupBy("owner", week(F.col("day")).alias("wk")).agg(F.sum("ms").alias("ms"))
    grid = w.groupBy("owner").agg(F.min("wk").alias("a"), F.max("wk").alias("z")).select("owner", F.explode(F.sequence("a", "z", F.expr("interval 7 days"))).alias("wk"))
    h = grid.join(w, ["owner", "wk"], "left").withColumn("ms", F.coalesce("ms", F.lit(0)))
    recent = Window.partitionBy("owner").orderBy("wk").rowsBetween(-11, 0)
    return h.select("owner", text(F.col("wk")).alias("week"), hours(F.col("ms")).alias("hours"), hours(F.avg("ms").over(recent)).alias("mean12"))


@C.query("f_album_detail", "plays", "tracks", sql=f"""n AS (SELECT owner, artist, album, count(*) AS plays, count(DISTINCT track) AS tracks, sum(ms) AS ms FROM plays JOIN tracks USING (track) WHERE attended GROUP BY ALL)
SELECT owner, artist, album, plays, tracks, round(ms / sum(ms) OVER (PARTITION BY owner, artist), 6) AS artist_share FROM n QUALIFY plays >= 3""")
def album_detail(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """An album's part of what is heard of its artist (F8)."""
    n = ALL.plays(plays).join(tracks.select("track", "album"), "track").groupBy("owner", "artist", "album").agg(F.count(F.lit(1)).alias("plays"), F.count_distinct("track").alias("tracks"), F.sum("ms").alias("ms"))
    return n.withColumn("artist_share", F.round(F.col("ms") / F.sum("ms").over(Window.partitionBy("owner", "artist")), 6)).filter("plays >= 3").drop("ms")


@C.query("f_milestones", "plays", sql=f"""p AS (SELECT *, row_number() OVER (PARTITION BY owner, track ORDER BY played_at, play_id) AS tn, row_number() OVER (PARTITION BY owner, artist ORDER BY played_at, play_id) AS an,
    (sum(ms) OVER (PARTITION BY owner, artist ORDER BY played_at, play_id ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM plays WHERE attended)
SELECT 'track_plays' AS kind, owner, track AS subject, tn AS value, strftime(day, '%Y-%m-%d') AS day FROM p WHERE tn IN (3, 5, 10)
UNION ALL SELECT 'artist_plays', owner, artist, an, strftime(day, '%Y-%m-%d') FROM p WHERE an IN (10, 25, 50)
UNION ALL SELECT 'artist_hours', owner, artist, h, strftime(min(day), '%Y-%m-%d') FROM p JOIN (VALUES (1), (5), (10)) t(h) ON run >= h * 3600000 GROUP BY owner, artist, h
UNION ALL SELECT 'anniversary', owner, artist, n, strftime(f + to_years(n::INTEGER), '%Y-%m-%d') FROM (SELECT owner, artist, min(day) AS f FROM p GROUP BY ALL HAVING count(*) >= 20 AND max(day) >= DATE '{TODAY}' - 180), range(1, 15) r(n) WHERE f + to_years(n::INTEGER) <= DATE '{TODAY}'""")
def milestones(plays: DataFrame, today: str = TODAY) -> DataFrame:
    """Round numbers of plays and hours, and anniversaries of first plays."""
    by = lambda *k: Window.partitionBy("owner", *k).orderBy("played_at", "play_id")
    p = ALL.plays(plays).withColumns({"tn": F.row_number().over(by("track")), "an": F.row_number().over(by("artist")), "run": F.sum("ms").over(by("artist").rowsBetween(Window.unboundedPreceding, 0))})
    row = lambda df, kind, subject, value, day: df.select(F.lit(kind).alias("kind"), "owner", subject.alias("subject"), value.cast("long").alias("value"), text(day).alias("day"))
    nth = row(p.filter(F.col("tn").isin(3, 5, 10)), "track_plays", F.col("track"), F.col("tn"), F.col("day"))
    nth = nth.unionByName(row(p.filter(F.col("an").isin(10, 25, 50)), "artist_plays", F.col("artist"), F.col("an"), F.col("day")))
    crossed = p.withColumn("h", F.explode(F.filter(F.array(F.lit(1), F.lit(5), F.lit(10)), lambda h: F.col("run") >= h * 3_600_000))).groupBy("owner", "artist", "h").agg(F.min("day").alias("d"))
    first = p.groupBy("owner", "artist").agg(F.min("day").alias("f"), F.count(F.lit(1)).alias("n"), F.max("day").alias("l")).filter((F.col("n") >= 20) & (F.col("l") >= F.date_sub(F.lit(today).cast("date"), 180)))
    years_ = first.withColumn("y", F.explode(F.sequence(F.lit(1), F.lit(14)))).withColumn("d", F.add_months("f", F.col("y") * 12)).filter(F.col("d") <= F.lit(today).cast("date"))
    return nth.unionByName(row(crossed, "artist_hours", F.col("artist"), F.col("h"), F.col("d"))).unionByName(row(years_, "anniversary", F.col("artist"), F.col("y"), F.col("d")))


@C.query("f_record_days", "plays", sql="d AS (SELECT owner, day, sum(ms)::BIGINT AS ms FROM plays WHERE attended GROUP BY ALL), r AS (SELECT *, max(ms) OVER (PARTITION BY owner ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d) SELECT owner, strftime(day, '%Y-%m-%d') AS day, ms FROM r WHERE before IS NULL OR ms > before")
def record_days(plays: DataFrame) -> DataFrame:
    w = Window.partitionBy("owner").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return daily(ALL.plays(plays)).withColumn("before", F.max("ms").over(w)).filter("before is null or ms > before").select("owner", text(F.col("day")).alias("day"), "ms")


@C.query("f_streak_marks", "plays", sql="d AS (SELECT DISTINCT owner, day FROM plays WHERE attended), g AS (SELECT owner, day, day - (row_number() OVER (PARTITION BY owner ORDER BY day))::INTEGER AS grp FROM d), n AS (SELECT owner, day, row_number() OVER (PARTITION BY owner, grp ORDER BY day) AS length FROM g) SELECT owner, strftime(day, '%Y-%m-%d') AS day, length::INTEGER AS length FROM n WHERE length IN (5, 10, 30)")
def streak_marks(plays: DataFrame) -> DataFrame:
    """The days on which a run reaches a round length."""
    one = ALL.plays(plays).select("owner", "day").distinct()
    grp = one.withColumn("grp", F.date_sub("day", F.row_number().over(Window.partitionBy("owner").orderBy("day"))))
    return grp.withColumn("length", F.row_number().over(Window.partitionBy("owner", "grp").orderBy("day"))).filter(F.col("length").isin(5, 10, 30)).select("owner", text(F.col("day")).alias("day"), "length")


@C.query("f_artist_skip_ratio", "plays", sql="SELECT owner, artist, count(*) FILTER (skipped)::DOUBLE / nullif(count(*) FILTER (NOT skipped), 0) AS skipped_to_heard FROM plays WHERE attended GROUP BY ALL")
def artist_skip_ratio(plays: DataFrame) -> DataFrame:
    return ALL.plays(plays).groupBy("owner", "artist").agg(ratio(F.count_if("skipped"), F.count_if(~F.col("skipped"))).alias("skipped_to_heard"))
