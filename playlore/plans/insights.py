"""Patterns over time: late nights, obsessions, lifecycles, seasons, eras, threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlore.functions.compat import arg_max, hours, month, ratio, share, text, week
from playlore.functions.config import EraParams, Lens
from playlore.operators import vectors
from playlore.operators.islands import day_runs, last_known
from playlore.operators.joins import top_by
from playlore.plans.base import Catalogue

C = Catalogue()
QUERIES, ORACLE = C.queries, C.oracle
ALL = Lens()
TODAY = "2001-06-01"
H = "3600000.0::DOUBLE"
_LATE = "(hour >= 23 OR hour < 4)"


def late():
    return (F.col("hour") >= 23) | (F.col("hour") < 4)


def _today(s: str = TODAY):
    return F.lit(s).cast("date")


@C.query("f_late_canon", "plays", sql=f"""b AS (SELECT owner, avg({_LATE}::INT) AS base FROM plays WHERE attended GROUP BY 1)
SELECT owner, artist, count(*) FILTER ({_LATE}) AS late_plays, avg({_LATE}::INT) AS late_share, avg({_LATE}::INT) / nullif(any_value(base), 0) AS lift FROM plays JOIN b USING (owner) WHERE attended GROUP BY ALL HAVING late_plays >= 8 AND count(*) >= 20""")
def late_canon(plays: DataFrame) -> DataFrame:
    """Artists of the small hours (F15): their late share against the listener's."""
    p = ALL.plays(plays)
    base = p.groupBy("owner").agg(share(late()).alias("base"))
    a = p.groupBy("owner", "artist").agg(F.count_if(late()).alias("late_plays"), share(late()).alias("late_share"), F.count(F.lit(1)).alias("n")).filter("late_plays >= 8 and n >= 20")
    return a.join(base, "owner").select("owner", "artist", "late_plays", "late_share", ratio(F.col("late_share"), F.col("base")).alias("lift"))


_WEEKS = """w AS (SELECT owner, artist, date_trunc('week', day)::DATE AS wk, count(*) AS c FROM plays WHERE attended GROUP BY ALL),
b AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY owner, artist ORDER BY wk RANGE BETWEEN INTERVAL 91 DAY PRECEDING AND INTERVAL 7 DAY PRECEDING), 0)::BIGINT AS prior FROM w)"""


def artist_weeks(plays: DataFrame) -> DataFrame:
    """(owner, artist, wk, c, prior): plays of a week, and of the thirteen before it."""
    w = plays.groupBy("owner", "artist", week(F.col("day")).alias("wk")).agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("owner", "artist").orderBy(F.unix_date("wk")).rangeBetween(-91, -7)
    return w.withColumn("prior", F.coalesce(F.sum("c").over(before), F.lit(0)))


@C.query("f_obsessions", "plays", sql=_WEEKS + """, hits AS (SELECT * FROM b WHERE c >= 3 AND c * 13 >= 5 * prior), best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY owner, artist ORDER BY c DESC, wk) = 1),
d AS (SELECT h.owner, h.artist, min(x.wk) FILTER (x.wk > h.wk AND x.c * 2 < h.c) AS half FROM best h JOIN w x USING (owner, artist) GROUP BY ALL),
t AS (SELECT p.owner, p.artist, track, count(*) AS n FROM plays p JOIN best h ON h.owner = p.owner AND h.artist = p.artist AND date_trunc('week', p.day)::DATE = h.wk WHERE attended GROUP BY ALL), pk AS (SELECT owner, artist, arg_max(track, (n, -track)) AS peak_track FROM t GROUP BY ALL)
SELECT owner, artist, strftime(wk, '%Y-%m-%d') AS week, c AS plays, prior / 13.0::DOUBLE AS expected, (half - wk)::INTEGER AS half_life_days, peak_track FROM best JOIN d USING (owner, artist) JOIN pk USING (owner, artist)""")
def obsessions(plays: DataFrame, least: int = 3, factor: int = 5) -> DataFrame:
    """Each artist's strongest week far above its usual, how long it took to halve, and its song (F16)."""
    p = ALL.plays(plays)
    w = artist_weeks(p)
    best = top_by(w.filter((F.col("c") >= least) & (F.col("c") * 13 >= factor * F.col("prior"))), ["owner", "artist"], 1, F.desc("c"), F.col("wk"))
    later = w.select("owner", "artist", F.col("wk").alias("later"), F.col("c").alias("later_c"))
    half = best.join(later, ["owner", "artist"]).groupBy("owner", "artist", "wk", "c", "prior").agg(F.min(F.when((F.col("later") > F.col("wk")) & (F.col("later_c") * 2 < F.col("c")), F.col("later"))).alias("half"))
    songs = p.withColumn("wk", week(F.col("day"))).join(best.select("owner", "artist", "wk"), ["owner", "artist", "wk"], "left_semi").groupBy("owner", "artist", "track").agg(F.count(F.lit(1)).alias("n"))
    peak = songs.groupBy("owner", "artist").agg(arg_max(F.col("track"), F.col("n"), -F.col("track")).alias("peak_track"))
    return half.join(peak, ["owner", "artist"]).select("owner", "artist", text(F.col("wk")).alias("week"), F.col("c").alias("plays"), (F.col("prior") / F.lit(13.0)).alias("expected"), F.datediff("half", "wk").alias("half_life_days"), "peak_track")


@C.query("f_retention", "plays", sql=f"""f AS (SELECT owner, artist, min(day) AS first_day, max(day) AS last_day, count(*) AS plays FROM plays WHERE attended GROUP BY ALL HAVING count(*) >= 5)
SELECT owner, artist, plays, (DATE '{TODAY}' - last_day)::INTEGER AS days_silent, DATE '{TODAY}' - last_day < 365 AS still FROM f WHERE year(first_day) = 1995""")
def retention(plays: DataFrame, year: int = 1995) -> DataFrame:
    """What became of a year's discoveries."""
    f = ALL.plays(plays).groupBy("owner", "artist").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("plays")).filter((F.col("plays") >= 5) & (F.year("first_day") == year))
    silent = F.datediff(_today(), F.col("last_day"))
    return f.select("owner", "artist", "plays", silent.alias("days_silent"), (silent < 365).alias("still"))


@C.query("f_lifecycle", "plays", sql=f"""a AS (SELECT owner, artist, count(*) AS plays, coalesce(sum(ms) FILTER (day >= DATE '{TODAY}' - 90), 0)::BIGINT AS recent, coalesce(sum(ms) FILTER (day < DATE '{TODAY}' - 90 AND day >= DATE '{TODAY}' - 180), 0)::BIGINT AS prior, max(day) AS last_day,
    max(day) FILTER (day < DATE '{TODAY}' - 30) AS before_month, min(day) FILTER (day >= DATE '{TODAY}' - 30) AS in_month FROM plays WHERE attended AND day < DATE '{TODAY}' GROUP BY ALL HAVING count(*) >= 20)
SELECT owner, artist, plays, recent / {H} AS recent_hours, prior / {H} AS prior_hours, CASE WHEN in_month - before_month >= 180 THEN 'returned' WHEN last_day < DATE '{TODAY}' - 180 THEN 'dormant'
  WHEN recent > prior * 1.5 AND recent >= 1800000 THEN 'rising' WHEN recent < prior * 0.5 AND prior >= 3600000 THEN 'fading' ELSE 'steady' END AS status FROM a""")
def lifecycle(plays: DataFrame, today: str = TODAY) -> DataFrame:
    """Rising, fading, returned, dormant or steady, by the last two quarters."""
    t, d, ms = _today(today), F.col("day"), F.col("ms")
    since = lambda n: d >= F.date_sub(t, n)
    a = ALL.plays(plays).filter(d < t).groupBy("owner", "artist").agg(
        F.count(F.lit(1)).alias("plays"), F.coalesce(F.sum(F.when(since(90), ms)), F.lit(0)).alias("recent"), F.coalesce(F.sum(F.when(~since(90) & since(180), ms)), F.lit(0)).alias("prior"),
        F.max("day").alias("last_day"), F.max(F.when(~since(30), d)).alias("before_month"), F.min(F.when(since(30), d)).alias("in_month"),
    ).filter("plays >= 20")
    status = (
        F.when(F.datediff("in_month", "before_month") >= 180, "returned")
        .when(F.col("last_day") < F.date_sub(t, 180), "dormant")
        .when((F.col("recent") > F.col("prior") * 1.5) & (F.col("recent") >= 1_800_000), "rising")
        .when((F.col("recent") < F.col("prior") * 0.5) & (F.col("prior") >= 3_600_000), "fading")
        .otherwise("steady")
    )
    return a.select("owner", "artist", "plays", hours(F.col("recent")).alias("recent_hours"), hours(F.col("prior")).alias("prior_hours"), status.alias("status"))


@C.query("f_cant_quit", "plays", sql="SELECT owner, track, count(*) AS plays, avg(skipped::INT) AS skip_rate FROM plays WHERE attended GROUP BY ALL HAVING count(*) >= 4 AND avg(skipped::INT) >= 0.6")
def cant_quit(plays: DataFrame) -> DataFrame:
    """Tracks skipped again and again, and played again."""
    return ALL.plays(plays).groupBy("owner", "track").agg(F.count(F.lit(1)).alias("plays"), share(F.col("skipped")).alias("skip_rate")).filter("plays >= 4 and skip_rate >= 0.6")


def season():
    return F.element_at(F.array(*map(F.lit, ("winter", "winter", "spring", "spring", "spring", "summer", "summer", "summer", "autumn", "autumn", "autumn", "winter"))), F.month("day"))


@C.query("f_seasonality", "plays", sql="""q AS (SELECT owner, artist, CASE WHEN month(day) IN (12, 1, 2) THEN 'winter' WHEN month(day) <= 5 THEN 'spring' WHEN month(day) <= 8 THEN 'summer' ELSE 'autumn' END AS season, count(*) AS c, count(DISTINCT year(day)) AS years FROM plays WHERE attended GROUP BY ALL),
t AS (SELECT owner, artist, sum(c) AS n FROM q GROUP BY ALL), s AS (SELECT owner, season, sum(c) AS sn, sum(sum(c)) OVER (PARTITION BY owner) AS an FROM q GROUP BY owner, season)
SELECT owner, artist, season, c AS plays, years, round((c * an)::DOUBLE / (n * sn)::DOUBLE, 6) AS lift FROM q JOIN t USING (owner, artist) JOIN s USING (owner, season) WHERE n >= 20 AND c >= 10 AND years >= 2 AND c * an >= 1.5 * n * sn""")
def seasonality(plays: DataFrame) -> DataFrame:
    """Artists that belong to a season."""
    p = ALL.plays(plays)
    q = p.groupBy("owner", "artist", season().alias("season")).agg(F.count(F.lit(1)).alias("plays"), F.count_distinct(F.year("day")).alias("years"))
    w = q.withColumns({"n": F.sum("plays").over(Window.partitionBy("owner", "artist")), "sn": F.sum("plays").over(Window.partitionBy("owner", "season")), "an": F.sum("plays").over(Window.partitionBy("owner"))})
    up, down = F.col("plays") * F.col("an"), F.col("n") * F.col("sn")
    return w.filter((F.col("n") >= 20) & (F.col("plays") >= 10) & (F.col("years") >= 2) & (up >= 1.5 * down)).select("owner", "artist", "season", "plays", "years", F.round(up.cast("double") / down, 6).alias("lift"))


@C.query("f_personas", "plays", sql=f"SELECT owner, isodow(day) >= 6 AS weekend, count(*) AS plays, sum(ms) / {H} AS hours, avg(skipped::INT) AS skip_rate, count(DISTINCT artist) AS artists, (median(hour))::DOUBLE AS median_hour FROM plays WHERE attended GROUP BY ALL")
def personas(plays: DataFrame) -> DataFrame:
    """Weekdays against weekends."""
    return ALL.plays(plays).groupBy("owner", (F.weekday("day") >= 5).alias("weekend")).agg(
        F.count(F.lit(1)).alias("plays"), hours(F.sum("ms")).alias("hours"), share(F.col("skipped")).alias("skip_rate"), F.count_distinct("artist").alias("artists"), F.median("hour").alias("median_hour")
    )


def era_vectors(plays: DataFrame, p: EraParams) -> DataFrame:
    """(owner, wk, artist, ms, value): each week's leading artists with their shares of the week."""
    m = plays.groupBy("owner", week(F.col("day")).alias("wk"), "artist").agg(F.sum("ms").alias("ms"))
    led = m.withColumn("value", F.col("ms") / F.sum("ms").over(Window.partitionBy("owner", "wk")))
    return top_by(led, ["owner", "wk"], p.top_artists, F.desc("ms"), F.col("artist")).drop("rank")


def era_weeks(plays: DataFrame, p: EraParams) -> DataFrame:
    """(owner, wk, cos, era): short eras next to each other are merged if together long enough, else absorbed by the era before, or after."""
    sim = vectors.cosine_chain(era_vectors(plays, p), "owner", "wk", "artist")
    w = Window.partitionBy("owner").orderBy("wk")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    breaks = F.col("previous").isNull() | (F.col("cos") < p.threshold) | (F.datediff("wk", "previous") > p.gap_weeks * 7)
    raw = sim.withColumn("era0", F.sum(F.when(breaks, 1).otherwise(0)).over(upto))
    sized = raw.withColumn("short", F.count(F.lit(1)).over(Window.partitionBy("owner", "era0")) < p.min_weeks)
    starts = sized.withColumn("run", F.sum(F.when(F.col("short") & ~F.coalesce(F.lag("short").over(w), F.lit(False)), 1).otherwise(0)).over(upto))
    by_run = Window.partitionBy("owner", "run", "short")
    merged = F.when(~F.col("short"), F.col("era0")).when(F.count(F.lit(1)).over(by_run) >= p.min_weeks, F.min("era0").over(by_run))
    named = starts.withColumn("era1", merged)
    after = F.first("era1", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return named.select("owner", "wk", "cos", F.coalesce(last_known(F.col("era1"), ["owner"], "wk"), after, F.lit(0)).alias("era"))


_P = EraParams(threshold=0.25, gap_weeks=6, min_weeks=3, top_artists=10)
_ERA = f"""m AS (SELECT owner, date_trunc('week', day)::DATE AS wk, artist, sum(ms)::BIGINT AS ms FROM plays WHERE attended GROUP BY ALL),
v AS (SELECT *, ms / sum(ms) OVER (PARTITION BY owner, wk) AS x FROM m QUALIFY row_number() OVER (PARTITION BY owner, wk ORDER BY ms DESC, artist) <= {_P.top_artists}),
nr AS (SELECT owner, wk, sqrt(sum(x * x)) AS n, lag(wk) OVER (PARTITION BY owner ORDER BY wk) AS prev FROM v GROUP BY owner, wk),
dt AS (SELECT p.owner, p.wk, sum(a.x * b.x) AS d FROM nr p JOIN v a ON a.owner = p.owner AND a.wk = p.wk JOIN v b ON b.owner = p.owner AND b.wk = p.prev AND b.artist = a.artist GROUP BY ALL),
sim AS (SELECT p.owner, p.wk, p.prev, CASE WHEN p.prev IS NOT NULL THEN round(coalesce(d / (p.n * q.n), 0), 6) END AS cos FROM nr p LEFT JOIN nr q ON q.owner = p.owner AND q.wk = p.prev LEFT JOIN dt ON dt.owner = p.owner AND dt.wk = p.wk),
raw AS (SELECT *, sum(CASE WHEN prev IS NULL OR cos < {_P.threshold} OR wk - prev > {_P.gap_weeks * 7} THEN 1 ELSE 0 END) OVER (PARTITION BY owner ORDER BY wk ROWS UNBOUNDED PRECEDING) AS era0 FROM sim),
sz AS (SELECT *, count(*) OVER (PARTITION BY owner, era0) < {_P.min_weeks} AS short FROM raw),
st AS (SELECT *, short AND NOT coalesce(lag(short) OVER (PARTITION BY owner ORDER BY wk), false) AS opens FROM sz),
rn AS (SELECT *, sum(opens::INT) OVER (PARTITION BY owner ORDER BY wk ROWS UNBOUNDED PRECEDING) AS run FROM st),
nm AS (SELECT *, CASE WHEN NOT short THEN era0 WHEN count(*) OVER (PARTITION BY owner, run, short) >= {_P.min_weeks} THEN min(era0) OVER (PARTITION BY owner, run, short) END AS era1 FROM rn),
ew AS (SELECT owner, wk, cos, coalesce(last_value(era1 IGNORE NULLS) OVER (PARTITION BY owner ORDER BY wk ROWS UNBOUNDED PRECEDING), first_value(era1 IGNORE NULLS) OVER (PARTITION BY owner ORDER BY wk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)::BIGINT AS era FROM nm)"""


@C.query("f_era_diagnostic", "plays", sql=_ERA + " SELECT owner, strftime(wk, '%Y-%m-%d') AS week, cos, era FROM ew")
def era_diagnostic(plays: DataFrame) -> DataFrame:
    """Each week's likeness to the week before, and its era."""
    return era_weeks(ALL.plays(plays), _P).select("owner", text(F.col("wk")).alias("week"), "cos", "era")


@C.query("f_eras", "plays", sql=_ERA + f""", a AS (SELECT owner, era, artist, sum(ms)::BIGINT AS ms FROM ew JOIN v USING (owner, wk) GROUP BY ALL), top AS (SELECT owner, era, array_to_string(list(artist ORDER BY ms DESC, artist)[1:3], ',') AS top_artists FROM a GROUP BY ALL),
sp AS (SELECT owner, era, min(wk) AS s, max(wk) + 7 AS e, count(*) AS weeks FROM ew GROUP BY ALL), bh AS (SELECT sp.owner, era, sum(ms) / {H} AS hours, avg(skipped::INT) AS skip_rate, avg({_LATE}::INT) AS late_share FROM sp JOIN plays p ON p.owner = sp.owner AND p.day >= s AND p.day < e WHERE attended GROUP BY ALL)
SELECT owner, era, strftime(s, '%Y-%m-%d') AS start, weeks, hours, skip_rate, late_share, top_artists FROM sp JOIN bh USING (owner, era) JOIN top USING (owner, era)""")
def eras(plays: DataFrame) -> DataFrame:
    """Stretches of weeks with much the same artists."""
    p = ALL.plays(plays)
    weeks = era_weeks(p, _P)
    of_artist = era_vectors(p, _P).join(weeks.select("owner", "wk", "era"), ["owner", "wk"]).groupBy("owner", "era", "artist").agg(F.sum("ms").alias("ms"))
    top = of_artist.groupBy("owner", "era").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("ms")).alias("m"), "artist"))), 1, 3).alias("t"))
    span = weeks.groupBy("owner", "era").agg(F.min("wk").alias("s"), F.date_add(F.max("wk"), 7).alias("e"), F.count(F.lit(1)).alias("weeks"))
    # an era covers whole weeks, so its plays are found by an equal join on the week, given weeks without plays between
    grid = span.select("owner", "era", F.explode(F.sequence("s", F.date_sub("e", 7), F.expr("interval 7 days"))).alias("wk"))
    heard = p.withColumn("wk", week(F.col("day"))).join(grid, ["owner", "wk"]).groupBy("owner", "era").agg(hours(F.sum("ms")).alias("hours"), share(F.col("skipped")).alias("skip_rate"), share(late()).alias("late_share"))
    return span.join(heard, ["owner", "era"]).join(top, ["owner", "era"]).select("owner", "era", text(F.col("s")).alias("start"), "weeks", "hours", "skip_rate", "late_share", F.array_join(F.transform("t", lambda x: x["artist"].cast("string")), ",").alias("top_artists"))


@C.query("f_taste_drift", "plays", sql="""m AS (SELECT year(day)::INTEGER AS y, artist, sum(ms)::BIGINT AS ms FROM plays WHERE attended GROUP BY ALL), v AS (SELECT y, artist, ms / sum(ms) OVER (PARTITION BY y) AS x FROM m), n AS (SELECT y, sqrt(sum(x * x)) AS n FROM v GROUP BY y)
SELECT a.y AS a, b.y AS b, round(sum(a.x * b.x) / (any_value(na.n) * any_value(nb.n)), 6) AS cos FROM v a JOIN v b ON a.artist = b.artist AND a.y < b.y JOIN n na ON na.y = a.y JOIN n nb ON nb.y = b.y GROUP BY ALL""")
def taste_drift(plays: DataFrame) -> DataFrame:
    """Cosines of all years' artist shares."""
    m = ALL.plays(plays).groupBy(F.year("day").alias("y"), "artist").agg(F.sum("ms").alias("ms"))
    return vectors.cosine_matrix(m.withColumn("value", F.col("ms") / F.sum("ms").over(Window.partitionBy("y"))), "y", "artist")


@C.query("f_comebacks", "plays", sql=f"""f AS (SELECT owner, track, day, lag(day) OVER (PARTITION BY owner, track ORDER BY played_at, play_id) AS prev, count(*) OVER (PARTITION BY owner, track) AS plays FROM plays WHERE attended)
SELECT owner, track, strftime(day, '%Y-%m-%d') AS day, (day - prev)::INTEGER AS days_silent, plays FROM f WHERE day - prev >= 180 AND plays >= 3 QUALIFY row_number() OVER (PARTITION BY owner, track ORDER BY day DESC, prev DESC) = 1""")
def comebacks(plays: DataFrame) -> DataFrame:
    """Tracks heard again after half a year."""
    w = Window.partitionBy("owner", "track")
    f = ALL.plays(plays).withColumns({"prev": F.lag("day").over(w.orderBy("played_at", "play_id")), "plays": F.count(F.lit(1)).over(w)})
    hit = f.filter((F.datediff("day", "prev") >= 180) & (F.col("plays") >= 3))
    return top_by(hit, ["owner", "track"], 1, F.desc("day"), F.desc("prev")).select("owner", "track", text(F.col("day")).alias("day"), F.datediff("day", "prev").alias("days_silent"), "plays")


@C.query("f_earworms", "plays", sql="""a AS (SELECT owner, track, count(*) AS plays, count(DISTINCT date_trunc('month', day)) AS months, count(DISTINCT year(day)) AS years, avg(skipped::INT) AS sr, (max(day) - min(day))::INTEGER AS span FROM plays WHERE attended GROUP BY ALL)
SELECT owner, track, plays, months, years, span, round(pow(least(months, 12) / 12.0::DOUBLE, 0.7) * (1 + 0.15 * least(years, 4)) * (1 - sr) * sqrt(least(plays, 25) / 25.0::DOUBLE) * (0.6 + 0.4 * least(1.0::DOUBLE, months / greatest(1.0::DOUBLE, span / 30.0::DOUBLE))), 6) AS score FROM a WHERE plays >= 4 AND months >= 3 AND span >= 90 AND sr <= 0.25""")
def earworms(plays: DataFrame) -> DataFrame:
    """Songs that keep coming back, alone and unskipped."""
    a = ALL.plays(plays).groupBy("owner", "track").agg(F.count(F.lit(1)).alias("plays"), F.count_distinct(month(F.col("day"))).alias("months"), F.count_distinct(F.year("day")).alias("years"), share(F.col("skipped")).alias("sr"), F.datediff(F.max("day"), F.min("day")).alias("span"))
    dense = F.least(F.lit(1.0), F.col("months") / F.greatest(F.lit(1.0), F.col("span") / F.lit(30.0)))
    score = F.pow(F.least(F.col("months"), F.lit(12)) / F.lit(12.0), F.lit(0.7)) * (1 + 0.15 * F.least(F.col("years"), F.lit(4))) * (1 - F.col("sr")) * F.sqrt(F.least(F.col("plays"), F.lit(25)) / F.lit(25.0)) * (0.6 + 0.4 * dense)
    return a.filter("plays >= 4 and months >= 3 and span >= 90 and sr <= 0.25").select("owner", "track", "plays", "months", "years", "span", F.round(score, 6).alias("score"))


@C.query("f_tag_threads", "plays", "tracks", sql="""w AS (SELECT owner, date_trunc('week', day)::DATE AS wk, tag, sum(ms)::BIGINT AS ms FROM plays JOIN tracks USING (track) WHERE attended GROUP BY ALL), s AS (SELECT *, ms / sum(ms) OVER (PARTITION BY owner, wk) AS share FROM w),
r AS (SELECT owner, tag, wk, share, wk - 7 * (row_number() OVER (PARTITION BY owner, tag ORDER BY wk))::INTEGER AS g FROM s WHERE share >= 0.2)
SELECT owner, tag, strftime(min(wk), '%Y-%m-%d') AS start, count(*) AS weeks, round(avg(share), 6) AS mean_share FROM r GROUP BY owner, tag, g HAVING count(*) >= 3""")
def tag_threads(plays: DataFrame, tracks: DataFrame, floor: float = 0.2, least: int = 3) -> DataFrame:
    """Runs of weeks in which a tag holds a share."""
    w = ALL.plays(plays).join(tracks.select("track", "tag"), "track").groupBy("owner", week(F.col("day")).alias("wk"), "tag").agg(F.sum("ms").alias("ms"))
    s = w.withColumn("share", F.col("ms") / F.sum("ms").over(Window.partitionBy("owner", "wk"))).filter(F.col("share") >= floor)
    run = s.withColumn("g", F.date_sub("wk", (7 * F.row_number().over(Window.partitionBy("owner", "tag").orderBy("wk"))).cast("int")))
    return run.groupBy("owner", "tag", "g").agg(F.min("wk").alias("s"), F.count(F.lit(1)).alias("weeks"), F.round(F.avg("share"), 6).alias("mean_share")).filter(F.col("weeks") >= least).select("owner", "tag", text(F.col("s")).alias("start"), "weeks", "mean_share")


@C.query("f_tag_runs", "plays", "tracks", sql="""d AS (SELECT DISTINCT owner, day, tag FROM plays JOIN tracks USING (track) WHERE attended), g AS (SELECT *, day - (row_number() OVER (PARTITION BY owner, tag ORDER BY day))::INTEGER AS k FROM d)
SELECT owner, tag, max(n) AS longest FROM (SELECT owner, tag, k, count(*) AS n FROM g GROUP BY ALL) GROUP BY ALL""")
def tag_runs(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """The most days running with a tag."""
    d = ALL.plays(plays).join(tracks.select("track", "tag"), "track")
    return day_runs(d, ["owner", "tag"]).groupBy("owner", "tag").agg(F.max("length").alias("longest"))


@C.query("f_decade_mix", "plays", "tracks", sql="SELECT year(day)::INTEGER AS year, (release_year // 10 * 10)::INTEGER AS decade, count(*) AS plays, sum(ms)::DOUBLE / sum(sum(ms)) OVER (PARTITION BY year(day)) AS share FROM plays JOIN tracks USING (track) WHERE attended GROUP BY 1, 2, year(day)")
def decade_mix(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """Release decades by year (F48); the decade is a whole number."""
    d = ALL.plays(plays).join(tracks.select("track", "release_year"), "track").groupBy(F.year("day").alias("year"), (F.floor(F.col("release_year") / 10) * 10).cast("int").alias("decade")).agg(F.count(F.lit(1)).alias("plays"), F.sum("ms").alias("ms"))
    return d.select("year", "decade", "plays", (F.col("ms").cast("double") / F.sum("ms").over(Window.partitionBy("year"))).alias("share"))


@C.query("f_half_lives", "plays", sql=f"""m AS (SELECT owner, artist, date_trunc('month', day)::DATE AS mo, sum(ms)::BIGINT AS ms FROM plays WHERE attended GROUP BY ALL), p AS (SELECT owner, artist, arg_max(mo, (ms, -epoch(mo))) AS peak, max(ms) AS top, sum(ms)::BIGINT AS total FROM m GROUP BY ALL HAVING sum(ms) >= 5 * 3600000 / 5),
l AS (SELECT owner, artist, max(mo) FILTER (ms * 2 >= top) AS last_high, max(mo) AS last_mo FROM m JOIN p USING (owner, artist) GROUP BY ALL)
SELECT owner, artist, strftime(peak, '%Y-%m-%d') AS peak_month, total / {H} AS hours, strftime(last_high, '%Y-%m-%d') AS last_high_month, last_high < last_mo AS halved FROM p JOIN l USING (owner, artist)""")
def half_lives(plays: DataFrame) -> DataFrame:
    """When an artist's months fell below half of the best for good (F45): a window maximum in place of an anti-join."""
    m = ALL.plays(plays).groupBy("owner", "artist", month(F.col("day")).alias("mo")).agg(F.sum("ms").alias("ms"))
    top = m.withColumn("top", F.max("ms").over(Window.partitionBy("owner", "artist")))
    a = top.groupBy("owner", "artist").agg(arg_max(F.col("mo"), F.col("ms"), -F.unix_date("mo")).alias("peak"), F.sum("ms").alias("total"), F.max(F.when(F.col("ms") * 2 >= F.col("top"), F.col("mo"))).alias("high"), F.max("mo").alias("last"))
    return a.filter("total >= 3600000").select("owner", "artist", text(F.col("peak")).alias("peak_month"), hours(F.col("total")).alias("hours"), text(F.col("high")).alias("last_high_month"), (F.col("high") < F.col("last")).alias("halved"))


@C.query("f_newness", "plays", sql="""f AS (SELECT owner, artist, min(day) AS f FROM plays WHERE attended GROUP BY ALL), m AS (SELECT owner, date_trunc('month', day)::DATE AS mo, count(*) AS plays, count(DISTINCT artist) FILTER (date_trunc('month', f) = date_trunc('month', day)) AS new_artists, avg((date_trunc('month', f) = date_trunc('month', day))::INT) AS new_share FROM plays JOIN f USING (owner, artist) WHERE attended GROUP BY ALL)
SELECT owner, strftime(mo, '%Y-%m-%d') AS month, plays, new_artists, new_share FROM m""")
def newness(plays: DataFrame) -> DataFrame:
    """How much of a month is new (F154)."""
    p = ALL.plays(plays).withColumn("f", F.min("day").over(Window.partitionBy("owner", "artist")))
    new = month(F.col("f")) == month(F.col("day"))
    return p.groupBy("owner", text(month(F.col("day"))).alias("month")).agg(F.count(F.lit(1)).alias("plays"), F.count_distinct(F.when(new, F.col("artist"))).alias("new_artists"), share(new).alias("new_share"))


@C.query("f_keepers", "plays", sql="""f AS (SELECT owner, track, min(day) AS f, max(day) AS l FROM plays WHERE attended GROUP BY ALL) SELECT owner, year(f)::INTEGER AS year, count(*) AS found, count(*) FILTER (l - f >= 30) AS kept FROM f GROUP BY ALL""")
def keepers(plays: DataFrame) -> DataFrame:
    """Finds that were played a month later still (F155)."""
    f = ALL.plays(plays).groupBy("owner", "track").agg(F.min("day").alias("f"), F.max("day").alias("l"))
    return f.groupBy("owner", F.year("f").alias("year")).agg(F.count(F.lit(1)).alias("found"), F.count_if(F.datediff("l", "f") >= 30).alias("kept"))


@C.query("f_period_review", "plays", sql=f"""p AS (SELECT * FROM plays WHERE attended AND day >= DATE '1999-01-01' AND day < DATE '2000-01-01'), f AS (SELECT owner, artist, min(day) AS f FROM plays WHERE attended GROUP BY ALL),
n AS (SELECT f.owner, count(*) FILTER (l.l - f.f >= 90) AS kept, count(*) FILTER (l.l - f.f < 90) AS dropped FROM f JOIN (SELECT owner, artist, max(day) AS l, count(*) AS c FROM plays WHERE attended GROUP BY ALL) l USING (owner, artist) WHERE f >= DATE '1999-01-01' AND f < DATE '2000-01-01' AND c >= 2 GROUP BY 1)
SELECT p.owner, count(*) AS plays, sum(ms) / {H} AS hours, count(DISTINCT artist) AS artists, avg(skipped::INT) AS skip_rate, coalesce(any_value(kept), 0) AS kept, coalesce(any_value(dropped), 0) AS dropped FROM p LEFT JOIN n USING (owner) GROUP BY p.owner""")
def period_review(plays: DataFrame, year: int = 1999) -> DataFrame:
    """A year in review, with what became of its discoveries."""
    p = Lens(first_year=year, last_year=year).plays(plays)
    a = ALL.plays(plays).groupBy("owner", "artist").agg(F.min("day").alias("f"), F.max("day").alias("l"), F.count(F.lit(1)).alias("c")).filter((F.year("f") == year) & (F.col("c") >= 2))
    long = F.datediff("l", "f") >= 90
    found = a.groupBy("owner").agg(F.count_if(long).alias("kept"), F.count_if(~long).alias("dropped"))
    totals = p.groupBy("owner").agg(F.count(F.lit(1)).alias("plays"), hours(F.sum("ms")).alias("hours"), F.count_distinct("artist").alias("artists"), share(F.col("skipped")).alias("skip_rate"))
    return totals.join(found, "owner", "left").fillna(0, ["kept", "dropped"])


@C.query("f_silences", "plays", sql="""d AS (SELECT owner, day, arg_min(artist, (played_at, play_id)) AS a, arg_max(artist, (played_at, play_id)) AS z FROM plays WHERE attended GROUP BY ALL), g AS (SELECT owner, day, a, lag(day) OVER w AS prev, lag(z) OVER w AS before FROM d WINDOW w AS (PARTITION BY owner ORDER BY day))
SELECT owner, strftime(prev, '%Y-%m-%d') AS since, (day - prev)::INTEGER AS days, before AS artist_before, a AS artist_after FROM g WHERE day - prev > 3""")
def silences(plays: DataFrame) -> DataFrame:
    """Gaps of more than three days, and who was heard before and after."""
    order = F.struct("played_at", "play_id")
    d = ALL.plays(plays).groupBy("owner", "day").agg(F.min_by("artist", order).alias("a"), F.max_by("artist", order).alias("z"))
    w = Window.partitionBy("owner").orderBy("day")
    g = d.withColumns({"prev": F.lag("day").over(w), "before": F.lag("z").over(w)})
    return g.filter(F.datediff("day", "prev") > 3).select("owner", text(F.col("prev")).alias("since"), F.datediff("day", "prev").alias("days"), F.col("before").alias("artist_before"), F.col("a").alias("artist_after"))
