"""Queries over listening sessions. The event stream's plays lie hours apart, so its gaps are hours long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlore.functions.compat import dow0, share, text
from playlore.functions.config import Tuning
from playlore.operators import sessions as op
from playlore.operators.joins import top_by
from playlore.plans.base import Catalogue

C = Catalogue()
QUERIES, ORACLE = C.queries, C.oracle
STREAM = Tuning(gap_min=360, gap_night_min=540, gap_car_min=720, attention_gap_min=600)

_CUT = f"""
o AS (SELECT *, lag(played_at) OVER w AS prev_at, lag(platform) OVER w AS prev_platform, row_number() OVER (PARTITION BY owner, track ORDER BY played_at, play_id) = 1 AS is_first FROM stream_plays WINDOW w AS (PARTITION BY owner ORDER BY played_at, play_id)),
f AS (SELECT *, CASE WHEN prev_at IS NULL THEN 1 WHEN (epoch_us(played_at) - epoch_us(prev_at)) / 1e6 < CASE WHEN lower(prev_platform) LIKE '%auto%' OR lower(prev_platform) LIKE '%car%' THEN {STREAM.gap_car_min * 60}
    WHEN hour(prev_at) >= 23 OR hour(prev_at) < 6 THEN {STREAM.gap_night_min * 60} ELSE {STREAM.gap_min * 60} END THEN 0 ELSE 1 END AS opens FROM o),
n0 AS (SELECT *, (sum(opens) OVER (PARTITION BY owner ORDER BY played_at, play_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM f),
s AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY owner, session) AS size, coalesce(track = lag(track) OVER w, false) AS is_repeat,
    album IS DISTINCT FROM lag(album) OVER w AND row_number() OVER w > 1 AS album_changed,
    round((epoch_us(played_at) - epoch_us(coalesce(max(CASE WHEN interaction THEN played_at END) OVER (w ROWS UNBOUNDED PRECEDING), min(played_at) OVER (PARTITION BY owner, session)))) / 6e7, 4) AS idle_min
  FROM n0 WINDOW w AS (PARTITION BY owner, session ORDER BY played_at, play_id)),
rr AS (SELECT *, sum((NOT is_repeat)::INT) OVER w AS track_run, sum(skipped::INT) OVER w AS skip_run, sum(album_changed::INT) OVER w AS album_no FROM s WINDOW w AS (PARTITION BY owner, session ORDER BY played_at, play_id ROWS UNBOUNDED PRECEDING)),
stuck AS (SELECT owner, session, max(n) AS stuck_run FROM (SELECT owner, session, track_run, count(*) FILTER (NOT interaction) AS n FROM rr GROUP BY ALL) GROUP BY ALL),
unskipped AS (SELECT owner, session, max(n) AS unskipped_run FROM (SELECT owner, session, skip_run, count(*) FILTER (NOT skipped) AS n FROM rr GROUP BY ALL) GROUP BY ALL),
albums AS (SELECT owner, session, max(n) AS album_run FROM (SELECT owner, session, album_no, count(*) FILTER (NOT skipped) AS n FROM rr GROUP BY ALL) GROUP BY ALL),
mix AS (SELECT owner, session, round(-sum(p * log2(p)), 6) AS entropy, round(max(p), 6) AS top_share FROM (SELECT owner, session, artist, count(*) / sum(count(*)) OVER (PARTITION BY owner, session) AS p FROM s GROUP BY owner, session, artist) GROUP BY ALL),
tmix AS (SELECT owner, session, round(max(n) / sum(n), 6) AS top_track_share FROM (SELECT owner, session, track, count(*) AS n FROM s GROUP BY ALL) GROUP BY ALL),
m AS (SELECT owner, session, count(*) AS plays, min(played_at) AS start_at, max(played_at) AS end_at, round((epoch_us(max(played_at)) - epoch_us(min(played_at))) / 6e7, 4) AS duration_min, sum(ms)::BIGINT AS ms,
    count(DISTINCT artist) AS artists, count(DISTINCT track) AS tracks, count(*) FILTER (skipped) AS skips, avg(skipped::INT) AS skip_rate, avg(is_repeat::INT) AS repeat_rate, avg(is_first::INT) AS novelty_rate,
    arg_min(track, (played_at, play_id)) AS opener, arg_max(track, (played_at, play_id)) AS closer, avg(skipped::INT) FILTER (pos <= ceil(size / 3.0)) AS first_third_skip, avg(skipped::INT) FILTER (pos > ceil(size / 3.0)) AS rest_skip,
    round((epoch_us(min(played_at) FILTER (skipped)) - epoch_us(min(played_at))) / 1e6, 3) AS first_skip_s, count(*) FILTER (interaction) AS interactions, max(stuck_run) AS stuck_run,
    coalesce(sum(ms) FILTER (idle_min <= {STREAM.attention_gap_min} AND stuck_run < {STREAM.stuck_repeat_plays}), 0)::BIGINT AS attended_ms
  FROM s JOIN stuck USING (owner, session) GROUP BY owner, session),
ses AS (SELECT *, CASE WHEN album_run >= 6 THEN 'album_ride' WHEN plays >= 3 AND (repeat_rate >= {STREAM.loop_repeat} OR top_track_share >= 0.4) THEN 'comfort_loop'
    WHEN novelty_rate >= {STREAM.discovery_novelty} AND plays >= 6 AND skip_rate < 0.6 THEN 'discovery_run' WHEN duration_min >= 90 AND top_share >= 0.6 THEN 'deep_dive' WHEN duration_min >= 180 THEN 'binge'
    WHEN first_third_skip >= 2 * coalesce(rest_skip, 0) AND first_third_skip > 0 AND skip_rate < {STREAM.restless_skip} AND plays >= 6 THEN 'warm_up' WHEN skip_rate >= {STREAM.restless_skip} THEN 'restless'
    WHEN duration_min >= 60 AND skip_rate <= 0.1 AND entropy >= 3.0 THEN 'autopilot' WHEN entropy >= {STREAM.wander_entropy} AND plays >= 8 THEN 'shuffle_wander' ELSE 'steady' END AS shape,
    hour(start_at) >= 23 OR hour(start_at) < 5 AS late, dayofweek(start_at) IN (0, 6) AS weekend,
    CASE WHEN hour(start_at) BETWEEN 5 AND 10 THEN 'morning' WHEN hour(start_at) BETWEEN 11 AND 14 THEN 'midday' WHEN hour(start_at) BETWEEN 15 AND 19 THEN 'evening' WHEN hour(start_at) BETWEEN 20 AND 23 THEN 'night' ELSE 'late' END AS day_part,
    stuck_run >= {STREAM.stuck_repeat_plays} AS stuck, CASE WHEN attended_ms = ms THEN 'active' WHEN ms < 2 * attended_ms THEN 'drifting' ELSE 'unattended' END AS attention, start_at::DATE AS day
  FROM m JOIN mix USING (owner, session) JOIN tmix USING (owner, session) JOIN unskipped USING (owner, session) JOIN albums USING (owner, session))
"""


@C.query("p_sessionize", "stream_plays", sql=_CUT + "SELECT owner, play_id, session, pos::INTEGER AS pos, size, is_repeat, album_changed, idle_min FROM s")
def sessionized(plays: DataFrame) -> DataFrame:
    """Each play's session, place in it, repeats, album changes and idle time."""
    return op.sessionize(plays, STREAM).select("owner", "play_id", "session", "pos", "size", "is_repeat", "album_changed", "idle_min")


@C.query("p_session_runs", "stream_plays", sql=_CUT + "SELECT owner, session, stuck_run, unskipped_run, album_run FROM stuck JOIN unskipped USING (owner, session) JOIN albums USING (owner, session)")
def session_runs(plays: DataFrame) -> DataFrame:
    """Stuck repeats, longest unbroken run, longest album run."""
    return op.marked(plays, STREAM).groupBy("owner", "session").agg(*[F.max(c).alias(c) for c in ("stuck_run", "unskipped_run", "album_run")])



_COLUMNS = "owner session plays duration_min ms artists tracks skips skip_rate repeat_rate novelty_rate opener closer first_third_skip rest_skip first_skip_s interactions attended_ms stuck_run entropy top_share top_track_share unskipped_run album_run shape late weekend day_part stuck attention".split()


@C.query("p_sessions", "stream_plays", sql=_CUT + f"SELECT {', '.join(_COLUMNS)} FROM ses")
def all_sessions(plays: DataFrame) -> DataFrame:
    """Every session with all its measures, its shape and its attention."""
    return op.build(plays, STREAM).select(*_COLUMNS)


@C.query("p_transitions", "stream_plays", sql=_CUT + ", t AS (SELECT owner, track, lead(track) OVER (PARTITION BY owner, session ORDER BY played_at, play_id) AS next_track FROM s) SELECT owner, track, next_track, count(*) AS n FROM t WHERE next_track <> track GROUP BY ALL")
def transitions(plays: DataFrame) -> DataFrame:
    """Tracks that follow one another within a session."""
    return op.transitions(op.sessionize(plays, STREAM))


@C.query("p_chaos", "stream_plays", sql=_CUT + """, tags AS (SELECT DISTINCT artist, track % 4 AS tag, (1 + track % 3)::DOUBLE AS weight FROM stream_plays WHERE artist % 6 <> 0 QUALIFY row_number() OVER (PARTITION BY artist, track % 4 ORDER BY track) = 1),
norm AS (SELECT artist, sqrt(sum(weight * weight)) AS n FROM tags GROUP BY 1), st AS (SELECT owner, session, artist AS a, lead(artist) OVER (PARTITION BY owner, session ORDER BY played_at, play_id) AS b FROM s),
dots AS (SELECT x.artist AS a, y.artist AS b, sum(x.weight * y.weight) AS d FROM tags x JOIN tags y USING (tag) GROUP BY ALL)
SELECT owner, session, round(avg(CASE WHEN a = b THEN 0 ELSE 1 - least(1, coalesce(d, 0) / (na.n * nb.n)) END), 6) AS chaos, count(*) AS pairs
FROM st JOIN norm na ON na.artist = a JOIN norm nb ON nb.artist = b LEFT JOIN dots USING (a, b) GROUP BY ALL HAVING count(*) >= 2""")
def chaos(plays: DataFrame) -> DataFrame:
    """How far apart the tags of artists are that follow one another."""
    first = Window.partitionBy("artist", "tag").orderBy("track")
    tags = plays.filter("artist % 6 <> 0").select("artist", (F.col("track") % 4).alias("tag"), "track").withColumn("r", F.row_number().over(first)).filter("r = 1").select("artist", "tag", (1 + F.col("track") % 3).cast("double").alias("weight"))
    return op.chaos(op.sessionize(plays, STREAM), tags)


def mean_skip() -> Column:
    """The mean of skip rates as parts per million, whole numbers whose sum is the same in any order."""
    return F.sum(F.expr("skips * 1000000 div plays")).cast("double") / (F.count(F.lit(1)) * 1_000_000).cast("double")


@C.query("f_sessions_overview", "stream_plays", sql=_CUT + """SELECT owner, count(*) AS sessions, round(quantile_cont(duration_min, 0.5), 6) AS median_min, round(quantile_cont(duration_min, 0.9), 6) AS p90_min,
  round(sum(attended_ms) / 3600000.0::DOUBLE, 6) AS attended_hours, count(*) FILTER (attention = 'active') AS active, count(*) FILTER (late) AS late_sessions, sum((skips * 1000000) // plays)::DOUBLE / (count(*) * 1000000)::DOUBLE AS mean_skip FROM ses GROUP BY owner""")
def overview(plays: DataFrame) -> DataFrame:
    """Each listener's sessions in one row."""
    return op.build(plays, STREAM).groupBy("owner").agg(
        F.count(F.lit(1)).alias("sessions"), F.round(F.percentile("duration_min", F.lit(0.5)), 6).alias("median_min"), F.round(F.percentile("duration_min", F.lit(0.9)), 6).alias("p90_min"),
        F.round(F.sum("attended_ms") / F.lit(3_600_000.0), 6).alias("attended_hours"), F.count_if(F.col("attention") == "active").alias("active"), F.count_if("late").alias("late_sessions"), mean_skip().alias("mean_skip"),
    )


@C.query("f_session_heat", "stream_plays", sql=_CUT + "SELECT dayofweek(start_at)::INTEGER AS dow, hour(start_at)::INTEGER AS hour, count(*) AS sessions, sum(plays)::BIGINT AS plays FROM ses GROUP BY 1, 2")
def heat(plays: DataFrame) -> DataFrame:
    return op.build(plays, STREAM).groupBy(dow0(F.col("start_at")).alias("dow"), F.hour("start_at").alias("hour")).agg(F.count(F.lit(1)).alias("sessions"), F.sum("plays").alias("plays"))


_BANDS = [(0, 0, 5), (1, 5, 15), (2, 15, 30), (3, 30, 60), (4, 60, 120), (5, 120, 240), (6, 240, 480), (7, 480, 1_000_000_000)]


@C.query("f_session_lengths", "stream_plays", sql=_CUT + f", bands(band, low, high) AS (VALUES {', '.join(map(str, _BANDS))}) SELECT band::INTEGER AS band, count(owner) AS sessions FROM bands LEFT JOIN ses ON duration_min >= low AND duration_min < high GROUP BY band")
def lengths(plays: DataFrame) -> DataFrame:
    """A histogram of eight bands, empty ones with 0: bands by arithmetic, then joined to the list of bands."""
    band = F.size(F.filter(F.array(*[F.lit(low) for _, low, _ in _BANDS[1:]]), lambda x: x <= F.col("duration_min")))
    counted = op.build(plays, STREAM).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
    bands = plays.sparkSession.range(len(_BANDS)).select(F.col("id").cast("int").alias("band"))
    return bands.join(counted, "band", "left").select("band", F.coalesce("n", F.lit(0)).cast("long").alias("sessions"))


@C.query("f_session_shapes", "stream_plays", sql=_CUT + "SELECT shape, day_part, count(*) AS sessions, sum((skips * 1000000) // plays)::DOUBLE / (count(*) * 1000000)::DOUBLE AS skip_rate, sum(ms)::BIGINT AS ms FROM ses GROUP BY 1, 2")
def shapes(plays: DataFrame) -> DataFrame:
    return op.build(plays, STREAM).groupBy("shape", "day_part").agg(F.count(F.lit(1)).alias("sessions"), mean_skip().alias("skip_rate"), F.sum("ms").alias("ms"))


@C.query("f_openers_closers", "stream_plays", sql=_CUT + """, e AS (SELECT 'opener' AS role, opener AS track FROM ses WHERE plays >= 3 UNION ALL SELECT 'closer', closer FROM ses WHERE plays >= 3), n AS (SELECT role, track, count(*) AS n FROM e GROUP BY ALL)
SELECT role, track, n, (row_number() OVER (PARTITION BY role ORDER BY n DESC, track))::INTEGER AS rank FROM n QUALIFY rank <= 10""")
def openers_closers(plays: DataFrame) -> DataFrame:
    s = op.build(plays, STREAM).filter("plays >= 3")
    ends = s.select(F.explode(F.array(F.struct(F.lit("opener").alias("role"), F.col("opener").alias("track")), F.struct(F.lit("closer").alias("role"), F.col("closer").alias("track")))).alias("e")).select("e.*")
    return top_by(ends.groupBy("role", "track").agg(F.count(F.lit(1)).alias("n")), ["role"], 10, F.desc("n"), F.col("track"))


@C.query("f_list_sessions", "stream_plays", sql=_CUT + """, page AS (SELECT * FROM ses WHERE attention <> 'unattended' AND plays >= 2 ORDER BY ms DESC, owner, session LIMIT 40 OFFSET 10),
c AS (SELECT owner, session, artist, count(*) AS n FROM s SEMI JOIN page USING (owner, session) GROUP BY ALL), top AS (SELECT owner, session, list(artist ORDER BY n DESC, artist)[1:2] AS a FROM c GROUP BY ALL)
SELECT owner, session, plays, ms, shape, array_to_string(a, ',') AS top_artists FROM page JOIN top USING (owner, session)""")
def listed(plays: DataFrame) -> DataFrame:
    """A page of the explorer; top artists are looked up for the page's rows only."""
    s = op.sessionize(plays, STREAM)
    page = op.build(plays, STREAM).filter("attention <> 'unattended' and plays >= 2").orderBy(F.desc("ms"), "owner", "session").offset(10).limit(40)
    keys = ["owner", "session"]
    counted = s.join(page.select(*keys), keys, "left_semi").groupBy(*keys, "artist").agg(F.count(F.lit(1)).alias("n"))
    top = counted.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "artist"))), 1, 2).alias("a"))
    return page.join(top, keys).select(*keys, "plays", "ms", "shape", F.array_join(F.transform("a", lambda x: x["artist"].cast("string")), ",").alias("top_artists"))


@C.query("f_device_handoff", "stream_plays", sql=_CUT + """, e AS (SELECT owner, session, arg_min(platform, (played_at, play_id)) AS a, arg_max(platform, (played_at, play_id)) AS b, count(*) AS n FROM s GROUP BY ALL)
SELECT a AS from_device, b AS to_device, count(*) AS sessions, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM e WHERE n >= 3 GROUP BY a, b""")
def handoff(plays: DataFrame) -> DataFrame:
    """The device that sessions begin and end on."""
    s = op.sessionize(plays, STREAM)
    order = F.struct("played_at", "play_id")
    ends = s.groupBy("owner", "session").agg(F.min_by("platform", order).alias("from_device"), F.max_by("platform", order).alias("to_device"), F.count(F.lit(1)).alias("n")).filter("n >= 3")
    pairs = ends.groupBy("from_device", "to_device").agg(F.count(F.lit(1)).alias("sessions"))
    total = pairs.agg(F.sum("sessions").alias("all"))
    return pairs.crossJoin(F.broadcast(total)).select("from_device", "to_device", "sessions", F.round(F.col("sessions") / F.col("all"), 6).alias("share"))


@C.query("f_co_listening", "stream_plays", sql=_CUT + """, best AS (SELECT artist FROM s GROUP BY 1 ORDER BY count(*) DESC, artist LIMIT 60), mem AS (SELECT DISTINCT artist, owner, session FROM s SEMI JOIN best USING (artist)), sz AS (SELECT artist, count(*) AS n FROM mem GROUP BY 1),
j AS (SELECT x.artist AS a, y.artist AS b, count(*) AS shared FROM mem x JOIN mem y ON x.owner = y.owner AND x.session = y.session AND x.artist <> y.artist GROUP BY ALL HAVING count(*) >= 3)
SELECT a, b, shared, round(shared / (p.n + q.n - shared), 6) AS jaccard FROM j JOIN sz p ON p.artist = a JOIN sz q ON q.artist = b QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(shared / (p.n + q.n - shared), 6) DESC, b) <= 4""")
def co_listening(plays: DataFrame, most: int = 60, edges: int = 4) -> DataFrame:
    """How far the most heard artists share sessions, the nearest of each (F172). A session gives at most most * (most - 1) pairs."""
    cut = op.sessionize(plays, STREAM).select("artist", "owner", "session")
    best = cut.groupBy("artist").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "artist").limit(most).select("artist")
    members = cut.join(F.broadcast(best), "artist").distinct()
    sizes = members.groupBy("artist").agg(F.count(F.lit(1)).alias("n"))  # most rows at most
    a, b = members.withColumnRenamed("artist", "a"), members.withColumnRenamed("artist", "b")
    j = a.join(b, ["owner", "session"]).filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).filter("shared >= 3")
    sized = j.join(F.broadcast(sizes.withColumnRenamed("n", "na")), j["a"] == sizes["artist"]).drop("artist").join(F.broadcast(sizes.withColumnRenamed("n", "nb")), F.col("b") == F.col("artist"))
    like = sized.withColumn("jaccard", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6))
    return top_by(like, ["a"], edges, F.desc("jaccard"), F.col("b")).select("a", "b", "shared", "jaccard")



@C.query("f_record_sessions", "stream_plays", sql=_CUT + """, r AS (SELECT owner, session, ms, max(ms) OVER (PARTITION BY owner ORDER BY start_at, session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ses WHERE attention <> 'unattended')
SELECT owner, session, ms, before FROM r WHERE before IS NULL OR ms > before""")
def record_sessions(plays: DataFrame) -> DataFrame:
    """Sessions longer than all before them."""
    w = Window.partitionBy("owner").orderBy("start_at", "session").rowsBetween(Window.unboundedPreceding, -1)
    s = op.build(plays, STREAM).filter("attention <> 'unattended'").withColumn("before", F.max("ms").over(w))
    return s.filter("before is null or ms > before").select("owner", "session", "ms", "before")


@C.query("f_unattended_by_day", "stream_plays", sql=_CUT + "SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS sessions, avg((attention = 'unattended')::INT) AS unattended FROM ses GROUP BY 1")
def unattended_by_day(plays: DataFrame) -> DataFrame:
    return op.build(plays, STREAM).groupBy(text(F.col("day")).alias("day")).agg(F.count(F.lit(1)).alias("sessions"), share(F.col("attention") == "unattended").alias("unattended"))


#: Orders stand for a listener's marks on sessions: of a customer, at the hour of the order's day that its key gives.
_MARKS = f"""mk AS (SELECT o_custkey AS owner, s.start_at + to_seconds(o_orderkey % 700 - 350) AS start_at, ['active', 'drifting', 'unattended'][o_orderkey % 3 + 1] AS attention FROM orders JOIN ses s ON s.owner = o_custkey AND s.session = 1 + o_orderkey % 5),
nm AS (SELECT s.owner, s.session, arg_max(mk.attention, (-abs(epoch_us(s.start_at) - epoch_us(mk.start_at)), mk.start_at, mk.attention)) AS mark FROM ses s JOIN mk ON mk.owner = s.owner AND abs(epoch_us(s.start_at) - epoch_us(mk.start_at)) <= 300000000 GROUP BY ALL)"""


def _marks(orders: DataFrame, sessions: DataFrame) -> DataFrame:
    """(owner, start_at, attention): an order marks one of its customer's sessions, up to six minutes off its start."""
    at = sessions.select("owner", "session", F.col("start_at").alias("_start"))
    o = orders.select(F.col("o_custkey").alias("owner"), (1 + F.col("o_orderkey") % 5).alias("session"), "o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("active", "drifting", "unattended"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    off = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("o_orderkey") % 700 - 350).cast("decimal(18,6)"))
    return o.join(at, ["owner", "session"]).select("owner", (F.col("_start") + off).alias("start_at"), kind.alias("attention"))


@C.query("p_session_marks", "stream_plays", "orders", sql=_CUT + "," + _MARKS + " SELECT owner, session, mark, CASE WHEN mark = 'unattended' THEN 0 WHEN mark IS NOT NULL THEN ms ELSE attended_ms END AS attended_ms, coalesce(mark, attention) AS attention FROM ses LEFT JOIN nm USING (owner, session)")
def session_marks(plays: DataFrame, orders: DataFrame) -> DataFrame:
    """Sessions after the listener's own marks, the nearest within five minutes of a start."""
    built = op.build(plays, STREAM)
    marks = _marks(orders, built)
    near = op.marks_of(built, marks)
    return op.with_overrides(built, marks).select("owner", "session", "attended_ms", "attention").join(near, ["owner", "session"], "left").select("owner", "session", "mark", "attended_ms", "attention")


@C.query("p_attended_plays", "stream_plays", "orders", sql=_CUT + "," + _MARKS + f" SELECT owner, play_id, CASE mark WHEN 'unattended' THEN false WHEN 'active' THEN true ELSE idle_min <= {STREAM.attention_gap_min} AND stuck_run < {STREAM.stuck_repeat_plays} END AS attended, idle_min FROM s JOIN stuck USING (owner, session) LEFT JOIN nm USING (owner, session)")
def attended_plays(plays: DataFrame, orders: DataFrame) -> DataFrame:
    """Every play with attention written back from its session and the listener's marks."""
    cut = op.marked(plays, STREAM)
    built = op.build(plays, STREAM)
    near = op.marks_of(built, _marks(orders, built))
    return op.written_back(plays, cut, near).select("owner", "play_id", "attended", "idle_min")


@C.query("f_session_overrides", "stream_plays", "orders", sql=_CUT + "," + _MARKS + ", l AS (SELECT DISTINCT owner, start_at, attention FROM mk) SELECT owner, strftime(start_at, '%Y-%m-%d %H:%M:%S') AS start_at, attention, (row_number() OVER (PARTITION BY owner ORDER BY start_at DESC, attention))::INTEGER AS rank FROM l")
def session_overrides(plays: DataFrame, orders: DataFrame) -> DataFrame:
    """A listener's marks, the latest first."""
    marks = _marks(orders, op.build(plays, STREAM)).distinct()
    rank = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("start_at"), "attention"))
    return marks.select("owner", F.date_format("start_at", "yyyy-MM-dd HH:mm:ss").alias("start_at"), "attention", rank.alias("rank"))
