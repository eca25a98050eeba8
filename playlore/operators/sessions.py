"""Listening sessions: cut by an adaptive gap, measured, classified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlore.functions.compat import arg_max, arg_min, dow0, share
from playlore.functions.config import Tuning
from playlore.operators.islands import gap_sessions
from playlore.operators.joins import spread


#: Seconds that a mark may lie from the start of its session.
MARK_SECONDS = 300


def adaptive_gap(t: Tuning) -> Column:
    """Seconds of silence that end a session: most after a car, fewer after a play at night, least otherwise."""
    night = (F.col("previous_hour") >= 23) | (F.col("previous_hour") < 6)
    car = F.lower("previous_platform").rlike("auto|car")
    return F.when(F.coalesce(car, F.lit(False)), t.gap_car_min * 60).when(F.coalesce(night, F.lit(False)), t.gap_night_min * 60).otherwise(t.gap_min * 60)


def sessionize(plays: DataFrame, t: Tuning) -> DataFrame:
    """plays with session, gap_seconds, pos, size, is_repeat, album_changed and idle_min.

    idle_min: minutes since the listener last did something, or since the session began. Listeners are dealt into parts of
    bounded size, in which all windows of a session are sorted, so that a task's memory does not grow with the table.
    """
    dealt = spread(plays, plays.count(), "owner")
    cut = gap_sessions(dealt, "owner", "played_at", "play_id", adaptive_gap(t))
    s = Window.partitionBy("owner", "session")
    w = s.orderBy("played_at", "play_id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    touched = F.coalesce(F.max(F.when(F.col("interaction"), F.col("played_at"))).over(upto), F.min("played_at").over(s))
    return cut.withColumns(
        {
            "pos": F.row_number().over(w),
            "size": F.count(F.lit(1)).over(s),
            "is_repeat": F.coalesce(F.col("track") == F.lag("track").over(w), F.lit(False)),
            "album_changed": ~F.coalesce(F.lag("album").over(w).eqNullSafe(F.col("album")), F.lit(False)) & (F.row_number().over(w) > 1),
            "idle_min": F.round(F.timestamp_diff("MICROSECOND", touched, F.col("played_at")) / 6e7, 4),
        }
    )


def marked(plays: DataFrame, t: Tuning) -> DataFrame:
    """sessionized with is_first, the lengths of runs so far, counts and first places of artists and tracks, and attended.

    Every window is within an owner, and sessionize has brought each owner together, so nothing is shuffled again.
    A run's length so far is a running count less what it was before the run's first play.
    """
    s = Window.partitionBy("owner", "session")
    upto = s.orderBy("played_at", "play_id").rowsBetween(Window.unboundedPreceding, 0)
    lively, kept = (F.when(~F.col(c), 1).otherwise(0) for c in ("interaction", "skipped"))
    runs = {"stuck_run": (~F.col("is_repeat"), lively), "unskipped_run": (F.col("skipped"), kept), "album_run": (F.col("album_changed"), kept)}
    cut = sessionize(plays, t).withColumn("is_first", F.row_number().over(Window.partitionBy("owner", "track").orderBy("played_at", "play_id")) == 1)
    cut = cut.withColumns({f"_{k}": F.sum(n).over(upto) for k, (_, n) in runs.items()})
    cut = cut.withColumns({k: F.col(f"_{k}") - F.coalesce(F.last(F.when(broken, F.col(f"_{k}") - n), ignorenulls=True).over(upto), F.lit(0)) for k, (broken, n) in runs.items()})
    for name in ("artist", "track"):
        each = Window.partitionBy("owner", "session", name)
        cut = cut.withColumns({f"new_{name}": F.row_number().over(each.orderBy("played_at", "play_id")) == 1, f"of_{name}": F.count(F.lit(1)).over(each)})
    cut = cut.withColumn("stuck_run", F.max("stuck_run").over(s))
    return cut.withColumn("attended", (F.col("idle_min") <= t.attention_gap_min) & (F.col("stuck_run") < t.stuck_repeat_plays))


def measures(plays: DataFrame) -> DataFrame:
    """One row for each session of plays, which marked() gives."""
    third = F.ceil(F.col("size") / 3.0)
    first = [F.col("played_at"), F.col("play_id")]
    seconds = lambda a, b: F.round(F.timestamp_diff("MICROSECOND", a, b) / 1e6, 3)
    return plays.groupBy("owner", "session").agg(
        F.count(F.lit(1)).alias("plays"),
        F.min("played_at").alias("start_at"),
        F.max("played_at").alias("end_at"),
        F.round(F.timestamp_diff("MICROSECOND", F.min("played_at"), F.max("played_at")) / 6e7, 4).alias("duration_min"),
        F.sum("ms").alias("ms"),
        F.sum(F.col("new_artist").cast("long")).alias("artists"),
        F.sum(F.col("new_track").cast("long")).alias("tracks"),
        F.sum(F.col("skipped").cast("long")).alias("skips"),
        share(F.col("skipped")).alias("skip_rate"),
        share(F.col("is_repeat")).alias("repeat_rate"),
        share(F.col("is_first")).alias("novelty_rate"),
        arg_min(F.col("track"), *first).alias("opener"),
        arg_max(F.col("track"), *first).alias("closer"),
        F.avg(F.when(F.col("pos") <= third, F.col("skipped").cast("double"))).alias("first_third_skip"),
        F.avg(F.when(F.col("pos") > third, F.col("skipped").cast("double"))).alias("rest_skip"),
        seconds(F.min("played_at"), F.min(F.when(F.col("skipped"), F.col("played_at")))).alias("first_skip_s"),
        F.sum(F.col("interaction").cast("long")).alias("interactions"),
        F.sum(F.when(F.col("attended"), F.col("ms")).otherwise(0)).alias("attended_ms"),
        F.max("stuck_run").alias("stuck_run"),
        F.max("unskipped_run").alias("unskipped_run"),
        F.max("album_run").alias("album_run"),
        F.round(-F.sum(F.log2(F.col("of_artist") / F.col("size")) / F.col("size")), 6).alias("entropy"),
        F.round(F.max(F.col("of_artist") / F.col("size")), 6).alias("top_share"),
        F.round(F.max(F.col("of_track") / F.col("size")), 6).alias("top_track_share"),
    )


def shape(t: Tuning) -> Column:
    """The first rule that fits names a session's shape."""
    return (
        F.when(F.col("album_run") >= 6, "album_ride")
        .when((F.col("plays") >= 3) & ((F.col("repeat_rate") >= t.loop_repeat) | (F.col("top_track_share") >= 0.4)), "comfort_loop")
        .when((F.col("novelty_rate") >= t.discovery_novelty) & (F.col("plays") >= 6) & (F.col("skip_rate") < 0.6), "discovery_run")
        .when((F.col("duration_min") >= 90) & (F.col("top_share") >= 0.6), "deep_dive")
        .when(F.col("duration_min") >= 180, "binge")
        .when((F.col("first_third_skip") >= 2 * F.coalesce("rest_skip", F.lit(0.0))) & (F.col("first_third_skip") > 0) & (F.col("skip_rate") < t.restless_skip) & (F.col("plays") >= 6), "warm_up")
        .when(F.col("skip_rate") >= t.restless_skip, "restless")
        .when((F.col("duration_min") >= 60) & (F.col("skip_rate") <= 0.1) & (F.col("entropy") >= 3.0), "autopilot")
        .when((F.col("entropy") >= t.wander_entropy) & (F.col("plays") >= 8), "shuffle_wander")
        .otherwise("steady")
    )


def day_part(hour: Column) -> Column:
    return F.when(hour.between(5, 10), "morning").when(hour.between(11, 14), "midday").when(hour.between(15, 19), "evening").when(hour.between(20, 23), "night").otherwise("late")


def build(plays: DataFrame, t: Tuning = Tuning()) -> DataFrame:
    """All of a session: measures, runs, entropy, shape, time of day and attention."""
    joined = measures(marked(plays, t))
    start = F.col("start_at")
    return joined.withColumns(
        {
            "shape": shape(t),
            "late": (F.hour(start) >= 23) | (F.hour(start) < 5),
            "weekend": dow0(start).isin(0, 6),
            "day_part": day_part(F.hour(start)),
            "stuck": F.col("stuck_run") >= t.stuck_repeat_plays,
            "attention": F.when(F.col("attended_ms") == F.col("ms"), "active").when(F.col("ms") < 2 * F.col("attended_ms"), "drifting").otherwise("unattended"),
            "day": F.to_date(start),
        }
    )


def marks_of(sessions: DataFrame, overrides: DataFrame) -> DataFrame:
    """(owner, session, mark): the listener's mark that lies nearest to a session's start, within five minutes.

    overrides: owner, start_at, attention. Time is cut into buckets of five minutes and a mark put into three of them, so the join
    is on equal keys. Of marks as near as each other the later one holds, then the greater name; a mark holds for every session that it is near to.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (MARK_SECONDS * 1e6)).cast("long")
    marks = overrides.filter("attention is not null").select("owner", F.col("start_at").alias("_at"), F.col("attention").alias("_mark"), F.explode(F.sequence(bucket("start_at") - 1, bucket("start_at") + 1)).alias("_bucket"))
    away = F.abs(F.timestamp_diff("MICROSECOND", F.col("start_at"), F.col("_at")))
    near = sessions.select("owner", "session", "start_at", bucket("start_at").alias("_bucket")).join(marks, ["owner", "_bucket"]).withColumn("_away", away).filter(F.col("_away") <= MARK_SECONDS * 1e6)
    return near.groupBy("owner", "session").agg(F.max(F.struct(-F.col("_away"), F.col("_at"), F.col("_mark").alias("mark")))["mark"].alias("mark"))


def with_overrides(sessions: DataFrame, overrides: DataFrame) -> DataFrame:
    """sessions with the attention of the listener's own marks (P26). One mark holds for a session, so no session is repeated."""
    joined = sessions.join(marks_of(sessions, overrides), ["owner", "session"], "left")
    ms = F.when(F.col("mark") == "unattended", F.lit(0)).when(F.col("mark").isNotNull(), F.col("ms")).otherwise(F.col("attended_ms"))
    return joined.withColumns({"attended_ms": ms, "attention": F.coalesce("mark", "attention")}).drop("mark").select(*sessions.columns)


def written_back(plays: DataFrame, cut: DataFrame, marks: DataFrame) -> DataFrame:
    """plays with attended and idle_min of their place in a session, which a mark overrules: `unattended` takes all of a session's plays, `active` gives them back.

    cut: marked plays; marks: marks_of their sessions. Plays that are in no session were attended, with idle_min unknown.
    """
    said = F.when(F.col("mark") == "unattended", False).when(F.col("mark") == "active", True).otherwise(F.col("attended"))
    placed = cut.select("owner", "session", "play_id", "attended", "idle_min").join(marks, ["owner", "session"], "left").select("owner", "play_id", said.alias("_attended"), F.col("idle_min").alias("_idle"))
    kept = [c for c in plays.columns if c not in ("attended", "idle_min")]
    return plays.select(*kept).join(placed, ["owner", "play_id"], "left").select(*kept, F.coalesce("_attended", F.lit(True)).alias("attended"), F.col("_idle").alias("idle_min"))


def transitions(sessionized: DataFrame) -> DataFrame:
    """(owner, track, next_track, n): tracks that follow one another within a session."""
    w = Window.partitionBy("owner", "session").orderBy("played_at", "play_id")
    pairs = sessionized.withColumn("next_track", F.lead("track").over(w)).filter("next_track is not null and next_track <> track")
    return pairs.groupBy("owner", "track", "next_track").agg(F.count(F.lit(1)).alias("n"))


def chaos(sessionized: DataFrame, tags: DataFrame) -> DataFrame:
    """(owner, session, chaos, pairs): the mean cosine distance of the tags of artists that follow one another; untagged pairs don't count, and it takes two.

    tags: artist, tag, weight.
    """
    w = Window.partitionBy("owner", "session").orderBy("played_at", "play_id")
    steps = sessionized.withColumn("to", F.lead("artist").over(w)).filter("to is not null").select("owner", "session", F.col("artist").alias("from"), "to")
    norm = tags.groupBy("artist").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    unit = tags.join(norm, "artist").select("artist", "tag", (F.col("weight") / F.col("norm")).alias("u"))
    kinds = steps.select("from", "to").distinct()
    tagged = norm.select("artist")
    known = kinds.join(tagged.select(F.col("artist").alias("from")), "from", "left_semi").join(tagged.select(F.col("artist").alias("to")), "to", "left_semi")
    dots = known.join(unit.select(F.col("artist").alias("from"), "tag", F.col("u").alias("x")), "from").join(unit.select(F.col("artist").alias("to"), "tag", F.col("u").alias("y")), ["to", "tag"]).groupBy("from", "to").agg(F.sum(F.col("x") * F.col("y")).alias("cos"))
    apart = known.join(dots, ["from", "to"], "left").withColumn("distance", F.when(F.col("from") == F.col("to"), 0.0).otherwise(1 - F.least(F.lit(1.0), F.coalesce("cos", F.lit(0.0)))))
    scored = steps.join(apart, ["from", "to"]).groupBy("owner", "session").agg(F.round(F.avg("distance"), 6).alias("chaos"), F.count(F.lit(1)).alias("pairs"))
    return scored.filter("pairs >= 2")
