"""Weather words, what is due to be rebuilt, and badges and counters over hand-made tables."""

from datetime import date, datetime

from pyspark.sql import functions as F

from playlore.plans import honours
from playlore.sources import worklists as work


def test_words_at_their_limits(spark):
    rows = [(0.34, 999.0, "clear"), (0.35, 150.0, "downpour"), (0.9, 149.9, "showers"), (0.9, 75.0, "showers"), (0.9, 30.0, "scattered"), (0.9, 29.9, "drizzle")]
    df = spark.createDataFrame(rows, "p double, m double, want string")
    assert all(r.got == r.want for r in df.withColumn("got", honours.condition(F.col("p"), F.col("m"))).collect())


def test_weekdays_are_counted_with_silent_ones(spark):
    """From a Friday to the Sunday 16 days later there are three Fridays, Saturdays and Sundays and two of the others."""
    rows = [("o", date(2024, 3, 1), 60_000, True), ("o", date(2024, 3, 5), 60_000, True), ("o", date(2024, 3, 17), 60_000, True), ("o", date(2024, 3, 30), 60_000, False)]
    p = spark.createDataFrame(rows, "owner string, day date, ms long, attended boolean")
    got = {r.weekday: (r.days, r.heard, r.minutes) for r in honours.conditions(p).collect()}
    assert got == {5: (3, 1, 0.3333), 2: (2, 1, 0.5), 0: (3, 1, 0.3333)}
    assert honours.conditions(p.limit(0)).count() == 0


def test_due_by_cadence_and_gate(spark):
    now = "2024-06-02 12:00:00"
    rows = [(1, "daily", None, None), (2, "daily", None, datetime(2024, 6, 1, 16)), (3, "daily", None, datetime(2024, 6, 1, 16, 0, 1)), (4, "weekly", None, datetime(2024, 5, 26, 16)), (5, "weekly", None, datetime(2024, 5, 27)), (6, "daily", "rain", None), (7, "daily", "clear", None)]
    d = spark.createDataFrame(rows, "definition int, cadence string, gate string, built timestamp_ntz")
    due = lambda *a: sorted(r.definition for r in work.refresh_due(d, now, *a).collect())
    assert due("rain") == [1, 2, 4, 6]
    assert due(None) == [1, 2, 4]
    assert due("clear", [3, 5]) == [1, 2, 3, 4, 5, 7]


def test_an_empty_table_locks_its_own_badge_only(spark):
    frame = spark.createDataFrame
    plays = frame([("1", k, date(2024, 1, 1 + k % 9), 6, 1, k % 4, 400_000, True) for k in range(12)], "owner string, play_id long, day date, hour int, artist int, track int, ms long, attended boolean").withColumn("owner", F.col("owner").cast("long"))
    artists = frame([(1, 7, 10)], "artist int, scene long, listeners long")
    none = {"liked": "owner long, track int", "lyrics": "track int, lang string", "log": "owner string, payload string", "customers": "c_custkey long, c_mktsegment string"}
    stream = frame([], "owner long, play_id long, played_at timestamp_ntz, track int, artist int, album int, ms long, skipped boolean, interaction boolean, platform string")
    got = {r.badge: r.value for r in honours.more_badges(plays, artists, frame([], none["liked"]), frame([], none["lyrics"]), stream, frame([], none["log"]), frame([], none["customers"])).collect()}
    assert got == {"days": 9.0, "early bird": 12.0, "scene hopper": 1.0, "crate digger": 1.0}
    assert {r[0] for r in spark.range(1).select(honours.tier(F.lit("days"), F.lit(365.0))).collect()} == {"bronze"}
