import datetime as dt

from pyspark.sql import functions as F

from playlore.operators import resolve

PLAY = "owner string, play_id string, raw_at timestamp, played_at_utc timestamp, source string, spotify_track_id string, track_name string, artist_name string, ms_played long"
AT = dt.datetime(2000, 1, 1)


def _export(i, at, key="k", title="T", by="B"):
    return ("a", i, AT + dt.timedelta(seconds=at), AT + dt.timedelta(seconds=at), "extended_export", key, title, by, 100_000)


def _other(i, source, at, key="k", title="T", by="B"):
    return ("a", i, AT + dt.timedelta(seconds=at), AT + dt.timedelta(seconds=at + 100), source, key, title, by, 100_000)


def test_one_row_of_a_key_is_shuffled_for_an_export_not_one_of_each_point(spark, monkeypatch):
    moved = []
    maybe = resolve._maybe_asked
    monkeypatch.setattr(resolve, "_maybe_asked", lambda held, asking: (moved.append((out := maybe(held, asking)).count()), out)[1])
    rows = [_export(f"x{i}", 1000 * i) for i in range(50)] + [_export(f"y{i}", 1000 * i, f"y{i}", f"Y{i}") for i in range(50)] + [_other("q", "recently_played_poll", 902)]
    gone = resolve._spotted(spark.createDataFrame(rows, PLAY))
    assert [x.play_id for x in gone.collect()] == ["q"]
    assert 50 <= moved[0] < 60  # exports of the asked key once each, and few of others


def test_keys_of_ids_and_names_do_not_meet(spark):
    rows = [_export("x", 100, "t", "t", None), _other("s1", "scrobble", 5, None, "t", None), _other("s2", "scrobble", 5, "t", "u", "v"), _other("s3", "scrobble", 5, None, "T", "B"), _export("z", 100, None), _other("q1", "recently_played_poll", 20, "t"), _other("q2", "recently_played_poll", 14, "t")]
    gone = resolve._spotted(spark.createDataFrame(rows, PLAY))
    assert {x.play_id for x in gone.collect()} == {"s2", "s3", "q2"}


def test_many_keys_leave_few_of_others(spark):
    asking = spark.range(200_000).select(F.lit("a").alias("owner"), F.col("id").cast("string").alias("a"), F.lit(None).cast("string").alias("b"))
    held = spark.range(200_000, 300_000).select(F.lit("a").alias("owner"), F.col("id").cast("string").alias("a"), F.lit(None).cast("string").alias("b"))
    assert resolve._maybe_asked(held, asking).count() < 15_000
