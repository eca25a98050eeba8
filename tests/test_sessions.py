"""Sessions on small hand-made histories."""

from datetime import datetime, timedelta

import pytest

from playlore.functions.config import Tuning
from playlore.operators import sessions as op

SCHEMA = "owner string, play_id long, played_at timestamp_ntz, track string, artist string, album string, ms long, skipped boolean, interaction boolean, platform string"


def history(spark, rows, owner="o"):
    """rows: (minute, track, artist, album, skipped, interaction[, platform])."""
    t0 = datetime(2024, 3, 1, 20)
    data = [(owner, i, t0 + timedelta(minutes=r[0]), r[1], r[2], r[3], 200_000, r[4], r[5], r[6] if len(r) > 6 else "linux") for i, r in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def built(spark, rows, **tuning):
    return op.build(history(spark, rows), Tuning(**tuning)).orderBy("start_at").collect()


def test_album_ride_and_a_gap(spark):
    out = built(spark, [(4 * i, f"t{i}", "a", "LP", False, i == 0) for i in range(8)] + [(780, "x", "b", "M", False, True)])
    assert [r.plays for r in out] == [8, 1]
    assert out[0].shape == "album_ride"


def test_restless(spark):
    (r,) = built(spark, [(2 * i, f"t{i}", f"a{i}", f"l{i}", True, True) for i in range(10)])
    assert (r.shape, r.skip_rate, r.skips) == ("restless", 1.0, 10)


def test_comfort_loop_needs_three_plays(spark):
    out = built(spark, [(0, "s", "a", "l", False, True), (3, "s", "a", "l", False, True)] + [(600 + 3 * i, "s", "a", "l", False, True) for i in range(3)])
    assert [r.shape for r in out] == ["steady", "comfort_loop"]


def test_attention_runs_out(spark):
    rows = [(0, "t0", "a", None, False, True)] + [(4 * i, f"t{i}", "a", None, False, False) for i in range(1, 30)]
    t = Tuning(attention_gap_min=60)
    s = op.marked(history(spark, rows), t).collect()
    assert sum(r.attended for r in s) >= 15 and sum(not r.attended for r in s) > 0
    (r,) = built(spark, rows, attention_gap_min=60)
    assert r.attention in ("drifting", "unattended")


def test_a_loop_left_running_is_not_listening(spark):
    for clicks, expected in ((False, (True, "unattended")), (True, (False, "active"))):
        (r,) = built(spark, [(0.5 * i, "s", "a", "l", False, clicks) for i in range(20)])
        assert (r.stuck, r.attention) == expected


@pytest.mark.parametrize("gap,platform,sessions", [(29.9, "linux", 1), (30, "linux", 2), (59, "car", 1), (60, "Android Auto", 2)])
def test_gaps_are_strict_and_longer_in_a_car(spark, gap, platform, sessions):
    assert len(built(spark, [(0, "a", "a", "l", False, True, platform), (gap, "b", "a", "l", False, True, platform)])) == sessions


def test_chaos(spark):
    tags = spark.createDataFrame([("j", "jazz", 1.0), ("m", "metal", 1.0), ("x", "ambient", 1.0)], "artist string, tag string, weight double")
    ride = op.sessionize(history(spark, [(3 * i, f"t{i}", "j", "l", False, True) for i in range(5)]), Tuning())
    hop = op.sessionize(history(spark, [(3 * i, f"t{i}", "jmx"[i % 3], "l", False, True) for i in range(6)]), Tuning())
    none = op.sessionize(history(spark, [(3 * i, f"t{i}", "unknown", "l", False, True) for i in range(6)]), Tuning())
    assert op.chaos(ride, tags).first().chaos < 0.05
    assert op.chaos(hop, tags).first().chaos > 0.9
    assert op.chaos(none, tags).count() == 0


def test_overrides_move_attention(spark):
    s = op.build(history(spark, [(0, "a", "a", "l", False, True), (3, "b", "a", "l", False, True)]), Tuning())
    marks = spark.createDataFrame([("o", datetime(2024, 3, 1, 20, 4), "unattended")], "owner string, start_at timestamp_ntz, attention string")
    r = op.with_overrides(s, marks).first()
    assert (r.attention, r.attended_ms) == ("unattended", 0)


def test_an_empty_history_has_no_sessions(spark):
    assert op.build(history(spark, []), Tuning()).count() == 0


def test_listeners_are_dealt_into_parts_of_bounded_size(spark, monkeypatch):
    """a task sorted as many plays as the table has for one part of a fixed number."""
    from playlore.operators import joins

    rows = [(op_ * 37 % 900 + 1000 * k, f"t{k % 3}", "a", "l", False, True) for k, op_ in enumerate(range(20))]
    plays = history(spark, rows).unionByName(history(spark, rows, "p")).unionByName(history(spark, rows, "q"))
    want = sorted(tuple(r) for r in op.build(plays, Tuning()).select("owner", "session", "plays", "shape").collect())
    monkeypatch.setattr(op, "spread", lambda df, count, *keys: joins.spread(df, count, *keys, rows=5))
    cut = op.build(plays, Tuning()).select("owner", "session", "plays", "shape")
    assert cut.rdd.getNumPartitions() == 12
    assert sorted(tuple(r) for r in cut.collect()) == want
