"""The log's clocks, its several sources, and identities."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from playlore.operators import resolve as op
from playlore.sources import ingest

T0 = datetime(2024, 5, 1, 12)


def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def log(spark, rows):
    """rows: (seconds after T0, source, payload)."""
    data = [("o", f"e{i:03d}", "play", T0 + timedelta(seconds=s), json.dumps({"source": source, "album_name": "LP", "ms_played": 200_000} | p), T0, "fixture") for i, (s, source, p) in enumerate(rows)]
    return spark.createDataFrame(data, ingest.EVENTS)


def song(n, **more):
    return {"spotify_track_id": f"id{n}", "track_name": f"Song {n}", "artist_name": "Band"} | more


def test_polls_infer_skips(spark):
    rows, at = [], 0
    for i in range(60):
        rows.append((at, "recently_played_poll", song(i, ms_played=200_000)))
        at += 20 if i % 12 == 5 else 200
    p = op.normalise(log(spark, rows))
    assert p.agg(F.avg(F.col("was_skipped").cast("int"))).first()[0] > 0.05
    assert p.agg(F.min("ms_played")).first()[0] == 20_000
    even = [(200 * i, "recently_played_poll", song(i)) for i in range(60)]
    assert op.normalise(log(spark, even)).filter("was_skipped").count() == 0


def test_exports_supersede_polls_that_stamp_start_or_end(spark):
    for stamp in (3, 48):
        e = log(spark, [(stamp, "recently_played_poll", song(1)), (45, "extended_export", song(1, ms_played=45_000, end_reason="fwdbtn"))])
        (r,) = op.supersede(op.normalise(e)).collect()
        assert (r.ms_played, r.was_skipped, r.source) == (45_000, True, "extended_export")
    back_to_back = log(spark, [(200, "extended_export", song(1)), (400, "extended_export", song(1))])
    assert op.supersede(op.normalise(back_to_back)).count() == 2


def test_scrobbles_give_way(spark):
    e = log(spark, [(0, "scrobble", {"track_name": "song 1", "artist_name": "band"}), (10, "recently_played_poll", song(1)), (4000, "scrobble", {"track_name": "Other", "artist_name": "Band"})])
    out = op.supersede(op.normalise(e)).orderBy("raw_at").collect()
    assert [r.source for r in out] == ["recently_played_poll", "scrobble"]


def _resolved(spark, rows, isrcs=(), merges=(), merge_versions=True):
    none = spark.createDataFrame([], "owner string, from_date date, to_date date, zone string")
    countries = spark.createDataFrame([("DE", "Europe/Berlin")], "country string, zone string")
    m = spark.createDataFrame(list(merges), "from_artist_id string, into_artist_id string")
    i = spark.createDataFrame(list(isrcs), "track_id string, isrc string")
    return op.resolve(log(spark, rows), m, i, none, countries, merge_versions=merge_versions)


def test_local_time_follows_the_country(spark):
    r = _resolved(spark, [(0, "extended_export", song(1, country="DE")), (60, "extended_export", song(2, country="XX"))]).orderBy("raw_at").collect()
    assert [x.played_at.hour for x in r] == [14, 12] and [x.zone for x in r] == ["Europe/Berlin", "UTC"]


def test_isrc_versions_merge(spark):
    rows = [(600 * i, "extended_export", song(1, album_name="Single")) for i in range(2)] + [(5000 + 600 * i, "extended_export", song(2, album_name="Album")) for i in range(5)]
    isrcs = [("id1", "X"), ("id2", "X")]
    merged = {r.track_id: r.n for r in _resolved(spark, rows, isrcs).groupBy("track_id").agg(F.count("*").alias("n")).collect()}
    apart = {r.track_id: r.n for r in _resolved(spark, rows, isrcs, merge_versions=False).groupBy("track_id").agg(F.count("*").alias("n")).collect()}
    assert merged == {"id2": 7} and apart == {"id1": 2, "id2": 5}


def test_merged_artists_and_play_index(spark):
    rows = [(600 * i, "extended_export", {"track_name": "S", "artist_name": n}) for i, n in enumerate(["The Band", " the band ", "Band, The"])]
    out = _resolved(spark, rows, merges=[("name:band, the", "name:the band")])
    assert out.select("artist_id", "track_id").distinct().count() == 1
    assert sorted(r.play_index for r in out.collect()) == [1, 2, 3]
    assert op.dimension(out, "artist_id", "artist_name").first().plays == 3
    assert op.aliases(out, "artist_id", "artist_name").count() == 3


def test_watermark(spark):
    e = log(spark, [(0, "scrobble", song(1))])
    assert op.unresolved(e, T0).count() == 0
    assert op.unresolved(e, T0 - timedelta(seconds=1)).count() == 1


def test_export_files(spark, tmp_path):
    row = {"ts": "2024-01-01T10:00:00Z", "spotify_track_uri": "spotify:track:abc", "master_metadata_track_name": "S", "master_metadata_album_artist_name": "A", "ms_played": 31000}
    other = row | {"ts": "2024-01-01T11:00:00Z", "ms_played": None}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/Streaming_History_Audio_1.json").write_text(json.dumps([row, row, other, row | {"spotify_episode_uri": "e"}]))
    (tmp_path / "in/notes.json").write_text("[]")
    staged = ingest.read_export(spark, str(tmp_path), "o")
    empty = spark.createDataFrame([], ingest.EVENTS)
    seen = ingest.preview(staged, empty).first()
    assert (seen["rows"], seen["audio"], seen["repeated_in_file"], seen["already_imported"]) == (4, 3, 1, 0)
    first = ingest.export_events(staged, empty, now())
    assert first.count() == 2
    path = str(tmp_path / "events")
    ingest.write_table(first, path)
    held = spark.read.schema(ingest.EVENTS).parquet(path)
    assert ingest.export_events(staged, held, now()).count() == 0
    assert ingest.preview(staged, held).first()["already_imported"] == 3
    assert ingest.restored(held, held.drop("source_file").withColumn("extra", F.lit(1))).columns == held.columns


def test_polls_and_captures_that_are_known(spark):
    plays = op.normalise(log(spark, [(0, "recently_played_poll", song(1, track_name="Riff (Live)", ms_played=240_000))]))
    polled = spark.createDataFrame([("o", "id1", T0 + timedelta(seconds=s), 240_000) for s in (5, 100)], "owner string, spotify_track_id string, occurred_at timestamp, ms_played long")
    assert [r.occurred_at.second for r in ingest.poll_new(polled, plays).collect()] == [40]
    caught = [(90, "Riff", 0), (-90, "riff", 0), (90, "Other", 0), (-180, "Other", 1), (12_600, "Riff", 1)]
    for seconds, title, left in caught:
        c = spark.createDataFrame([("o", "Band", title, T0 + timedelta(seconds=seconds))], "owner string, artist_name string, track_name string, captured_at timestamp")
        assert ingest.ambient_new(c, plays).count() == left, (seconds, title)


def test_scrobble_inbox(spark):
    devices = spark.createDataFrame(
        [("o", "phone", "Phone", "hour", True, True, True, False, 30), ("o", "car", "Car", "exact", True, True, True, True, None)],
        "owner string, device_id string, name string, ts_precision string, keep_player boolean, keep_service boolean, keep_device boolean, paused boolean, retention_days int",
    )
    at = int((T0 + timedelta(minutes=40) - datetime(1970, 1, 1)).total_seconds())
    one = {"listened_at": at, "track_metadata": {"artist_name": "A", "track_name": "T", "additional_info": {"duration_ms": 1000, "media_player": "mp"}}}
    bodies = [("o", "phone", json.dumps({"listen_type": "single", "payload": [one]})), ("o", "phone", json.dumps({"listen_type": "single", "payload": [one]})), ("o", "car", json.dumps({"listen_type": "single", "payload": [one]})), ("o", "phone", "no json")]
    bodies.append(("o", "phone", json.dumps({"listen_type": "playing_now", "payload": [{"track_metadata": {"artist_name": "N", "track_name": "Now"}}]})))
    plays = op.normalise(spark.createDataFrame([], ingest.EVENTS))
    unpacked = ingest.listens(spark.createDataFrame(bodies, "owner string, device_id string, body string"), devices)
    judged = ingest.verdicts(unpacked, plays)
    counts = {r.device_id: (r.accepted, r.duplicate, r.discarded) for r in ingest.device_counters(judged).collect()}
    assert counts == {"phone": (1, 1, 0), "car": (0, 0, 1)}
    assert ingest.now_playing(unpacked).first().track_name == "Now"
    e = ingest.scrobble_events(judged, now()).collect()
    assert len(e) == 1 and e[0].occurred_at.minute == 0 and json.loads(e[0].payload)["platform"] == "scrobble:Phone"
    old = ingest.scrubbed(ingest.scrobble_events(judged, now()), devices, now()).first()
    assert json.loads(old.payload)["platform"] == "scrobble" and "media_player" not in json.loads(old.payload)


def test_tags_and_weather(spark):
    cases = {"Hip_Hop": "hip-hop", "rap": "hip-hop", "seen live": None, "x" * 41: None, "é" * 21: None, "Synth-Pop": "synth-pop", "synthpop": "synth-pop", " Indie ": "indie rock", "1977": None, "80s": None, "british": None, "2 tone": "2 tone", "": None}
    raw = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    assert [r for r in raw.withColumn("got", ingest.tag(F.col("t"))).collect() if r.got != r.want] == []
    block = json.dumps({"time": ["2024-01-01", "2024-01-03"], "weather_code": [0, 61], "temperature_2m_max": [1.0, 2.0], "precipitation_sum": [0.0, 4.0]})
    d = ingest.daily_weather(spark.createDataFrame([("p", block)], "place string, block string"), "2024-01-02")
    assert [r.kind for r in d.orderBy("day").collect()] == ["observed", "forecast"]
    worse = d.withColumn("kind", F.lit("forecast")).withColumn("code", F.lit(99))
    assert [r.code for r in ingest.merge_weather(d, worse).orderBy("day").collect()] == [0, 99]


def test_polls_are_matched_by_one_shuffle_to_the_edge_of_each_width(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    kind = "owner string, spotify_track_id string, raw_at timestamp, played_at_utc timestamp, source string, ms_played long"
    plays = spark.createDataFrame([("o", "a", at(1000), at(1000), "extended_export", 100_000), ("o", "b", at(1000), at(1100), "recently_played_poll", 100_000), ("o", None, at(0), at(0), "extended_export", 0)], kind)
    asked = [("a", 1015, 1), ("a", 1016, 1), ("a", 885, 1), ("a", 884, 1), ("a", 800, 202_000), ("a", 800, 202_001), ("b", 1015, 1), ("b", 1016, 1), ("b", 1110, 1), ("c", 1000, 1), (None, 0, 0), ("a", 884, 1)]
    polled = spark.createDataFrame([("o", i, at(s), ms) for i, s, ms in asked], "owner string, spotify_track_id string, occurred_at timestamp, ms_played long")
    left = ingest.poll_new(polled, plays)
    got = sorted(((r.spotify_track_id or "", int((r.occurred_at - T0).total_seconds()), r.ms_played) for r in left.collect()))
    assert got == sorted([("a", 1016, 1), ("a", 884, 1), ("a", 884, 1), ("a", 800, 202_001), ("b", 1016, 1), ("b", 1110, 1), ("c", 1000, 1), ("", 0, 0)])
    assert left._jdf.queryExecution().optimizedPlan().toString().count("explode") == 0  # no row of a play is put into buckets
