"""Resolution by batches against resolution of everything at once; overlapping spans against a plain loop."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from playlore.functions.scratch import written
from playlore.operators import joins, resolve
from playlore.sources.ingest import EVENTS
from playlore.streaming import resolution as live

T0 = dt.datetime(2020, 1, 1)


def event(owner, n, source, at, ms=200_000, track=1, named=True, isrc=None, country="GB"):
    p = {"source": source, "track_name": f"Song {track}", "artist_name": f"{'Band' if n % 5 else 'BAND'} {track % 3}", "album_name": f"Record {track % 4}", "ms_played": ms, "end_reason": "trackdone", "country": country}
    p |= {"spotify_track_id": f"t{track}"} if named else {}
    return (owner, f"{source[0]}{owner}{n}", "play", at, json.dumps(p), at, source)


def history(seed, owners=3, days=6):
    """Exports, with polls and scrobbles of some of them, some near midnight and some that stand alone."""
    rng, rows = random.Random(seed), []
    for o in range(owners):
        for n in range(50):
            end, track = T0 + dt.timedelta(days=rng.randrange(days), seconds=rng.choice([30, 50_000 + 300 * n, 86_390])), rng.randrange(9)
            ms = rng.choice([20_000, 200_000, 4_000_000])
            start = end - dt.timedelta(milliseconds=ms)
            kinds = rng.choice(["e", "ep", "es", "eps", "p", "s", "ps"])
            if "e" in kinds:
                rows.append(event(f"o{o}", n, "extended_export", end, ms, track, country=rng.choice(["GB", "JP"])))
            if "p" in kinds:
                rows.append(event(f"o{o}", n, "recently_played_poll", start + dt.timedelta(seconds=rng.choice([0, 14, 16, 400])), ms, track))
            if "s" in kinds:
                rows.append(event(f"o{o}", n, "scrobble", start + dt.timedelta(seconds=rng.choice([0, 29, 31])), ms, track, named=rng.random() < 0.5))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def facts(spark):
    day = lambda k: T0.date() + dt.timedelta(k)
    stays = [("o0", day(1), day(4), "Asia/Tokyo"), ("o0", day(3), day(4), "America/New_York"), ("o1", day(3), day(4), "Asia/Kolkata")]
    return live.Facts(
        spark.createDataFrame([("name:band 2", "name:band 1")], "from_artist_id string, into_artist_id string"),
        spark.createDataFrame([(f"t{i}", f"code{i // 2}") for i in range(6)], "track_id string, isrc string"),
        spark.createDataFrame(stays, "owner string, from_date date, to_date date, zone string"),
        spark.createDataFrame([("JP", "Asia/Tokyo")], "country string, zone string"),
    )


COLUMNS = ("owner", "play_id", "ms_played", "was_skipped", "zone", "played_at", "artist_id", "album_id", "track_id", "play_index", "is_first")


def rows_of(df, columns=COLUMNS):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def at_once(spark, rows, f):
    return resolve.resolve(spark.createDataFrame(rows, EVENTS), f.merges, f.isrcs, f.overrides, f.countries, f.home)


def same(spark, store, rows, f):
    whole = written(at_once(spark, rows, f), "whole")
    assert rows_of(live.resolved(spark, store)) == rows_of(whole)
    for kind, (id_, name) in live.KINDS.items():
        want = resolve.dimension(whole, id_, name).select("owner", F.col(id_).alias("id"), F.col(name).alias("name"), "plays")
        assert rows_of(live.names(spark, store, kind), ("owner", "id", "name", "plays")) == rows_of(want, ("owner", "id", "name", "plays"))


def files(store, *names):
    return {os.path.join(d, f) for n in names for d, _, fs in os.walk(f"{store.root}/{n}") for f in fs if f.startswith("part-")}


def test_three_batches_and_replays_equal_one_run(spark, tmp_path, facts):
    rows, store = history(1), live.Store(f"{tmp_path}/t", buckets=2, parts=2)
    parts = [rows[:40], rows[40:90] + rows[:5], rows[90:]]
    for n, part in enumerate(parts):
        assert live.advance(spark, store, spark.createDataFrame(part, EVENTS), n, facts)["plays"] > 0
    same(spark, store, rows, facts)
    held = files(store, *live.SCHEMAS)
    assert live.advance(spark, store, spark.createDataFrame(parts[2], EVENTS), 2, facts) == {}
    assert files(store, *live.SCHEMAS) == held
    assert live.advance(spark, store, spark.createDataFrame(rows[:30], EVENTS), 3, facts) == {}  # nothing of it is new
    assert files(store, "plays", "resolved", "spellings", "dimensions", "events") == files(store, "plays", "resolved", "spellings", "dimensions", "events") & held
    assert live.resolved_through(spark, store) == max(r[5] for r in rows)
    other = live.Store(f"{tmp_path}/u", buckets=3, parts=1, unit="month")
    live.rebuild(spark, store, other, facts)
    same(spark, other, rows, facts)


def test_only_touched_partitions_are_written(spark, tmp_path, facts):
    store = live.Store(f"{tmp_path}/t", buckets=4, parts=2)
    rows = history(2)
    live.advance(spark, store, spark.createDataFrame(rows, EVENTS), 0, facts)
    before = files(store, "plays", "resolved", "dimensions")
    extra = [event("o0", 99, "extended_export", T0 + dt.timedelta(days=5, hours=3), track=8)]
    live.advance(spark, store, spark.createDataFrame(extra, EVENTS), 1, facts)
    gone = before - files(store, "plays", "resolved", "dimensions")
    folders = {os.path.relpath(os.path.dirname(f), store.root) for f in gone}
    assert len([f for f in folders if f.startswith("plays/")]) == 1 and len([f for f in folders if f.startswith("resolved/")]) == 1 and len([f for f in folders if f.startswith("dimensions/")]) == 1
    assert any("day=2020-01-06" in f for f in folders)
    same(spark, store, rows + extra, facts)


def test_a_batch_that_breaks_off_is_made_good(spark, tmp_path, facts, monkeypatch):
    rows, put = history(3), live.put
    whole = rows_of(at_once(spark, rows, facts))
    for broken in ("dimensions", "plays"):
        store = live.Store(f"{tmp_path}/{broken}", buckets=1, parts=1, unit="year")
        live.advance(spark, store, spark.createDataFrame(rows[:70], EVENTS), 0, facts)

        def fails(s, name, df, broken=broken):
            if name == broken:
                raise OSError("lost")
            put(s, name, df)

        monkeypatch.setattr(live, "put", fails)
        with pytest.raises(OSError, match="lost"):
            live.advance(spark, store, spark.createDataFrame(rows[70:], EVENTS), 1, facts)
        monkeypatch.setattr(live, "put", put)
        live.advance(spark, store, spark.createDataFrame(rows[70:], EVENTS), 1, facts)
        assert rows_of(live.resolved(spark, store)) == whole


def test_an_export_that_lands_late_replaces_its_poll(spark, tmp_path, facts):
    """By a stream: the poll is there first, its export comes a batch later and ends after midnight."""
    end = T0 + dt.timedelta(days=3, seconds=60)
    poll = event("o0", 1, "recently_played_poll", end - dt.timedelta(seconds=200), 200_000, 7)
    export = event("o0", 1, "extended_export", end, 200_000, 7)
    store, landing = live.Store(f"{tmp_path}/t", buckets=1, parts=1), f"{tmp_path}/in"
    from playlore.streaming.live import event_stream

    for k, rows in enumerate(([poll], [export], [export])):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(landing)
        live.follow(event_stream(spark, landing), store, f"{tmp_path}/c", facts).awaitTermination()
        got = [(r.play_id, r.play_index) for r in live.resolved(spark, store).collect()]
        assert got == [("ro01" if k == 0 else "eo01", 1)]
    assert live.table(spark, store, "events").count() == 2
    assert [(r.id, r.plays) for r in live.names(spark, store, "track").collect()] == [("t7", 1)]


def test_files_of_other_days_are_not_read(spark, tmp_path):
    store = live.Store(f"{tmp_path}/t", buckets=1, parts=1)
    days = spark.createDataFrame([(0, T0.date())], "bucket int, day date")
    live.put(store, "events", spark.createDataFrame([event("o0", n, "scrobble", T0 + dt.timedelta(days=n)) for n in range(9)], EVENTS).withColumns({"bucket": F.lit(0), "day": F.to_date("occurred_at"), "batch": F.lit(0).cast("long")}))
    live.written(days, "days").createOrReplaceTempView("some_days")
    plan = live._of(live.table(spark, store, "events"), spark.table("some_days"))
    assert plan.count() == 1 and "dynamicpruning" in plan._jdf.queryExecution().executedPlan().toString().lower()


def test_cover_of_overlapping_spans_equals_a_loop(spark):
    rng = random.Random(4)
    day = lambda k: T0.date() + dt.timedelta(k)
    spans = [(rng.choice(["a", "b", None]), day(s := rng.randrange(400)), day(s + rng.randrange(-1, 90)), f"z{rng.randrange(5)}") for _ in range(300)]
    points = [(i, rng.choice(["a", "b", "c", None]), day(rng.randrange(500)) if i % 9 else None) for i in range(400)]
    df = joins.latest_cover(spark.createDataFrame(points, "i int, k string, d date"), spark.createDataFrame(spans, "k string, s date, e date, z string"), ["k"], "d", "s", "e", "s", "z")
    best = lambda k, d: max(((s, z) for o, s, e, z in spans if k is not None and d is not None and o == k and s <= d <= e), default=(None, None))[1]
    assert sorted((r.i, r.z) for r in df.collect()) == [(i, best(k, d)) for i, k, d in points]


def test_a_hundred_thousand_spans_of_one_owner_form_no_pairs(spark):
    n = 100_000
    spans = spark.range(n).select(F.lit("a").alias("k"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 3000).cast("int")).alias("s"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 3000 + 1000).cast("int")).alias("e"), F.col("id").cast("string").alias("z"))
    points = spark.range(n).select(F.lit("a").alias("k"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 4500).cast("int")).alias("d"))
    df = joins.latest_cover(points, spans, ["k"], "d", "s", "e", "s", "z")
    assert df.count() == n and df.filter("z is null").count() == points.filter("d > date_add(date'2000-01-01', 3999)").count()


def test_a_batch_leaves_no_scratch_and_its_shuffles_go(spark, tmp_path, facts):
    """results on the way were kept to the session's end, and so were the shuffles of every write."""
    from playlore.functions.scratch import children, shared_dir

    store = live.Store(f"{tmp_path}/t", buckets=2, parts=2)
    before, conf = set(children(spark, shared_dir(spark))), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(conf)
    rows = history(5)
    for n, part in enumerate((rows[:60], rows[60:])):
        live.advance(spark, store, spark.createDataFrame(part, EVENTS), n, facts)
    assert {x for x in set(children(spark, shared_dir(spark))) - before if x.startswith("batch-")} == set()
    assert spark.conf.get(conf) == held
    same(spark, store, rows, facts)


def test_rows_that_differ_are_found_by_key_and_digest(spark):
    """Kept, changed, new and gone rows, with null keys and a null that moves to another column."""
    schema = "bucket int, day date, owner string, play_id string, part int, a string, b string"
    day = T0.date()
    old = [(0, day, "o", "kept", 1, "x", None), (0, day, "o", "moved", 1, "x", None), (0, day, None, "n", 1, "x", "y"), (0, day, "o", "gone", 1, "x", "y")]
    new = [old[0], (0, day, "o", "moved", 1, None, "x"), old[2], (0, day, "o", "new", 2, "x", "y")]
    digest = F.unhex(F.md5(F.to_json(F.struct("a", "b"))))
    came, went = live._differing(*[spark.createDataFrame(x, schema).withColumn("_digest", digest) for x in (new, old)])
    assert sorted((r.play_id, r.a, r.b) for r in came.collect()) == [("moved", None, "x"), ("new", "x", "y")]
    assert sorted(r.play_id for r in went.collect()) == ["gone", "moved"]


def test_whole_rows_go_in_turns_and_are_kept_once(spark, tmp_path, facts, monkeypatch):
    """all plays of a batch were shuffled at once, several times, and kept whole in the plays table as well as resolved."""
    monkeypatch.setattr(live, "TURN", 70)
    monkeypatch.setattr(live, "ROWS", 40)
    rows, store, put, puts, taken = history(6, owners=2), live.Store(f"{tmp_path}/t", buckets=2, parts=2, unit="year"), live.put, [], []

    def seen(s, name, df):
        put(s, name, df)
        puts.append(name)

    monkeypatch.setattr(live, "put", seen)
    for n, part in enumerate((rows[:60], rows[60:] + rows[60:70])):
        live.advance(spark, store, spark.createDataFrame(part, EVENTS), n, facts, taken=lambda: taken.append(puts.count("events")))
    assert taken == [1, 2]  # the batch may go as soon as its events are in
    assert puts.count("resolved") > 2 and puts.count("plays") == 2
    assert {f.name for f in live.table(spark, store, "plays").schema} == {"owner", "play_id", "part", "digest", "bucket", "day"}
    assert live.table(spark, store, "plays").count() == live.table(spark, store, "resolved").count() == len(rows)
    assert rows_of(live.resolved(spark, store)) == rows_of(at_once(spark, rows, facts))


def test_turns_hold_so_many_rows_at_most_but_for_a_single_part(monkeypatch):
    monkeypatch.setattr(live, "TURN", 10)
    assert live._turns({3: 4, 1: 6, 2: 5, 0: 30, 4: 1}) == [[0], [1], [2, 3, 4]]
