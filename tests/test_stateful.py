"""State in RocksDB: sessions over restarts and late plays equal those of a batch, and details go when a device's retention ends."""

import datetime as dt
import json
import random

import pytest

from playlore.sources.ingest import EVENTS
from playlore.streaming import live, stateful

pytest.importorskip("google.protobuf")
T0 = dt.datetime(2024, 5, 1, 12)


def rows(minutes, owner="o", car=False, source="fixture", first=0):
    payload = json.dumps({"platform": "car radio" if car else "web", "track_name": "x", "media_player": "deck", "isrc": "i"})
    return [(owner, f"{owner}{first + i}", "play", T0 + dt.timedelta(minutes=m), payload, T0, source) for i, m in enumerate(minutes)]


@pytest.fixture(autouse=True)
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    stateful.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def land(spark, folder, data):
    spark.createDataFrame(data, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def by_hand(plays, gap=30, night=45, car=60):
    """(owner, start, plays) of each session, from all plays in order. plays: (owner, minute, car)."""
    out = []
    for o in sorted({p[0] for p in plays}):
        last = None
        for _, m, c in sorted(p for p in plays if p[0] == o):
            if last is not None and m - last[0] < (car if last[1] else night if (T0 + dt.timedelta(minutes=last[0])).hour in (23, 0, 1, 2, 3, 4, 5) else gap):
                out[-1][2] += 1
            else:
                out.append([o, m, 1])
            last = (m, c)
    return sorted(map(tuple, out))


def test_sessions_over_restarts_and_late_plays_equal_a_batch(spark, tmp_path):
    """Each file is a run of its own with the same checkpoint; some plays come after later ones, within the watermark."""
    rng, landing, got = random.Random(3), str(tmp_path / "in"), []
    plays, m = [], {"a": 0, "b": 0}
    for _ in range(40):
        o = rng.choice("ab")
        m[o] += rng.choice([3, 20, 40, 50, 70, 200])
        plays.append((o, m[o], rng.random() < 0.3))
    plays.sort(key=lambda p: p[1])
    for i in range(0, 38, 4):
        plays[i], plays[i + 1] = plays[i + 1], plays[i]
    batches = [plays[i : i + 10] for i in range(0, 40, 10)] + [[("z", 5_000, False)], [("z", 9_000, False)]]

    def take(batch, _):
        got.extend((r.owner, int((r.start - T0).total_seconds() / 60), r.plays) for r in batch.collect())

    for k, batch in enumerate(batches):
        land(spark, landing, [rows([at], o, c, first=1000 * k + i)[0] for i, (o, at, c) in enumerate(batch)])
        stream = stateful.open_sessions(live.event_stream(spark, landing), late="12 hours")
        stateful.run_until_current(stream, "s", str(tmp_path / "c"), take).awaitTermination()
    assert sorted(g for g in got if g[0] != "z") == by_hand(plays)


def test_details_go_when_their_retention_ends(spark, tmp_path):
    landing, table = str(tmp_path / "in"), str(tmp_path / "table")
    devices = spark.createDataFrame([("o", "short", 2), ("o", "long", 400), ("o", "ever", None)], "owner string, device_id string, retention_days int")
    day = 24 * 60

    def run(data):
        land(spark, landing, data)
        live.append_new(live.event_stream(spark, landing), table, str(tmp_path / "c1"), live.by_event_id).awaitTermination()
        stateful.scrub_due(stateful.days_due(live.event_stream(spark, landing), devices), table, str(tmp_path / "c2")).awaitTermination()
        return {(r.source_file, r.event_id): json.loads(r.payload).get("media_player") for r in live.table_of(spark, table).collect()}

    first = [*rows([0, 5], source="scrobble:short"), *rows([1], source="scrobble:long", first=10), *rows([2], source="scrobble:ever", first=20), *rows([3], source="fixture", first=30)]
    assert set(run(first).values()) == {"deck"}
    assert set(run(rows([day], source="scrobble:short", first=40)).values()) == {"deck"}
    run(rows([4 * day + 30], source="scrobble:long", first=50))
    now = run(rows([4 * day + 60], source="scrobble:long", first=60))
    gone = {k for k, v in now.items() if v is None}
    assert gone == {("scrobble:short", "o0"), ("scrobble:short", "o1"), ("scrobble:short", "o40")} and len(now) == 8
