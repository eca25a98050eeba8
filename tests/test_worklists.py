"""Worklists against a plain loop, and the listener's marks on sessions."""

from datetime import date, datetime, timedelta
from random import Random

from pyspark.sql import functions as F

from playlore.functions.config import Tuning
from playlore.operators import sessions as op
from playlore.sources import worklists as work

TODAY = date(2024, 6, 1)


def plain(entities, attempts, plays, rule, n):
    asked = rule.asked or rule.key
    last = {}
    for a in attempts:
        if a[0] is not None:
            last[a[0]] = max(last.get(a[0], (date.min, "")), (a[2], a[1]))
    counts = {}
    for k, attended in plays:
        if attended or not rule.attended:
            counts[k] = counts.get(k, 0) + 1
    out = []
    for key, code in entities:
        ask = code if asked != rule.key else key
        if key not in counts:
            continue
        if ask not in last:
            out.append((key, counts[key], True))
            continue
        at, state = last[ask]
        if state in rule.again and (TODAY - at).days > rule.again[state]:
            out.append((key, counts[key], False))
    return sorted(out, key=lambda r: (not r[2] if rule.untried_first else 0, -r[1], r[0]))[:n]


def test_every_rule_equals_a_plain_loop(spark):
    for seed, (name, rule) in enumerate(sorted(work.RULES.items())):
        r = Random(seed)
        asked = rule.asked or rule.key
        entities = [(k, f"c{r.randrange(25)}") for k in range(60)]
        ask = lambda: f"c{r.randrange(25)}" if asked != rule.key else r.randrange(70)
        attempts = [(None if r.random() < 0.05 else ask(), r.choice(["found", "missing", "name", "isrc"]), TODAY - timedelta(r.choice([1, 30, 31, 60, 61, 90, 91, 180, 181, 400]))) for _ in range(50)]
        plays = [(r.randrange(50), r.random() < 0.6) for _ in range(400)]
        kind = "string" if asked != rule.key else "int"
        e = spark.createDataFrame(entities, f"{rule.key} int, isrc string")
        a = spark.createDataFrame(attempts, f"{asked} {kind}, state string, at date")
        p = spark.createDataFrame(plays, f"{rule.key} int, attended boolean")
        for n in (5, 1000):
            got = [(x[rule.key], x.plays, x.untried) for x in work.due(e, a, p, rule, str(TODAY), n).collect()]
            assert got == plain(entities, attempts, plays, rule, n), name


def test_nothing_tried_and_nothing_played(spark):
    e = spark.createDataFrame([(1,), (2,)], "track int")
    none, p = spark.createDataFrame([], "track int, state string, at date"), spark.createDataFrame([(2, True)], "track int, attended boolean")
    assert [(r.track, r.untried) for r in work.due(e, none, p, work.RULES["metadata"], str(TODAY), 9).collect()] == [(2, True)]
    assert work.due(e, none, p.limit(0), work.RULES["metadata"], str(TODAY), 9).count() == 0
    assert work.budget(300, 120, 150) == 150 and work.budget(300, 290, 150) == 10 and work.budget(300, 301, 150) == 0


def test_playlists_and_windows(spark):
    rows = [(1, True, "s", "s", date(2024, 1, 1), None), (2, False, "s", None, None, None), (3, True, "s", "r", date(2024, 1, 2), "timed out"), (4, True, "s", None, None, "unreadable: closed"), (5, True, "s", "r", date(2024, 1, 1), None)]
    p = spark.createDataFrame(rows, "playlist int, mine boolean, snapshot string, items_snapshot string, items_synced date, sync_error string").withColumn("first_seen", F.col("playlist"))
    assert [r.playlist for r in work.playlists_due(p).collect()] == [5, 3, 2]
    c = spark.createDataFrame([("a", 500), ("a", 900), ("b", 101), ("c", 50)], "owner string, uts long")
    a = spark.createDataFrame([("a", 100, False), ("b", 100, False), ("c", 100, True), ("d", 100, False)], "owner string, since long, backfilled boolean")
    got = sorted(tuple(r) for r in work.capture_windows(c, a).collect())
    assert got == [("a", "backfill", 100, 499), ("a", "forward", 901, None), ("b", "forward", 102, None), ("c", "forward", 100, None), ("d", "forward", 100, None)]


def test_the_nearest_mark_holds_once(spark):
    t0 = datetime(2024, 3, 1, 20)
    rows = [("o", 1, t0), ("o", 2, t0 + timedelta(minutes=8)), ("p", 1, t0)]
    s = spark.createDataFrame(rows, "owner string, session long, start_at timestamp_ntz")
    sec = lambda n: timedelta(seconds=n)
    marks = [("o", t0 + sec(200), "active"), ("o", t0 - sec(100), "unattended"), ("o", t0 + sec(100), "drifting"), ("o", t0 + sec(480 + 300), "active"), ("p", t0 + sec(301), "active"), ("p", None, "active"), ("p", t0, None)]
    m = spark.createDataFrame(marks, "owner string, start_at timestamp_ntz, attention string")
    assert sorted(tuple(r) for r in op.marks_of(s, m).collect()) == [("o", 1, "drifting"), ("o", 2, "active")]


def test_attention_is_written_back(spark):
    t0 = datetime(2024, 3, 1, 20)
    rows = [("o", d * 10 + i, t0 + timedelta(days=d, minutes=3 * i), i, 0, 0, 1000, False, True, "web") for d in range(3) for i in range(3)]
    p = spark.createDataFrame(rows, "owner string, play_id long, played_at timestamp_ntz, track int, artist int, album int, ms long, skipped boolean, interaction boolean, platform string")
    cut, built = op.marked(p, Tuning()), op.build(p, Tuning())
    marks = spark.createDataFrame([("o", t0, "unattended"), ("o", t0 + timedelta(days=1), "drifting")], "owner string, start_at timestamp_ntz, attention string")
    out = op.written_back(p, cut.filter("play_id < 20"), op.marks_of(built, marks))
    got = {r.play_id: (r.attended, r.idle_min) for r in out.collect()}
    assert all(not got[i][0] for i in (0, 1, 2)) and all(got[i] == (True, 0.0) for i in (10, 11, 12)) and all(got[i] == (True, None) for i in (20, 21, 22))
