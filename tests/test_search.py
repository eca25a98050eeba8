"""The inverted index against scans of all names; roll-ups against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from playlore.operators import rollup, search

ALPHABET = "abAB #-xé"


@pytest.fixture(scope="module")
def names():
    rng = random.Random(1)
    return [("song", str(i), "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(9)))) for i in range(400)] + [("album", "n", None), ("album", "0", ""), ("album", "1", "a"), ("artist", "2", "The  Band—of Bears")]


@pytest.fixture(scope="module")
def index(spark, names, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index"))
    search.write_index(spark.createDataFrame(names, "kind string, id string, name string"), folder)
    return folder


def js_score(query, text):
    """Letter by letter, as the contract of fuzzy search says."""
    q, t = "".join(query.lower().split()), text.lower()
    score, at, run, first = 0, 0, 0, -1
    for c in q:
        i = t.find(c, at)
        if i < 0:
            return None
        first = i if first < 0 else first
        run = run + 1 if i == at else 1
        score += 1 + (3 if i == 0 or t[i - 1] in " \t\n&/·-—(" else 0) + (run if run > 1 else 0)
        at = i + 1
    return round(score + (10 if t.startswith(query.lower()) else 0) - first * 0.2 - (len(t) - len(q)) * 0.02, 6)


def test_search_equals_a_scan(spark, names, index):
    rng = random.Random(2)
    terms = sorted({"".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 5))) for _ in range(40)} | {"zzz", "", "a", "bear", " ab ", "%b"})
    got = sorted((r.term, r.kind, r.id) for r in search.search(spark, index, terms).collect())
    assert got == sorted((t, k, i) for t in terms for k, i, n in names if n is not None and len(t.strip()) > 1 and t.strip().lower() in n.lower())
    assert len(got) > 50


def test_fuzzy_search_equals_a_scan(spark, names, index):
    terms = ["ab", "bx#", "tbb", "a b", "éa", "the  band", "qq"]
    got = {(r.term, r.kind, r.id): round(r.score, 6) for r in search.fuzzy(spark, index, terms).collect()}
    assert got == {(t, k, i): s for t in terms for k, i, n in names if n is not None and (s := js_score(t, n)) is not None}
    assert len(got) > 50


def test_a_search_reads_the_partitions_of_its_grams_alone(spark, index):
    df = search.search(spark, index, ["bear"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(gram)" in plan
    chosen = search.rarest(spark, index, {"bear": {"bea", "ear"}, "none": {"zzz"}})
    assert chosen["bear"] in ("bea", "ear") and chosen["none"] is None
    assert search.search(spark, index, []).count() == search.search(spark, index, ["q"]).count() == 0


def test_periods_from_rollups_equal_plain_sums_and_read_no_plays(spark):
    rng = random.Random(3)
    day = lambda k: dt.date(1999, 12, 1) + dt.timedelta(k)
    plays = [(rng.choice("ab"), day(rng.randrange(700)), rng.randrange(24), rng.randrange(1000), rng.random() < 0.3, rng.randrange(60), rng.choice([None, *range(9)])) for _ in range(1500)]
    r = rollup.build(spark.createDataFrame(plays, "owner string, day date, hour int, ms long, skipped boolean, track long, artist long"), ("track", "artist"))
    periods = [(o, f"{i}", day(s := rng.randrange(-50, 700)), day(s + rng.choice([0, 1, 30, 365, 9000]))) for i in range(40) for o in "abc"] + [("a", "never", day(5), day(4))]
    given = spark.createDataFrame(periods, "owner string, period string, first date, last date")
    late = lambda h: h >= 23 or h < 4
    want = {}
    for o, p, a, z in periods:
        own = [x for x in plays if x[0] == o and a <= x[1] <= z]
        if own:
            firsts = lambda k, o=o: [min(x[1] for x in plays if x[0] == o and x[k] == v) for v in {x[k] for x in plays if x[0] == o} - {None}]
            new = [sum(a <= d <= z for d in firsts(k)) for k in (5, 6)]
            want[o, p] = (len(own), sum(x[3] for x in own), sum(x[4] for x in own), sum(late(x[2]) for x in own), len({x[1] for x in own}), *new, len({x[5] for x in own}), len({x[6] for x in own} - {None}))
    totals = rollup.totals(r, given)
    assert {(x.owner, x.period): (x.plays, x.ms, x.skips, x.late, x.days, x.new_track, x.new_artist, x.tracks, x.artists) for x in totals.collect()} == want
    hours = rollup.clock(r, given).groupBy("owner", "period").agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("ms")).collect()
    assert {(x.owner, x.period): (x.n, x.ms) for x in hours} == {k: (24, v[1]) for k, v in want.items()}
    best = {(x.owner, x.period, x.kind, x.id): x.plays for x in rollup.items(r, given).collect()}
    assert all(n == sum(1 for x in plays if x[0] == o and str(x[5 if k == "track" else 6]) == i and next(a for q in periods if q[:2] == (o, p) for a in [q[2]]) <= x[1] <= next(q[3] for q in periods if q[:2] == (o, p))) for (o, p, k, i), n in list(best.items())[:300])
    assert {f.split("/")[-2].rsplit("-", 1)[0] for f in totals.inputFiles()} == {"rollup-totals", "rollup-sets"}
