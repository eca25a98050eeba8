"""Artists in a catalogue against a plain loop; insights whose marks outlive rebuilds."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from playlore.operators import identity, kept


def norm(s):
    return " ".join("".join(c for c in s.lower() if c.isalnum() or c.isspace()).split())


def by_hand(artists, codes, credits, catalogue, albums, titles):
    out = []
    for a, name in artists:
        asked = [c for _, c, _ in sorted(((-p, c, p) for x, c, p in codes if x == a))][:2]
        hits = [(k, pos, e) for k, c in enumerate(asked) for i, pos, n, e in credits if i == c and norm(n) == norm(name)]
        same = sorted(((-s, e) for e, n, al, s in catalogue if s >= 80 and norm(name) and norm(name) in {norm(x) for x in [n, *(al or [])]}))[:10]
        mine = {norm(t) for x, t in albums if x == a}
        shared = [(-sum(norm(t) in mine for x, t in titles if x == e), k, e) for k, (_, e) in enumerate(same[:5])]
        shared = sorted(x for x in shared if x[0])
        if hits:
            out.append((a, min(hits)[2], "isrc", 0))
        elif len(same) == 1:
            out.append((a, same[0][1], "name", 1))
        elif same and shared:
            out.append((a, shared[0][2], "albums", len(same)))
        else:
            out.append((a, None, "ambiguous" if same else "none", len(same)))
    return sorted(out)


def test_matching_equals_a_loop(spark):
    rng = random.Random(6)
    names = ["The Band", "the  band!", "Ärzte", "A-ha", "", "№ 5", "Solo", "Twin", "Nobody"]
    artists = [(i, rng.choice(names)) for i in range(40)] + [(40, "Lone Wolf")]
    codes = [(rng.randrange(40), f"c{rng.randrange(60)}", rng.randrange(1, 4)) for _ in range(60)]
    codes = [(a, c, p) for (a, c), p in {(a, c): p for a, c, p in codes}.items()]
    credits = [(f"c{rng.randrange(60)}", rng.randrange(3), rng.choice(names).upper(), rng.randrange(1000)) for _ in range(40)]
    catalogue = [(e, rng.choice(names[:-1]) if e % 3 else f"other {e}", [rng.choice(names[:-1])] if e % 4 == 0 else None, rng.randrange(60, 101)) for e in range(50)] + [(99, "Solo ", None, 100), (100, "lone  wolf!", None, 80)]
    albums = [(rng.randrange(40), f"LP: {rng.randrange(8)}") for _ in range(80)]
    titles = [(rng.randrange(50), f"lp {rng.randrange(8)}") for _ in range(120)]
    frame = spark.createDataFrame
    given = (
        frame(artists, "artist int, name string"), frame(codes, "artist int, isrc string, plays int"), frame(credits, "isrc string, position int, name string, entry int"), frame(catalogue, "entry int, name string, aliases array<string>, score int"),
        frame(albums, "artist int, title string"), frame(titles, "entry int, title string"),
    )
    got = sorted((r.artist, r.entry, r.method, r.candidates) for r in identity.match(*given).collect())
    want = by_hand(artists, codes, credits, catalogue, albums, titles)
    assert got == want and {w[2] for w in want} == {"isrc", "none", "name", "albums", "ambiguous"} - ({"ambiguous"} - {w[2] for w in want})
    none = identity.match(*[df.limit(0) for df in given])
    assert none.count() == 0 and re.match("artist", none.columns[0])


def insights(spark, rows):
    return spark.createDataFrame([("o", k, "artist", s, dt.date(2024, 1, 1) + dt.timedelta(d), p, sc) for k, s, d, p, sc in rows], "owner string, kind string, subject_type string, subject_id string, period_start date, payload string, score double")


def test_marks_outlive_rebuilds(spark, tmp_path):
    root, today = str(tmp_path / "i"), "2024-02-01"
    first = [("obsession", "a", 0, "x", 5.0), ("obsession", "b", 1, "x", 4.0), ("comeback", "a", 0, "x", 3.0), ("comeback", "old", -300, "x", 99.0), ("earworm", "w", -300, "x", 6.0)]
    kept.rebuild(root, "1", insights(spark, first))
    shown = kept.unseen(kept.load(spark, root), today, 2)
    assert [(r.kind, r.subject_id) for r in shown.orderBy("rank").collect()] == [("obsession", "a"), ("obsession", "b")]
    kept.surface(root, "2", shown)
    again = [("obsession", "a", 0, "other numbers", 1.0), ("obsession", "b", 8, "x", 4.0), ("comeback", "a", 0, "x", 3.0), ("comeback", "a", 0, "x", 2.0)]
    for stamp in ("3", "4"):
        kept.rebuild(root, stamp, insights(spark, again))
        marks = {(r.kind, r.subject_id, r.payload): r.surfaced for r in kept.load(spark, root).collect()}
        assert marks == {("obsession", "a", "other numbers"): True, ("obsession", "b", "x"): False, ("comeback", "a", "x"): False}
    assert [r.subject_id for r in kept.unseen(kept.load(spark, root), today, 1).collect()] == ["b"]
    with pytest.raises(Exception, match="boom"):
        kept.rebuild(root, "5", insights(spark, again).withColumn("score", F.raise_error(F.lit("boom")).cast("double")))
    assert kept.load(spark, root).filter("surfaced").count() == 1


def test_obsessions_and_comebacks_of_the_last_weeks_only(spark):
    day = lambda k: dt.date(2024, 6, 1) - dt.timedelta(k)
    plays = [("o", "burst", day(20))] * 20 + [("o", "steady", day(k)) for k in range(0, 180)] + [("o", "past", day(300))] * 30
    plays += [("o", "back", day(400))] * 19 + [("o", "back", day(3)), ("o", "back", day(2))] + [("o", "rare", day(400)), ("o", "rare", day(3))] + [("o", "long ago", day(900))] * 20 + [("o", "long ago", day(100))]
    df = spark.createDataFrame(plays, "owner string, artist string, day date")
    o = kept.obsessions(df, "2024-06-01").collect()
    assert [(r.subject_id, r.payload, r.score) for r in o] == [("burst", "20|0", 20.0)]
    c = kept.comebacks(df, "2024-06-01").collect()
    assert [(r.subject_id, r.payload) for r in c] == [("back", "397|21")]
