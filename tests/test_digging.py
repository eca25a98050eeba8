"""Songs of owned artists that a listener never heard, in rounds, against a plain loop."""

import datetime as dt
import random
from collections import Counter

from playlore.plans import recs

SCHEMA = "owner long, artist long, track long, day date, ms long, attended boolean"


def test_rounds_of_songs_equal_a_plain_loop(spark, monkeypatch):
    """F32: candidates were all songs of all owned artists. Some listeners know all of an artist's first songs, one knows all, one heard none attended."""
    rng, day, rows = random.Random(32), dt.date(2000, 1, 1), []
    for artist in range(3):
        songs = [100 * artist + k for k in range((60, 5, 30)[artist])]
        for track in songs:
            rows += [(9, artist, track, day, 1, False)] * rng.choice([1, 1, 2, 7])
        for owner, share in ((1, 0.1), (2, 0.8), (3, 1.0), (4, 0.5)):
            known = [t for t in songs if rng.random() < share]
            rows += [(owner, artist, rng.choice(known or songs), day, 1, True) for _ in range(26)]
            rows += [(owner, (artist + 1) % 3 if k % 4 == 0 else artist, t, day, 1, True) for k, t in enumerate(known)]
    n, attended = Counter((a, t) for _, a, t, *_ in rows), [r for r in rows if r[5]]
    own = [k for k, c in Counter((o, a) for o, a, *_ in attended).items() if c >= recs.OWNED]
    mine, want = {(o, t) for o, _, t, *_ in attended}, set()
    for o, a in own:
        free = sorted((-c, t) for (b, t), c in n.items() if b == a and (o, t) not in mine)
        want |= {(o, a, t, -c) for c, t in free[:3]}
    plays, tried, top_by = spark.createDataFrame(rows, SCHEMA), [], recs.top_by
    monkeypatch.setattr(recs, "top_by", lambda df, keys, n, *order, **kw: (tried.append(n), top_by(df, keys, n, *order, **kw))[1])
    for first, rounds in ((2, [2, 32, 512]), (200, [200])):
        tried.clear()
        assert {tuple(r) for r in recs.dig_tracks(plays, first).collect()} == want
        assert tried[::2] == rounds
