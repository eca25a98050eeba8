"""Joins, islands, vectors, words and scenes on small tables."""

import math
import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from playlore.functions.config import EraParams, Lens, Tuning
from playlore.operators import derive, islands, joins, text, vectors


def test_asof_takes_the_latest_at_or_before(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 5), (None, 5)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 9, "z")], "k string, s int, v string")
    out = {(r.k, r.t): r.v for r in joins.asof_join(left, right, ["k"], "t", "s", ["v"]).collect()}
    assert out == {("a", 5): "y", ("a", 1): None, ("b", 5): None, (None, 5): None}


def test_near_in_time_is_inclusive(spark):
    t = datetime(2024, 1, 1)
    left = spark.createDataFrame([("k", t), ("k", t + timedelta(seconds=31)), (None, t)], "k string, a timestamp")
    right = spark.createDataFrame([("k", t + timedelta(seconds=15))], "k string, b timestamp")
    assert joins.near_in_time(left, right, ["k"], "a", "b", 15, "left_semi").count() == 1
    assert joins.near_in_time(left, right, ["k"], "a", "b", 15).count() == 2


def test_day_runs(spark):
    d = spark.createDataFrame([("o", date(2024, 1, x)) for x in (1, 2, 2, 3, 5)], "owner string, day date")
    assert sorted(r.length for r in islands.day_runs(d, ["owner"]).collect()) == [1, 3]


def test_runs_of_weeks_need_a_floor_and_a_length(spark):
    """Random weeks against a plain loop."""
    rng = random.Random(11)
    shares = [rng.random() for _ in range(80)]
    first = date(2019, 2, 4)
    w = spark.createDataFrame([("o", first + timedelta(weeks=i), s) for i, s in enumerate(shares)], "owner string, wk date, s double")
    want, length = [], 0
    for i, s in enumerate([*shares, 0.0]):
        if s >= 0.4:
            length += 1
        else:
            if length >= 4:
                want.append((first + timedelta(weeks=i - length), length))
            length = 0
    runs = islands.day_runs(w.filter("s >= 0.4"), ["owner"], "wk", 7).filter("length >= 4").collect()
    assert sorted((r.start, r.length) for r in runs) == want and want


def test_cosines_and_entropy(spark):
    v = spark.createDataFrame([("o", 1, "a", 1.0), ("o", 2, "a", 1.0), ("o", 3, "b", 1.0)], "owner string, p int, d string, value double")
    assert [r.cos for r in vectors.cosine_chain(v, "owner", "p", "d").orderBy("p").collect()] == [None, 1.0, 0.0]
    e = vectors.entropy(v.withColumn("n", F.lit(1)), ["owner"], "n").first()
    assert (e.entropy, e.top_share) == (round(math.log2(3), 6), 0.333333)


def test_tf_idf_is_by_language(spark):
    """Against the formula written out, on random words of two languages."""
    rng = random.Random(12)
    words = {"x": [f"xa{chr(97 + k)}" for k in range(20)], "y": [f"ya{chr(97 + k)}" for k in range(20)]}
    docs = [(i, g, " ".join(rng.choices(words[g], k=6))) for i, g in enumerate(["x"] * 9 + ["y"] * 15)]
    got = {(r.id, r.term): r.score for r in text.tf_idf(text.terms(spark.createDataFrame(docs, "id int, lang string, t string"), "id", F.col("t"), "lang"), "id", "lang").collect()}
    for i, g, t in docs:
        same = [set(u.split()) for _, h, u in docs if h == g]
        for term in set(t.split()):
            df = sum(term in s for s in same)
            if df < 0.35 * len(same):
                assert got[i, term] == round(t.split().count(term) * math.log(len(same) / df), 6)
            else:
                assert (i, term) not in got
    k = spark.createDataFrame([(1, "kept", 5, 2.0, 1), (1, "hidden", 4, 1.0, 2)], "id int, term string, tf int, score double, rank int")
    edits = spark.createDataFrame([(1, "hidden", "hide"), (1, "new", "add")], "id int, term string, action string")
    assert {r.term for r in text.with_edits(k, edits, "id").filter("id = 1").collect()} == {"kept", "new"}


def test_scenes_by_tags_then_origin_and_a_choice_over_both(spark):
    frame = spark.createDataFrame
    tags = frame([("p", "loud", 0.7), ("p", "fast", 0.2), ("q", "soft", 0.1), ("r", "loud", 0.9), ("u", "loud", 0.8)], "artist_id string, tag string, weight double")
    tag_map = frame([("loud", "noise"), ("fast", "noise"), ("soft", "quiet")], "tag string, scene string")
    families = frame([("noise", False), ("quiet", False), ("north", False), ("secret", True)], "scene string, hidden boolean")
    origins = frame([("q", "NO"), ("r", "NO"), ("s", "SE")], "artist_id string, country string")
    origin_map = frame([("NO", "north"), ("SE", "secret")], "country string, scene string")
    chosen = frame([("r", "quiet")], "artist_id string, scene string")
    blocked = frame([("u", "loud")], "artist_id string, tag string")
    out = {(r.artist_id, r.scene): round(r.weight, 3) for r in derive.scenes(tags, tag_map, families, origins, origin_map, chosen, blocked).collect()}
    assert out == {("p", "noise"): 0.9, ("q", "north"): 0.5, ("r", "quiet"): 9.0}


def test_parameters_are_clamped_and_the_lens_reaches_the_scan(spark, tmp_path):
    assert Tuning(short_play_seconds=1).sane().short_play_seconds == 5
    assert EraParams(threshold=7, top_artists=1).sane() == EraParams(threshold=1.0, top_artists=5)
    path = str(tmp_path / "p")
    spark.createDataFrame([(date(2020, 1, 1), True), (date(2021, 1, 1), False)], "day date, attended boolean").write.parquet(path)
    seen = Lens(first_year=2020, last_year=2020).plays(spark.read.parquet(path))
    assert seen.count() == 1
    assert "GreaterThanOrEqual(day,2020-01-01)" in seen._jdf.queryExecution().executedPlan().toString()


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_counts_of_terms_take_one_shuffle_of_texts_and_stay_by_text(spark):
    docs = spark.createDataFrame([(i, "en", f"common words word{i} word{i % 3}") for i in range(20)] + [(3, "en", "again word3")], "id int, lang string, t string")
    counted = text.terms(docs, "id", F.col("t"), "lang")
    assert {(r.term, r.tf) for r in counted.filter("id = 3").collect()} == {("common", 1), ("words", 1), ("word", 3), ("again", 1)}
    ranked = text.tf_idf(counted, "id", "lang")
    assert _shuffles(counted) == 1 and _shuffles(ranked) == 1


def test_spread_makes_parts_of_bounded_size(spark):
    df = joins.spread(spark.range(1000).withColumn("k", F.col("id") % 500), 1000, "k", rows=100)
    assert df.rdd.getNumPartitions() == 10 and joins.spread(spark.range(0), 0, "id").count() == 0
