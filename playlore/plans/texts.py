"""Queries over texts, audio features, vectors and effective-dated tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlore.functions.compat import share
from playlore.functions.config import Lens
from playlore.operators import text as op
from playlore.operators.harmonic import key_distance, tempo_distance
from playlore.operators.joins import asof_join, near_in_time, top_by
from playlore.operators.vectors import entropy
from playlore.plans.base import Catalogue

C = Catalogue()
QUERIES, ORACLE = C.queries, C.oracle
ALL = Lens()

_TERMS = "t AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}]{3,}')) AS term FROM documents), c AS (SELECT doc_id, lang, term, count(*) AS tf FROM t GROUP BY ALL)"
_TFIDF = _TERMS + """, n AS (SELECT lang, count(DISTINCT doc_id) AS n FROM c GROUP BY 1), d AS (SELECT lang, term, count(*) AS df FROM c GROUP BY ALL),
k AS (SELECT doc_id, lang, c.term, tf, round(tf * ln(greatest(n, 2) / df), 6) AS score, (row_number() OVER (PARTITION BY doc_id ORDER BY round(tf * ln(greatest(n, 2) / df), 6) DESC, tf DESC, c.term))::INTEGER AS rank FROM c JOIN d USING (lang, term) JOIN n USING (lang) WHERE df < 0.35 * greatest(n, 2) QUALIFY rank <= 15)"""


@C.query("v_keywords", "documents", sql=_TFIDF + " SELECT doc_id, lang, term, tf, score, rank FROM k")
def keywords(documents: DataFrame) -> DataFrame:
    """Each text's fifteen terms of the highest TF-IDF within its language (V6)."""
    return op.tf_idf(op.terms(documents, "doc_id", F.col("text"), "lang"), "doc_id", "lang").select("doc_id", "lang", "term", "tf", "score", "rank")


@C.query("f_word_cloud", "documents", sql=_TFIDF + " SELECT lang, term, count(*) AS docs, round(sum(score), 4) AS weight FROM k GROUP BY ALL HAVING count(*) >= 5")
def word_cloud(documents: DataFrame) -> DataFrame:
    """Keywords of all texts of a language (F103)."""
    k = op.tf_idf(op.terms(documents, "doc_id", F.col("text"), "lang"), "doc_id", "lang")
    return k.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("docs"), F.round(F.sum("score"), 4).alias("weight")).filter("docs >= 5")


@C.query("f_languages", "documents", sql="SELECT lang, count(*) AS docs, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def languages(documents: DataFrame) -> DataFrame:
    return documents.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))


@C.query("f_text_neighbours", "documents", sql=_TFIDF + """, x AS (SELECT doc_id, list(term ORDER BY term) AS terms FROM k WHERE rank <= 5 GROUP BY 1), g AS (SELECT terms, min(doc_id) AS doc_id, count(*) AS size FROM x GROUP BY 1 HAVING len(terms) >= 3)
SELECT a.doc_id AS a, b.doc_id AS b, a.size AS copies_a, b.size AS copies_b, len(list_intersect(a.terms, b.terms))::INTEGER AS shared FROM g a JOIN g b ON a.doc_id < b.doc_id AND len(list_intersect(a.terms, b.terms)) >= 3""")
def neighbours(documents: DataFrame) -> DataFrame:
    """Texts that share three of their five best keywords (F114): those with the same five are one class, and classes meet by their triples."""
    k = op.tf_idf(op.terms(documents, "doc_id", F.col("text"), "lang"), "doc_id", "lang", top=5)
    x = k.groupBy("doc_id").agg(F.array_sort(F.collect_list("term")).alias("terms")).filter(F.size("terms") >= 3)
    g = x.groupBy("terms").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("size"))
    triples = F.array(*[F.concat_ws(" ", F.get("terms", F.lit(i)), F.get("terms", F.lit(j)), F.get("terms", F.lit(m))) for i in range(5) for j in range(i + 1, 5) for m in range(j + 1, 5)])
    whole = F.filter(triples, lambda t: F.size(F.split(t, " ")) == 3)
    side = lambda s: g.select(F.explode(whole).alias("triple"), F.col("doc").alias(s), F.col("terms").alias(f"terms_{s}"), F.col("size").alias(f"copies_{s}"))
    pairs = side("a").join(side("b"), "triple").filter("a < b").drop("triple").distinct()
    return pairs.select("a", "b", "copies_a", "copies_b", F.size(F.array_intersect("terms_a", "terms_b")).alias("shared"))


@C.query("f_text_links", "documents", sql=_TFIDF + """, x AS (SELECT doc_id, list(term ORDER BY term) AS terms FROM k WHERE rank <= 5 GROUP BY 1 HAVING count(*) >= 3), g AS (SELECT terms, min(doc_id) AS class, count(*) AS size FROM x GROUP BY 1),
l AS (SELECT a.terms, count(*) AS links, sum(b.size) AS docs FROM g a JOIN g b ON a.class <> b.class AND len(list_intersect(a.terms, b.terms)) >= 3 GROUP BY 1)
SELECT doc_id, class, size AS copies, coalesce(links, 0) AS links, coalesce(docs, 0)::BIGINT AS linked_docs FROM x JOIN g USING (terms) LEFT JOIN l USING (terms)""")
def text_links(documents: DataFrame) -> DataFrame:
    """Each text's class of equal keywords, and how many classes and texts share three of its five (F114), without a pair being formed.

    Counts of subsets of three, four and five terms, weighted 1, -3 and 6, add up to one for each class that shares three or
    more, whether it shares 3, 4 or 5. So a frequent triple costs as much as a rare one: one row a class.
    """
    k = op.tf_idf(op.terms(documents, "doc_id", F.col("text"), "lang"), "doc_id", "lang", top=5)
    x = k.groupBy("doc_id").agg(F.array_sort(F.collect_list("term")).alias("terms")).filter(F.size("terms") >= 3)
    g = x.groupBy("terms").agg(F.min("doc_id").alias("class"), F.count(F.lit(1)).alias("size"))
    chosen = [F.struct(F.concat_ws(" ", *[F.get("terms", F.lit(i)) for i in some]).alias("some"), F.when(F.lit(max(some)) < F.size("terms"), F.lit(w)).alias("w")) for n, w in ((3, 1), (4, -3), (5, 6)) for some in combinations(range(5), n)]
    parts = g.select("class", "size", F.explode(F.filter(F.array(*chosen), lambda s: s["w"].isNotNull())).alias("s")).select("class", "size", "s.*")
    counted = parts.groupBy("some").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("d"))
    sums = parts.join(counted, "some").groupBy("class", "size").agg((F.sum(F.col("w") * F.col("n")) - 1).alias("links"), F.sum(F.col("w") * F.col("d")).alias("d"))
    linked = g.select("terms", "class").join(sums, "class")
    return x.join(linked, "terms").select("doc_id", "class", F.col("size").alias("copies"), "links", (F.col("d") - F.col("size")).alias("linked_docs"))


@C.query("f_wordiness", "documents", sql=_TERMS + " SELECT doc_id, sum(tf)::BIGINT AS words, count(*) AS terms, count(*)::DOUBLE / sum(tf)::DOUBLE AS richness FROM c GROUP BY doc_id HAVING sum(tf) >= 50")
def wordiness(documents: DataFrame) -> DataFrame:
    """Words, and how many of them differ (F110)."""
    c = op.terms(documents, "doc_id", F.col("text"))
    return c.groupBy("doc_id").agg(F.sum("tf").alias("words"), F.count(F.lit(1)).alias("terms")).filter("words >= 50").withColumn("richness", F.col("terms").cast("double") / F.col("words"))


@C.query("f_role_transitions", "conversations", sql="t AS (SELECT role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations) SELECT role, next_role, count(*) AS n FROM t WHERE next_role IS NOT NULL GROUP BY ALL")
def role_transitions(conversations: DataFrame) -> DataFrame:
    """Who speaks after whom."""
    t = conversations.withColumn("next_role", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    return t.filter("next_role is not null").groupBy("role", "next_role").agg(F.count(F.lit(1)).alias("n"))


@C.query("f_features_by_year", "plays", "tracks", sql="SELECT year(day)::INTEGER AS year, round(avg(bpm), 4) AS bpm, round(avg(energy), 4) AS energy, round(avg(loudness), 4) AS loudness, avg((key_mode = 'A')::INT) AS minor_share FROM plays JOIN tracks USING (track) WHERE attended GROUP BY 1 HAVING count(*) >= 30")
def features_by_year(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    f = ALL.plays(plays).join(tracks, "track").groupBy(F.year("day").alias("year"))
    return f.agg(F.round(F.avg("bpm"), 4).alias("bpm"), F.round(F.avg("energy"), 4).alias("energy"), F.round(F.avg("loudness"), 4).alias("loudness"), share(F.col("key_mode") == "A").alias("minor_share"), F.count(F.lit(1)).alias("n")).filter("n >= 30").drop("n")


@C.query("f_energy_by_hour", "plays", "tracks", sql="SELECT hour, count(*) AS plays, round(avg(energy), 4) AS energy, round(avg(bpm), 4) AS bpm FROM plays JOIN tracks USING (track) WHERE attended GROUP BY hour")
def energy_by_hour(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    return ALL.plays(plays).join(tracks, "track").groupBy("hour").agg(F.count(F.lit(1)).alias("plays"), F.round(F.avg("energy"), 4).alias("energy"), F.round(F.avg("bpm"), 4).alias("bpm"))


@C.query("f_key_wheel", "plays", "tracks", sql="SELECT key_number, key_mode, count(*) AS plays FROM plays JOIN tracks USING (track) WHERE attended GROUP BY ALL")
def key_wheel(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    return ALL.plays(plays).join(tracks, "track").groupBy("key_number", "key_mode").agg(F.count(F.lit(1)).alias("plays"))


@C.query("f_adventurousness", "plays", "tracks", sql="""n AS (SELECT owner, least(floor((bpm - 60) / 14), 9)::INTEGER * 100 + key_number * 2 + (key_mode = 'B')::INT AS cell, count(*) AS n FROM plays JOIN tracks USING (track) WHERE attended GROUP BY ALL), p AS (SELECT owner, n / sum(n) OVER (PARTITION BY owner) AS p FROM n)
SELECT owner, round(-sum(p * log2(p)) / log2(240), 6) AS adventurousness FROM p GROUP BY owner""")
def adventurousness(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """Entropy over ten tempos and 24 keys, 1 for an even spread (F121)."""
    cell = F.least(F.floor((F.col("bpm") - 60) / 14), F.lit(9)) * 100 + F.col("key_number") * 2 + (F.col("key_mode") == "B").cast("int")
    n = ALL.plays(plays).join(tracks, "track").groupBy("owner", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("owner")))
    return p.groupBy("owner").agg(F.round(F.sum(-F.col("p") * F.log2("p")) / F.log2(F.lit(240.0)), 6).alias("adventurousness"))


@C.query("f_sound_alike", "tracks", sql="""s AS (SELECT * FROM tracks WHERE track = 7), d AS (SELECT t.track, round(least(abs(log2(t.bpm / s.bpm)) * 12, abs(abs(log2(t.bpm / s.bpm)) - 1) * 12 + 0.15) + abs(t.energy - s.energy) * 4 + abs(t.loudness - s.loudness) / 6
  + least(abs(t.key_number - s.key_number), 12 - abs(t.key_number - s.key_number)) + (t.key_mode <> s.key_mode)::INT, 6) AS distance FROM tracks t, s WHERE t.track <> 7) SELECT track, distance FROM d ORDER BY distance, track LIMIT 12""")
def sound_alike(tracks: DataFrame, seed: int = 7, n: int = 12) -> DataFrame:
    """The tracks nearest to one in tempo, energy, loudness and key (F123). The seed is one row."""
    s = tracks.filter(F.col("track") == seed).select(*[F.col(c).alias(f"s_{c}") for c in ("bpm", "energy", "loudness", "key_number", "key_mode")])
    c = F.col
    d = tempo_distance(c("bpm"), c("s_bpm")) + F.abs(c("energy") - c("s_energy")) * 4 + F.abs(c("loudness") - c("s_loudness")) / 6 + key_distance(c("key_number"), c("key_mode"), c("s_key_number"), c("s_key_mode"))
    return tracks.filter(c("track") != seed).crossJoin(F.broadcast(s.limit(1))).select("track", F.round(d, 6).alias("distance")).orderBy("distance", "track").limit(n)


@C.query("f_mix_into", "tracks", sql="""s AS (SELECT * FROM tracks WHERE track = 7) SELECT t.track FROM tracks t, s WHERE t.track <> 7 AND (abs(t.bpm / s.bpm - 1) <= 0.06 OR abs(t.bpm * 2 / s.bpm - 1) <= 0.06 OR abs(t.bpm / (s.bpm * 2) - 1) <= 0.06)
  AND least(abs(t.key_number - s.key_number), 12 - abs(t.key_number - s.key_number)) + (t.key_mode <> s.key_mode)::INT <= 1""")
def mix_into(tracks: DataFrame, seed: int = 7) -> DataFrame:
    """Tracks that can follow one without a jolt (F128)."""
    s = F.broadcast(tracks.filter(F.col("track") == seed).limit(1).select(F.col("bpm").alias("s_bpm"), F.col("key_number").alias("s_n"), F.col("key_mode").alias("s_m")))
    near = lambda r: F.abs(r - 1) <= 0.06
    b, sb = F.col("bpm"), F.col("s_bpm")
    t = tracks.filter(F.col("track") != seed).crossJoin(s)
    return t.filter((near(b / sb) | near(b * 2 / sb) | near(b / (sb * 2))) & (key_distance(F.col("key_number"), F.col("key_mode"), F.col("s_n"), F.col("s_m")) <= 1)).select("track")


@C.query("f_tempo_stations", "plays", "tracks", sql="""p AS (SELECT track, count(*) AS plays, avg(skipped::INT) AS sr FROM plays WHERE attended GROUP BY track), b AS (SELECT t.track, floor(bpm / 20)::BIGINT * 20 AS band, plays FROM p JOIN tracks t USING (track) WHERE sr <= 0.35)
SELECT band, track, plays, (row_number() OVER (PARTITION BY band ORDER BY plays DESC, track))::INTEGER AS rank FROM b QUALIFY rank <= 25""")
def tempo_stations(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """The best-liked tracks of each tempo (F126)."""
    p = ALL.plays(plays).groupBy("track").agg(F.count(F.lit(1)).alias("plays"), share(F.col("skipped")).alias("sr")).filter("sr <= 0.35")
    b = p.join(tracks.select("track", "bpm"), "track").select("track", (F.floor(F.col("bpm") / 20) * 20).alias("band"), "plays")
    return top_by(b, ["band"], 25, F.desc("plays"), F.col("track")).select("band", "track", "plays", "rank")


@C.query("f_label_centroids", "embeddings", sql="""e AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1)
SELECT a.label AS a, b.label AS b, round(sum(a.x * b.x) / any_value(na.n * nb.n), 6) AS cos FROM m a JOIN m b ON a.i = b.i AND a.label < b.label JOIN n na ON na.label = a.label JOIN n nb ON nb.label = b.label GROUP BY ALL""")
def label_centroids(embeddings: DataFrame) -> DataFrame:
    """Cosines of the mean vectors of labels."""
    from playlore.operators.vectors import cosine_matrix

    e = embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("value"))
    return cosine_matrix(e, "label", "i")


@C.query("f_asof_rates", "orders", "rates", sql="SELECT o.o_orderkey AS order_key, r.rate FROM (SELECT *, o_orderdate::DATE AS d FROM orders) o ASOF LEFT JOIN (SELECT cust, valid_from + 30 AS f, rate FROM rates) r ON o.o_custkey = r.cust AND o.d >= r.f")
def asof_rates(orders: DataFrame, rates: DataFrame) -> DataFrame:
    """The rate of a customer that held at an order: the latest that was thirty days old (P5's join)."""
    left = orders.select(F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("cust"), F.to_date("o_orderdate").alias("d"))
    right = rates.select("cust", F.date_add("valid_from", 30).alias("f"), "rate")
    return asof_join(left, right, ["cust"], "d", "f", ["rate"]).select("order_key", "rate")


@C.query("f_lonely_events", "stream_plays", sql="SELECT play_id FROM stream_plays a WHERE NOT EXISTS (SELECT 1 FROM stream_plays b WHERE b.owner = a.owner AND b.platform <> a.platform AND abs(epoch_us(a.played_at) - epoch_us(b.played_at)) <= 3600000000)")
def lonely(stream_plays: DataFrame) -> DataFrame:
    """Plays without another kind of play of the same listener within an hour: an anti-join on time."""
    other = stream_plays.select(F.col("owner"), F.col("played_at").alias("other_at"), F.explode(F.filter(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), lambda k: k != F.col("platform"))).alias("platform"))
    return near_in_time(stream_plays, other, ["owner", "platform"], "played_at", "other_at", 3600.0).select("play_id")


@C.query("f_weather_lift", "plays", sql="""d AS (SELECT owner, day, sum(ms)::BIGINT AS ms, ['clear', 'cloud', 'rain', 'snow'][(epoch(day) // 86400 * 7 % 4 + 1)::INTEGER] AS sky FROM plays WHERE attended GROUP BY ALL)
SELECT owner, sky, count(*) AS days, sum(ms) / 60000.0::DOUBLE / count(*) AS minutes_a_day, round((sum(ms)::DOUBLE / count(*)) / (sum(sum(ms)) OVER (PARTITION BY owner)::DOUBLE / sum(count(*)) OVER (PARTITION BY owner)::DOUBLE), 6) AS lift FROM d GROUP BY owner, sky""")
def weather_lift(plays: DataFrame) -> DataFrame:
    """Listening under each sky against the mean day (F142). The sky is made from the day's number."""
    sky = F.element_at(F.array(*map(F.lit, ("clear", "cloud", "rain", "snow"))), (F.unix_date("day") * 7 % 4 + 1).cast("int"))
    d = ALL.plays(plays).groupBy("owner", "day").agg(F.sum("ms").alias("ms")).groupBy("owner", sky.alias("sky")).agg(F.sum("ms").alias("ms"), F.count(F.lit(1)).alias("days"))
    w = Window.partitionBy("owner")
    mean = F.sum("ms").over(w).cast("double") / F.sum("days").over(w)
    return d.select("owner", "sky", "days", (F.col("ms") / F.lit(60_000.0) / F.col("days")).alias("minutes_a_day"), F.round(F.col("ms").cast("double") / F.col("days") / mean, 6).alias("lift"))


@C.query("f_duplicate_versions", "tracks", sql="SELECT name, duration_ms // 10000 AS length_band, count(*) AS versions, array_to_string(list(track ORDER BY track)[1:5], ',') AS tracks FROM tracks GROUP BY ALL HAVING count(*) >= 2")
def duplicate_versions(tracks: DataFrame) -> DataFrame:
    """One song under several ids (F171)."""
    ids = F.slice(F.sort_array(F.collect_list("track")), 1, 5)
    return tracks.groupBy("name", F.floor(F.col("duration_ms") / 10_000).alias("length_band")).agg(F.count(F.lit(1)).alias("versions"), F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("tracks")).filter("versions >= 2")


@C.query("f_overruns", "plays", "tracks", sql="SELECT track, count(*) AS plays, max(ms - duration_ms)::BIGINT AS most FROM plays JOIN tracks USING (track) WHERE ms > 1.1 * duration_ms + 2000 GROUP BY track")
def overruns(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """Plays longer than their track (F169)."""
    return plays.join(tracks.select("track", "duration_ms"), "track").filter(F.col("ms") > 1.1 * F.col("duration_ms") + 2000).groupBy("track").agg(F.count(F.lit(1)).alias("plays"), F.max(F.col("ms") - F.col("duration_ms")).alias("most"))


@C.query("f_integrity", "plays", "tracks", sql="SELECT count(*) AS plays, count(*) FILTER (ms <= 0) AS empty_plays, count(*) FILTER (t.track IS NULL) AS without_track, count(DISTINCT play_id) AS ids FROM plays p LEFT JOIN tracks t USING (track)")
def integrity(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """Counters of what should not be (F170)."""
    known = tracks.select("track", F.lit(True).alias("known"))
    return plays.join(known, "track", "left").agg(F.count(F.lit(1)).alias("plays"), F.count_if(F.col("ms") <= 0).alias("empty_plays"), F.count_if(F.col("known").isNull()).alias("without_track"), F.count_distinct("play_id").alias("ids"))


@C.query("f_playlist_overlap", "plays", sql="""m AS (SELECT DISTINCT owner, artist AS list, track FROM plays), s AS (SELECT owner, list, count(*) AS n FROM m GROUP BY ALL), p AS (SELECT owner, a.list AS a, b.list AS b, count(*) AS shared FROM m a JOIN m b USING (owner, track) WHERE a.list < b.list GROUP BY ALL)
SELECT p.owner, a, b, shared, round(shared / (x.n + y.n - shared), 6) AS jaccard, round(shared / least(x.n, y.n), 6) AS containment FROM p JOIN s x ON x.owner = p.owner AND x.list = a JOIN s y ON y.owner = p.owner AND y.list = b""")
def playlist_overlap(plays: DataFrame) -> DataFrame:
    """A listener's lists that share items, with Jaccard likeness and containment (F173). A track is in few lists, so pairs are few."""
    m = plays.select("owner", F.col("artist").alias("list"), "track").distinct().withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("owner", "list")))
    a, b = m.select("owner", "track", F.col("list").alias("a"), F.col("n").alias("na")), m.select("owner", "track", F.col("list").alias("b"), F.col("n").alias("nb"))
    p = a.join(b, ["owner", "track"]).filter("a < b").groupBy("owner", "a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared"))
    return p.select("owner", "a", "b", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("jaccard"), F.round(F.col("shared") / F.least("na", "nb"), 6).alias("containment"))



@C.query("f_family_tree", "artists", sql="""e AS (SELECT artist AS a, (artist * 7 + 3) % 100 AS b FROM artists UNION SELECT (artist * 7 + 3) % 100, artist FROM artists), r1 AS (SELECT DISTINCT b AS artist FROM e WHERE a = 5 AND b <> 5), r2 AS (SELECT DISTINCT b AS artist FROM e JOIN r1 ON a = r1.artist WHERE b <> 5 AND b NOT IN (SELECT artist FROM r1))
SELECT artist, 1 AS hops FROM r1 UNION ALL SELECT artist, 2 FROM r2""")
def family_tree(artists: DataFrame, root: int = 5) -> DataFrame:
    """Relations up to two steps from an artist (F175)."""
    one = artists.select(F.col("artist").alias("a"), ((F.col("artist") * 7 + 3) % 100).alias("b"))
    e = one.union(one.select("b", "a")).distinct()
    r1 = e.filter((F.col("a") == root) & (F.col("b") != root)).select(F.col("b").alias("artist")).distinct()
    r2 = e.join(r1.withColumnRenamed("artist", "a"), "a", "left_semi").filter(F.col("b") != root).select(F.col("b").alias("artist")).distinct().join(r1, "artist", "left_anti")
    return r1.withColumn("hops", F.lit(1)).unionByName(r2.withColumn("hops", F.lit(2)))


@C.query("f_session_entropy_terms", "documents", sql="n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), p AS (SELECT source, n / sum(n) OVER (PARTITION BY source) AS p FROM n) SELECT source, round(-sum(p * log2(p)), 6) AS entropy, round(max(p), 6) AS top_share FROM p GROUP BY source")
def source_entropy(documents: DataFrame) -> DataFrame:
    """How mixed the languages of a source are."""
    return entropy(documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")), ["source"], "n")
