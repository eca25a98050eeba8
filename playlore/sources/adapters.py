"""The listening roles, read from the driver's tables.

Each table is a function of (spark, sf_dir) and, for the SQL side, a query of the
same rows. Only the columns that a query needs are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Listeners that the line items are dealt to.
OWNERS = 20
#: Like artists on either side; moods and themes of lyrics.
NEAR = 5
MOODS = ("calm", "bleak", "bright", "tender", "angry")
THEMES = ("love", "loss", "city", "road", "night", "home", "money")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a play. Line items have a day only; the minute of the day is derived from their keys."""
    li = _read(spark, sf_dir, "lineitem")
    minute = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 131 + F.col("l_partkey")) % 1440
    at = F.col("l_shipdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minute.cast("int"))
    return li.select(
        (F.col("l_orderkey") % OWNERS).alias("owner"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("play_id"),
        at.alias("played_at"),
        F.to_date("l_shipdate").alias("day"),
        F.floor(minute / 60).cast("int").alias("hour"),
        F.col("l_suppkey").alias("artist"),
        F.col("l_partkey").alias("track"),
        F.floor(F.col("l_extendedprice") * 4).cast("long").alias("ms"),
        (F.col("l_returnflag") == "R").alias("skipped"),
        (F.col("l_discount") < 0.09).alias("attended"),
        F.element_at(F.array(*map(F.lit, ("android", "car", "desktop", "web"))), (F.col("l_orderkey") % 4 + 1).cast("int")).alias("platform"),
        F.col("l_orderkey").alias("order_key"),
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and audio features of a track, from its part."""
    p = _read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("track"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("album"),
        F.lower("p_type").alias("tag"),
        (F.lit(1960) + F.col("p_size")).cast("int").alias("release_year"),
        F.round(60 + F.col("p_partkey") % 120 + F.col("p_size") / 10.0, 3).alias("bpm"),
        F.round((F.col("p_partkey") % 97) / 97.0, 6).alias("energy"),
        F.round(-30 + (F.col("p_partkey") % 53) / 2.0, 3).alias("loudness"),
        (F.col("p_partkey") % 12 + 1).cast("int").alias("key_number"),
        F.when(F.col("p_size") % 2 == 0, F.lit("A")).otherwise(F.lit("B")).alias("key_mode"),
        F.floor(F.col("p_retailprice") * 200).cast("long").alias("duration_ms"),
        (F.col("p_size") % 10 == 0).alias("explicit"),
    )


def artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = _read(spark, sf_dir, "supplier"), _read(spark, sf_dir, "nation")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("artist"), F.col("s_name").alias("artist_name"), F.col("n_name").alias("country"), F.col("n_regionkey").cast("long").alias("scene"), F.greatest(F.floor(F.col("s_acctbal") * 1000), F.lit(0)).cast("long").alias("listeners")
    )


def liked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(owner, track, added): a listener's liked songs, the parts of which an order's line was accepted and is finished."""
    li = _read(spark, sf_dir, "lineitem").filter("l_returnflag = 'A' and l_linestatus = 'F'")
    return li.groupBy((F.col("l_orderkey") % OWNERS).alias("owner"), F.col("l_partkey").alias("track")).agg(F.min(F.to_date("l_shipdate")).alias("added"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(artist, other, match): a table of like artists, those of the next wealth in their country, NEAR either way."""
    s = _read(spark, sf_dir, "supplier")
    ranked = s.select(F.col("s_suppkey").alias("artist"), F.col("s_nationkey").alias("n"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")).alias("rn"))
    steps = F.array(*[F.lit(k) for k in range(-NEAR, NEAR + 1) if k])
    seen = ranked.select("artist", "n", F.explode(steps).alias("step"), "rn").withColumn("at", F.col("rn") + F.col("step"))
    return seen.join(ranked.select(F.col("artist").alias("other"), "n", F.col("rn").alias("at")), ["n", "at"]).select("artist", "other", (F.lit(1.0) / (1 + F.abs("step"))).alias("match"))


def _dealt(spark: SparkSession, sf_dir: str, rows: DataFrame, key: str) -> DataFrame:
    """rows with artist: dealt to all artists in turn by a key. The joined side is one row."""
    n = _read(spark, sf_dir, "supplier").agg((F.max("s_suppkey") + 1).alias("_n"))
    return rows.join(F.broadcast(n)).withColumns({"artist": F.col(key) % F.col("_n"), "turn": F.call_function("div", F.col(key), F.col("_n"))}).drop("_n")


def artist_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(artist, tag, weight): all parts stand for artists in turn, two by their type, the third by its name."""
    p = _dealt(spark, sf_dir, _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), "p_partkey").withColumn("j", (F.col("turn") % 3 + 1).cast("int"))
    named = p.select("artist", F.when(F.col("j") < 3, F.lower("p_type")).otherwise(F.lower("p_name")).alias("tag"), F.floor(F.lit(100) / F.col("j")).cast("int").alias("weight"))
    return named.groupBy("artist", "tag").agg(F.max("weight").alias("weight"))


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(release, artist, released, kind): orders as new records of all artists."""
    o = _dealt(spark, sf_dir, _read(spark, sf_dir, "orders"), "o_custkey")
    return o.select(F.col("o_orderkey").alias("release"), "artist", F.to_date("o_orderdate").alias("released"), F.lower(F.substring("o_orderpriority", 3, 20)).alias("kind"))


def concerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(artist, d): days of concerts, those of orders."""
    return _dealt(spark, sf_dir, _read(spark, sf_dir, "orders"), "o_custkey").select("artist", F.to_date("o_orderdate").alias("d")).distinct()


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log (owner, event_id, event_type, occurred_at, payload ...): every line item as an exported play, some also as a poll or a scrobble, at its start or some minutes later."""
    li = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand"), "l_partkey")
    minute = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 131 + F.col("l_partkey")) % 1440
    end = F.col("l_shipdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minute.cast("int"))
    ms, even, cents = F.floor(F.col("l_extendedprice") * 4).cast("long"), F.col("l_linenumber") % 2 == 0, F.round(F.col("l_discount") * 100).cast("int")
    after = lambda near, far: end - F.make_dt_interval(secs=ms / 1000.0) + F.make_dt_interval(secs=F.when(even, float(near)).otherwise(float(far)))
    key = F.concat_ws("-", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.date_format("l_shipdate", "yyyyMMdd"))
    named = li.select(
        (F.col("l_orderkey") % OWNERS).cast("string").alias("owner"), key.alias("key"), end.alias("end"), after(3, 600).alias("polled"), after(10, 900).alias("scrobbled"), cents.alias("cents"), F.col("l_linenumber").alias("n"),
        F.struct(
            F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("spotify_track_id"), F.col("p_name").alias("track_name"), F.when(F.col("l_linenumber") == 7, F.concat(F.lit("ARTIST "), F.col("l_suppkey").cast("string"))).otherwise(F.concat(F.lit("Artist "), F.col("l_suppkey").cast("string"))).alias("artist_name"),
            F.col("p_brand").alias("album_name"), ms.alias("ms_played"), F.when(F.col("l_returnflag") == "R", "fwdbtn").otherwise("trackdone").alias("end_reason"), F.when(F.col("l_orderkey") % 9 == 0, "JP").otherwise("GB").alias("country"),
        ).alias("p"),
    )

    def event(mark: str, source: str, at: str, held) -> object:
        p = F.col("p").withField("source", F.lit(source))
        p = p.withField("spotify_track_id", F.when(F.col("n") % 3 != 0, F.col("p.spotify_track_id"))) if source == "scrobble" else p
        return F.when(held, F.struct(F.concat(F.lit(mark), "key").alias("event_id"), F.col(at).cast("timestamp").alias("occurred_at"), F.to_json(p).alias("payload"), F.lit(source).alias("source_file")))

    events = F.array(event("x", "extended_export", "end", F.lit(True)), event("q", "recently_played_poll", "polled", F.col("cents") == 5), event("s", "scrobble", "scrobbled", F.col("cents") == 6))
    each = named.select("owner", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e"))
    return each.select("owner", "e.event_id", F.lit("play").alias("event_type"), "e.occurred_at", "e.payload", F.col("e.occurred_at").alias("ingested_at"), "e.source_file")


def scene_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene, label): regions as scenes."""
    return _read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("scene"), F.concat(F.upper(F.substring("r_name", 1, 1)), F.lower(F.substring("r_name", 2, 100))).alias("label"))


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, hidden, valence): hand-made marks on lyrics, from the labels of texts."""
    return _read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("track")).agg((F.max("toxic") == 1).alias("hidden"), F.max(F.when(F.col("quality") == 0, F.lit(-0.5))).alias("valence"))


def lyrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, lang, words, valence, mood, theme): texts as the lyrics of tracks, with moods of a fixed table."""
    d = _read(spark, sf_dir, "documents")
    valence = ((F.coalesce("n_chars", F.lit(0)) * 37) % 201 - 100) / F.lit(100.0)
    mood = F.element_at(F.array(*map(F.lit, MOODS)), (F.col("doc_id") % len(MOODS) + 1).cast("int"))
    theme = F.element_at(F.array(*map(F.lit, THEMES)), (F.coalesce("n_chars", F.lit(0)) % len(THEMES) + 1).cast("int"))
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}]{3,}"), F.lit(0))))
    return d.select(F.col("doc_id").alias("track"), "lang", words.alias("words"), valence.alias("valence"), mood.alias("mood"), theme.alias("theme"))


def stream_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as plays of a listener, for sessions. ms is a whole number of milliseconds."""
    e = _read(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("owner"),
        F.col("event_id").alias("play_id"),
        F.col("ts").cast("timestamp_ntz").alias("played_at"),
        F.get_json_object("props", "$.k").cast("long").alias("track"),
        (F.get_json_object("props", "$.k").cast("long") % 17).alias("artist"),
        (F.get_json_object("props", "$.k").cast("long") % 5).alias("album"),
        F.floor(F.col("value") * 1000).cast("long").alias("ms"),
        (F.col("event_type") == "error").alias("skipped"),
        F.col("event_type").isin("click", "signup").alias("interaction"),
        F.col("event_type").alias("platform"),
    )


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An effective-dated table: each customer's order values from the order's day on."""
    o = _read(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("cust"), F.to_date("o_orderdate").alias("valid_from")).agg(F.max("o_orderkey").alias("rate"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer")


TABLES = {f.__name__: f for f in (plays, tracks, artists, liked, edges, artist_tags, releases, concerts, lyrics, log, scene_names, overrides, stream_plays, rates, documents, embeddings, conversations, orders, customers)}

_MINUTE = "((l_orderkey * 7 + l_linenumber * 131 + l_partkey) % 1440)"
SQL = {
    "plays": f"""SELECT l_orderkey % {OWNERS} AS owner, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS play_id, l_shipdate + to_minutes({_MINUTE}) AS played_at, l_shipdate::DATE AS day,
  ({_MINUTE} // 60)::INTEGER AS hour, l_suppkey AS artist, l_partkey AS track, floor(l_extendedprice * 4)::BIGINT AS ms, l_returnflag = 'R' AS skipped, l_discount < 0.09 AS attended,
  ['android', 'car', 'desktop', 'web'][l_orderkey % 4 + 1] AS platform, l_orderkey AS order_key FROM lineitem""",
    "tracks": """SELECT p_partkey AS track, p_name AS name, p_brand AS album, lower(p_type) AS tag, (1960 + p_size)::INTEGER AS release_year, round(60 + p_partkey % 120 + p_size / 10.0::DOUBLE, 3) AS bpm,
  round((p_partkey % 97) / 97.0::DOUBLE, 6) AS energy, round(-30 + (p_partkey % 53) / 2.0::DOUBLE, 3) AS loudness, (p_partkey % 12 + 1)::INTEGER AS key_number, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END AS key_mode,
  floor(p_retailprice * 200)::BIGINT AS duration_ms, p_size % 10 = 0 AS explicit FROM part""",
    "artists": "SELECT s_suppkey AS artist, s_name AS artist_name, n_name AS country, n_regionkey::BIGINT AS scene, greatest(floor(s_acctbal * 1000), 0)::BIGINT AS listeners FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "liked": f"SELECT l_orderkey % {OWNERS} AS owner, l_partkey AS track, min(l_shipdate)::DATE AS added FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' GROUP BY 1, 2",
    "stream_plays": """SELECT user_id AS owner, event_id AS play_id, ts AS played_at, (props->>'$.k')::BIGINT AS track, (props->>'$.k')::BIGINT % 17 AS artist, (props->>'$.k')::BIGINT % 5 AS album,
  floor(value * 1000)::BIGINT AS ms, event_type = 'error' AS skipped, event_type IN ('click', 'signup') AS interaction, event_type AS platform FROM events""",
    "edges": f"""SELECT a.artist, b.artist AS other, 1.0::DOUBLE / (1 + abs(a.rn - b.rn)) AS match FROM (SELECT s_suppkey AS artist, s_nationkey AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS rn FROM supplier) a
  JOIN (SELECT s_suppkey AS artist, s_nationkey AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS rn FROM supplier) b ON a.n = b.n AND a.rn <> b.rn AND abs(a.rn - b.rn) <= {NEAR}""",
    "artist_tags": """SELECT s_suppkey AS artist, CASE WHEN j < 3 THEN lower(p_type) ELSE lower(p_name) END AS tag, max(100 // j)::INTEGER AS weight
  FROM (SELECT *, p_partkey % n AS s_suppkey, p_partkey // n % 3 + 1 AS j FROM part, (SELECT max(s_suppkey) + 1 AS n FROM supplier)) GROUP BY 1, 2""",
    "releases": "SELECT o_orderkey AS release, o_custkey % (SELECT max(s_suppkey) + 1 FROM supplier) AS artist, o_orderdate::DATE AS released, lower(substr(o_orderpriority, 3, 20)) AS kind FROM orders",
    "concerts": "SELECT DISTINCT o_custkey % (SELECT max(s_suppkey) + 1 FROM supplier) AS artist, o_orderdate::DATE AS d FROM orders",
    "lyrics": f"""SELECT doc_id AS track, lang, list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}]{{3,}}'))) AS words, ((coalesce(n_chars, 0) * 37) % 201 - 100) / 100.0::DOUBLE AS valence,
  {list(MOODS)}[doc_id % {len(MOODS)} + 1] AS mood, {list(THEMES)}[coalesce(n_chars, 0) % {len(THEMES)} + 1] AS theme FROM documents""",
    "log": f"""SELECT owner, mark || key AS event_id, source, CASE mark WHEN 'x' THEN ended ELSE ended - to_milliseconds(ms) + to_seconds(CASE WHEN n % 2 = 0 THEN near ELSE far END) END AS raw_at, CASE WHEN mark <> 's' OR n % 3 <> 0 THEN 't' || track END AS track_id,
  p_name AS track_name, CASE WHEN n = 7 THEN 'ARTIST ' ELSE 'Artist ' END || artist AS artist_name, p_brand AS album_name, ms, end_reason, country
  FROM (SELECT (l_orderkey % {OWNERS})::VARCHAR AS owner, (l_orderkey * 10 + l_linenumber)::VARCHAR || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS key, l_shipdate + to_minutes({_MINUTE}) AS ended, l_linenumber AS n, l_partkey AS track, p_name, l_suppkey AS artist, p_brand, floor(l_extendedprice * 4)::BIGINT AS ms,
    CASE WHEN l_returnflag = 'R' THEN 'fwdbtn' ELSE 'trackdone' END AS end_reason, CASE WHEN l_orderkey % 9 = 0 THEN 'JP' ELSE 'GB' END AS country, round(l_discount * 100)::INTEGER AS cents FROM lineitem JOIN part ON p_partkey = l_partkey),
  (VALUES ('x', 'extended_export', -1, 0, 0), ('q', 'recently_played_poll', 5, 3, 600), ('s', 'scrobble', 6, 10, 900)) k(mark, source, c, near, far) WHERE c = -1 OR c = cents""",
    "scene_names": "SELECT r_regionkey::BIGINT AS scene, upper(r_name[1]) || lower(r_name[2:]) AS label FROM region",
    "overrides": "SELECT doc_id AS track, max(toxic) = 1 AS hidden, max(CASE WHEN quality = 0 THEN -0.5::DOUBLE END) AS valence FROM labels GROUP BY doc_id",
    "rates": "SELECT o_custkey AS cust, o_orderdate::DATE AS valid_from, max(o_orderkey) AS rate FROM orders GROUP BY 1, 2",
}
