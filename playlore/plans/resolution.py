"""The way from the event log to resolved plays, step by step, over the whole log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlore.functions.config import Lens, Tuning
from playlore.functions.scratch import forget, new_folder, tidy, written
from playlore.operators import derive, resolve
from playlore.plans.base import Catalogue
from playlore.plans.details import FAMILIES
from playlore.sources import ingest
from playlore.streaming import resolution as live

C = Catalogue()
QUERIES, ORACLE = C.queries, C.oracle
ALL, T = Lens(), Tuning()
#: Artists under two names, and the zones of countries (the log's clock is home's).
MERGES = (("name:artist 3", "name:artist 1"), ("name:artist 8", "name:artist 5"))
ZONES = {"JP": "Asia/Tokyo"}



def timed(log: DataFrame) -> DataFrame:
    """The log as plays stamped at their end; its payloads are parsed once, whatever reads them."""
    return resolve.timed(written(resolve.parsed(log), "parsed-log"))


_NORMAL = f"""n0 AS (SELECT *, CASE WHEN source = 'recently_played_poll' THEN date_diff('millisecond', raw_at, lead(raw_at) OVER (PARTITION BY owner, source ORDER BY raw_at, event_id)) END AS nx FROM log),
n1 AS (SELECT *, coalesce(nx >= 0 AND nx < ms, false) AS cut FROM n0), n2 AS (SELECT *, cut AND nx < ms - {T.poll_skip_slack_ms} AND nx < {T.poll_skip_ratio} * ms AS skip, CASE WHEN cut THEN nx ELSE ms END AS played FROM n1),
plays0 AS (SELECT owner, event_id AS play_id, source, raw_at, track_id AS sid, track_name, artist_name, album_name, country, played AS ms, CASE WHEN skip THEN 'fwdbtn' ELSE end_reason END AS end_reason, skip OR end_reason IN ('fwdbtn', 'backbtn') AS was_skipped,
  CASE WHEN source = 'extended_export' THEN raw_at ELSE raw_at + to_milliseconds(played) END AS ended FROM n2)"""


@C.query("p_normalise", "log", sql=_NORMAL + " SELECT owner, play_id, source, ms AS ms_played, end_reason, was_skipped, ms < 30000 AS under_30s, strftime(ended, '%Y-%m-%d %H:%M:%S') AS ended FROM plays0")
def normalise(log: DataFrame) -> DataFrame:
    """Every event as a play stamped at its end, polls cut by the next."""
    return timed(log).select("owner", "play_id", "source", "ms_played", "end_reason", "was_skipped", "under_30s", F.date_format("played_at_utc", "yyyy-MM-dd HH:mm:ss").alias("ended"))


_KEPT = _NORMAL + """, spans AS (SELECT *, CASE WHEN source = 'extended_export' THEN ended - to_milliseconds(ms) ELSE raw_at END AS began, raw_at + to_milliseconds(ms) AS until, lower(track_name) AS title, lower(artist_name) AS by FROM plays0),
others AS (SELECT * FROM spans WHERE source <> 'scrobble'), near AS (SELECT 0 AS a),
p1 AS (SELECT * FROM spans p WHERE source = 'recently_played_poll' AND NOT EXISTS (SELECT 1 FROM spans e WHERE e.source = 'extended_export' AND e.owner = p.owner AND e.sid = p.sid AND abs(epoch_us(p.raw_at) - epoch_us(e.began)) <= 15000000)
  AND NOT EXISTS (SELECT 1 FROM spans e WHERE e.source = 'extended_export' AND e.owner = p.owner AND e.sid = p.sid AND abs(epoch_us(p.raw_at) - epoch_us(e.ended)) <= 15000000)),
s1 AS (SELECT * FROM spans s WHERE source = 'scrobble' AND sid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM others o WHERE o.owner = s.owner AND o.sid = s.sid AND abs(epoch_us(s.raw_at) - epoch_us(o.began)) <= 30000000) AND NOT EXISTS (SELECT 1 FROM others o WHERE o.owner = s.owner AND o.sid = s.sid AND abs(epoch_us(s.until) - epoch_us(o.raw_at)) <= 30000000)),
s2 AS (SELECT * FROM spans s WHERE source = 'scrobble' AND sid IS NULL AND NOT EXISTS (SELECT 1 FROM others o WHERE o.owner = s.owner AND o.title = s.title AND o.by = s.by AND abs(epoch_us(s.raw_at) - epoch_us(o.began)) <= 30000000) AND NOT EXISTS (SELECT 1 FROM others o WHERE o.owner = s.owner AND o.title = s.title AND o.by = s.by AND abs(epoch_us(s.until) - epoch_us(o.raw_at)) <= 30000000)),
kept AS (SELECT * FROM spans WHERE source = 'extended_export' UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2)"""


@C.query("p_supersede", "log", sql=_KEPT + " SELECT owner, source, count(*) AS plays, sum(ms)::BIGINT AS ms, min(play_id) AS first_id, max(play_id) AS last_id FROM kept GROUP BY owner, source")
def supersede(log: DataFrame) -> DataFrame:
    """What stays when polls give way to exports and scrobbles to both."""
    p = resolve.supersede(timed(log))
    return p.groupBy("owner", "source").agg(F.count(F.lit(1)).alias("plays"), F.sum("ms_played").alias("ms"), F.min("play_id").alias("first_id"), F.max("play_id").alias("last_id"))


_ID = _KEPT + f""", m(from_id, into_id) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in MERGES)}), i0 AS (SELECT k.*, coalesce(into_id, 'name:' || lower(trim(artist_name))) AS artist_id FROM kept k LEFT JOIN m ON from_id = 'name:' || lower(trim(artist_name))),
ided AS (SELECT *, 'name:' || md5(artist_id[6:] || '|' || lower(trim(album_name))) AS album_id, coalesce(sid, 'local:' || md5(artist_id[6:] || '|' || lower(trim(track_name)))) AS track_id, ended + to_hours(CASE country WHEN 'JP' THEN 9 ELSE 0 END) AS played_at FROM i0)"""


def identified(log: DataFrame) -> DataFrame:
    """Surviving plays in local time with canonical ids."""
    frame = log.sparkSession.createDataFrame
    countries = frame(list(ZONES.items()), "country string, zone string")
    placed = resolve.zones(resolve.supersede(timed(log)), None, countries, "UTC")
    return resolve.identify(placed, F.broadcast(frame(list(MERGES), "from_artist_id string, into_artist_id string")))


@C.query("p_identify", "log", sql=_ID + " SELECT owner, play_id, artist_id, album_id, track_id, strftime(played_at, '%Y-%m-%d %H:%M:%S') AS played_at FROM ided")
def identify(log: DataFrame) -> DataFrame:
    """Plays with canonical artists, albums and tracks, in local time."""
    return identified(log).select("owner", "play_id", "artist_id", "album_id", "track_id", F.date_format("played_at", "yyyy-MM-dd HH:mm:ss").alias("played_at"))


@C.query("p_isrc", "log", "tracks", sql=_ID + """, isrc AS (SELECT 't' || track AS track_id, name || '|' || album AS isrc FROM tracks), c AS (SELECT owner, track_id, isrc, count(*) AS n FROM ided JOIN isrc USING (track_id) GROUP BY ALL),
t AS (SELECT owner, track_id, first_value(track_id) OVER (PARTITION BY owner, isrc ORDER BY n DESC, track_id) AS target FROM c) SELECT owner, track_id, target AS into_track FROM t WHERE target <> track_id""")
def isrc(log: DataFrame, tracks: DataFrame) -> DataFrame:
    """Versions of a recording that go to the one most played."""
    plays = identified(log)
    codes = tracks.select(F.concat(F.lit("t"), F.col("track").cast("string")).alias("track_id"), F.concat("name", F.lit("|"), "album").alias("isrc"))
    merged = resolve.merge_isrc(plays.withColumn("was", F.col("track_id")), codes)
    return merged.filter("track_id <> was").select("owner", F.col("was").alias("track_id"), F.col("track_id").alias("into_track")).distinct()


_DIM = lambda key, name: f", sp AS (SELECT owner, {key}, {name} AS name, count(*) AS n, max(played_at) AS last FROM ided WHERE {key} IS NOT NULL GROUP BY ALL) SELECT owner, {key} AS id, arg_max(name, (n, last, name)) AS name, sum(n)::BIGINT AS plays FROM sp GROUP BY owner, {key}"


@C.query("p_artists", "log", sql=_ID + _DIM("artist_id", "artist_name"))
def artists(log: DataFrame) -> DataFrame:
    """Artists under the name most played, the latest of equals."""
    return resolve.dimension(identified(log), "artist_id", "artist_name").select("owner", F.col("artist_id").alias("id"), F.col("artist_name").alias("name"), "plays")


@C.query("p_albums", "log", sql=_ID + _DIM("album_id", "album_name"))
def albums(log: DataFrame) -> DataFrame:
    """Albums under the name most played."""
    return resolve.dimension(identified(log), "album_id", "album_name").select("owner", F.col("album_id").alias("id"), F.col("album_name").alias("name"), "plays")


@C.query("p_tracks", "log", sql=_ID + _DIM("track_id", "track_name"))
def tracks(log: DataFrame) -> DataFrame:
    """Tracks under the name most played."""
    return resolve.dimension(identified(log), "track_id", "track_name").select("owner", F.col("track_id").alias("id"), F.col("track_name").alias("name"), "plays")


_ALIAS = lambda key, name: f", al AS (SELECT owner, {name} AS alias, {key}, count(*) AS n FROM ided WHERE {name} IS NOT NULL GROUP BY ALL) SELECT owner, alias, arg_max({key}, (n, {key})) AS id FROM al GROUP BY owner, alias"


@C.query("p_artist_aliases", "log", sql=_ID + _ALIAS("artist_id", "artist_name"))
def artist_aliases(log: DataFrame) -> DataFrame:
    """Every spelling of an artist (P10)."""
    return resolve.aliases(identified(log), "artist_id", "artist_name").select("owner", "alias", F.col("artist_id").alias("id"))


@C.query("p_track_aliases", "log", sql=_ID + _ALIAS("track_id", "track_name"))
def track_aliases(log: DataFrame) -> DataFrame:
    """Every spelling of a track, with the id it is mostly used for."""
    return resolve.aliases(identified(log), "track_id", "track_name").select("owner", "alias", F.col("track_id").alias("id"))


@C.query("p_play_index", "log", sql=_ID + " SELECT owner, track_id, count(*) AS plays, arg_min(play_id, (played_at, play_id)) AS first_play FROM ided GROUP BY owner, track_id")
def play_index(log: DataFrame) -> DataFrame:
    """Each track's first play, by the place of plays among those of their track."""
    w = Window.partitionBy("owner", "track_id").orderBy("played_at", "play_id")
    nth = identified(log).withColumn("play_index", F.row_number().over(w))
    return nth.groupBy("owner", "track_id").agg(F.max("play_index").cast("long").alias("plays"), F.max(F.when(F.col("play_index") == 1, F.col("play_id"))).alias("first_play"))


_BEFORE = "old AS (SELECT * FROM log WHERE source = 'extended_export' AND raw_at < TIMESTAMP '2000-01-01')"


@C.query("s_poll_new", "log", sql=_NORMAL + """, known AS (SELECT *, CASE WHEN source = 'extended_export' THEN ended - to_milliseconds(ms) ELSE raw_at END AS began FROM plays0 WHERE source = 'extended_export'), q AS (SELECT * FROM log WHERE source = 'recently_played_poll')
SELECT q.owner, q.event_id FROM q WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.owner = q.owner AND k.sid = q.track_id AND abs(epoch_us(q.raw_at + to_milliseconds(q.ms)) - epoch_us(k.ended)) <= 2000000) AND NOT EXISTS (SELECT 1 FROM known k WHERE k.owner = q.owner AND k.sid = q.track_id AND abs(epoch_us(q.raw_at) - epoch_us(k.began)) <= 15000000)
  AND NOT EXISTS (SELECT 1 FROM known k WHERE k.owner = q.owner AND k.sid = q.track_id AND abs(epoch_us(q.raw_at) - epoch_us(k.ended)) <= 15000000)""")
def poll_new(log: DataFrame) -> DataFrame:
    """Polled plays that the exports lack, near in time."""
    both = written(resolve.parsed(log).filter("source in ('recently_played_poll', 'extended_export')").select("owner", "play_id", "source", "raw_at", "spotify_track_id", "ms_played"), "polls-and-exports")
    p = both.filter("source = 'recently_played_poll'").select("owner", F.col("play_id").alias("event_id"), F.col("raw_at").alias("occurred_at"), "spotify_track_id", "ms_played")
    known = both.filter("source = 'extended_export'").withColumn("played_at_utc", F.col("raw_at"))  # an export's stamp is its end
    return ingest.poll_new(p, known).select("owner", "event_id")


@C.query("s_scrobble_new", "log", sql=_KEPT + " SELECT owner, play_id FROM s1 UNION ALL SELECT owner, play_id FROM s2")
def scrobble_new(log: DataFrame) -> DataFrame:
    """Scrobbles that are no other source's play."""
    return resolve.supersede(timed(log)).filter("source = 'scrobble'").select("owner", "play_id")


@C.query("s_blend_import", "log", sql="SELECT lower(trim(artist_name)) AS artist_key, lower(trim(track_name)) AS track_key, count(*) AS plays, sum(ms)::BIGINT AS ms FROM log WHERE source = 'extended_export' AND ms >= 30000 GROUP BY ALL")
def blend_import(log: DataFrame) -> DataFrame:
    """An export summed up by track, for a blend."""
    p = log.withColumn("p", F.from_json("payload", ingest.PAYLOAD)).filter("p.source = 'extended_export'")
    staged = p.select("owner", F.col("occurred_at").alias("ts"), F.lit(None).cast("string").alias("spotify_track_uri"), "p.track_name", "p.artist_name", "p.ms_played", F.lit(False).alias("is_podcast"), F.lit(False).alias("is_audiobook"))
    return ingest.blend_import(staged, "x").select("artist_key", "track_key", "plays", "ms")


@C.query("s_export_insert", "log", sql=_BEFORE + ", k AS (SELECT DISTINCT owner, raw_at, ms FROM old) SELECT owner, count(DISTINCT (raw_at, ms)) AS new_events FROM log l ANTI JOIN k USING (owner, raw_at, ms) WHERE source = 'extended_export' GROUP BY owner")
def export_insert(log: DataFrame) -> DataFrame:
    """How many events an import of the whole export adds to a log that holds what came before 2000."""
    p = log.withColumn("p", F.from_json("payload", ingest.PAYLOAD)).filter("p.source = 'extended_export'")
    fields = [F.col(f"p.{c}") for c in ("track_name", "artist_name", "album_name", "ms_played", "end_reason", "country")]
    staged = p.select("owner", F.col("occurred_at").alias("ts"), F.lit(None).cast("string").alias("spotify_track_uri"), *fields, F.lit(None).cast("string").alias("platform"), F.lit(None).cast("string").alias("start_reason"), F.lit(None).cast("boolean").alias("shuffle"), F.lit(False).alias("is_podcast"), F.lit(False).alias("is_audiobook"), "source_file")
    old = p.filter(F.col("occurred_at") < F.lit("2000-01-01").cast("timestamp")).select("owner", "event_id", "event_type", "occurred_at", "payload", "ingested_at", "source_file")
    return ingest.export_events(staged, old, F.col("ts")).groupBy("owner").agg(F.count(F.lit(1)).alias("new_events"))


_RAW = "CASE WHEN tag = 'economy' THEN 'Hip_Hop' WHEN tag = 'standard' THEN 'seen  LIVE' WHEN tag = 'promo' THEN ' Post-Punk ' ELSE upper(tag) END"


@C.query("w_tags", "artist_tags", sql=f"""t AS (SELECT artist, trim(regexp_replace(regexp_replace(lower({_RAW}), '[_-]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM artist_tags)
SELECT artist, CASE t WHEN 'hip hop' THEN 'hip-hop' WHEN 'post punk' THEN 'post-punk' ELSE t END AS tag FROM t WHERE t <> 'seen live' AND t <> '' AND strlen(t) <= 40""")
def tags(artist_tags: DataFrame) -> DataFrame:
    """Tags in one spelling, noise left out."""
    raw = F.when(F.col("tag") == "economy", "Hip_Hop").when(F.col("tag") == "standard", "seen  LIVE").when(F.col("tag") == "promo", " Post-Punk ").otherwise(F.upper("tag"))
    return artist_tags.select("artist", ingest.tag(raw).alias("tag")).filter("tag is not null")


_WORK = lambda key, done, n: f"d AS ({done}), b AS (SELECT DISTINCT {key} FROM plays), c AS (SELECT {key}, count(*) AS plays FROM plays GROUP BY 1) SELECT {key}, coalesce(plays, 0) AS plays FROM b ANTI JOIN d USING ({key}) LEFT JOIN c USING ({key}) ORDER BY plays DESC, {key} LIMIT {n}"


@C.query("w_artists_without_tags", "plays", "artist_tags", sql=_WORK("artist", "SELECT DISTINCT artist FROM artist_tags WHERE weight = 100 AND tag = 'economy'", 200))
def artists_without_tags(plays: DataFrame, artist_tags: DataFrame) -> DataFrame:
    """Artists to look up next, most played first."""
    done = artist_tags.filter("weight = 100 and tag = 'economy'").select("artist").distinct()
    return ingest.worklist(plays.select("artist").distinct(), done, plays, "artist", "2001-06-01", 200)


@C.query("w_tracks_without_words", "plays", "lyrics", sql=_WORK("track", "SELECT track FROM lyrics WHERE len(words) > 0", 500))
def tracks_without_words(plays: DataFrame, lyrics: DataFrame) -> DataFrame:
    """Tracks to fetch lyrics for next."""
    return ingest.worklist(plays.select("track").distinct(), lyrics.filter(F.size("words") > 0).select("track"), plays, "track", "2001-06-01", 500)


@C.query("w_artists_without_releases", "plays", "releases", sql=_WORK("artist", "SELECT artist FROM releases GROUP BY artist HAVING max(released) >= DATE '2001-09-18' - 60", 200))
def artists_without_releases(plays: DataFrame, releases: DataFrame) -> DataFrame:
    """Artists whose releases are due again after sixty days."""
    tried = releases.groupBy("artist").agg(F.max("released").alias("tried"))
    return ingest.worklist(plays.select("artist").distinct(), tried, plays, "artist", "2001-09-18", 200, retry_days=60)


_FAMILY = "CASE split_part(tag, ' ', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FAMILIES.items()) + " END"


@C.query("p_scenes", "artist_tags", "artists", "overrides", sql=f"""fam AS (SELECT DISTINCT tag, {_FAMILY} AS scene FROM artist_tags WHERE {_FAMILY} IS NOT NULL), ch AS (SELECT track AS artist FROM overrides JOIN artists ON artist = track WHERE hidden),
t AS (SELECT artist, scene, sum(weight / 100.0::DOUBLE) AS weight FROM artist_tags JOIN fam USING (tag) ANTI JOIN ch USING (artist) GROUP BY ALL HAVING sum(weight / 100.0::DOUBLE) >= {T.scene_floor}),
o AS (SELECT artist, 'origin' AS scene, 0.5::DOUBLE AS weight FROM artists a WHERE scene < 3 AND NOT EXISTS (SELECT 1 FROM t WHERE t.artist = a.artist) AND NOT EXISTS (SELECT 1 FROM ch WHERE ch.artist = a.artist))
SELECT artist, scene, round(weight, 6) AS weight FROM t UNION ALL SELECT * FROM o UNION ALL SELECT artist, 'colours', 9.0 FROM ch""")
def scenes(artist_tags: DataFrame, artists: DataFrame, overrides: DataFrame) -> DataFrame:
    """Scenes of artists by tags, by origin for those without, and by the owner's choice in place of both."""
    frame = artists.sparkSession.createDataFrame
    kinds = F.element_at(F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv]), F.split_part("tag", F.lit(" "), F.lit(1)))
    tag_map = artist_tags.select("tag", kinds.alias("scene")).filter("scene is not null").distinct()
    families = frame([(s, False) for s in (*sorted(set(FAMILIES.values())), "origin")], "scene string, hidden boolean")
    tagged = artist_tags.select(F.col("artist").alias("artist_id"), "tag", (F.col("weight") / 100.0).alias("weight"))
    origins = artists.select(F.col("artist").alias("artist_id"), "country")
    origin_map = artists.filter("scene < 3").select("country", F.lit("origin").alias("scene")).distinct()
    chosen = overrides.filter("hidden").select(F.col("track").alias("artist_id")).join(artists.select(F.col("artist").alias("artist_id")), "artist_id").withColumn("scene", F.lit("colours"))
    out = derive.scenes(tagged, tag_map, families, origins, origin_map, chosen, frame([], "artist_id long, tag string"))
    return out.select(F.col("artist_id").alias("artist"), "scene", F.round("weight", 6).alias("weight"))


_CODES = _ID + """, isrc AS (SELECT 't' || track AS track_id, name || '|' || album AS isrc FROM tracks), c AS (SELECT owner, track_id, isrc, count(*) AS n FROM ided JOIN isrc USING (track_id) GROUP BY ALL),
t AS (SELECT owner, track_id, first_value(track_id) OVER (PARTITION BY owner, isrc ORDER BY n DESC, track_id) AS target FROM c)"""


@C.query("p_incremental", "log", "tracks", sql=_CODES + """, merged AS (SELECT i.owner, play_id, coalesce(target, i.track_id) AS track_id, played_at FROM ided i LEFT JOIN t ON t.owner = i.owner AND t.track_id = i.track_id)
SELECT owner, play_id, track_id, (row_number() OVER (PARTITION BY owner, track_id ORDER BY played_at, play_id))::INTEGER AS play_index FROM merged""")
def incremental(log: DataFrame, tracks: DataFrame) -> DataFrame:
    """Resolution in three batches: polls and scrobbles, then the exports that supersede them, old and new (P13-P15). The SQL resolves all at once."""
    spark, codes = log.sparkSession, tracks.select(F.concat(F.lit("t"), F.col("track").cast("string")).alias("track_id"), F.concat("name", F.lit("|"), "album").alias("isrc"))
    frame = spark.createDataFrame
    facts = live.Facts(F.broadcast(frame(list(MERGES), "from_artist_id string, into_artist_id string")), codes, None, frame(list(ZONES.items()), "country string, zone string"))
    store = live.Store(new_folder(spark, "incremental"), buckets=2, parts=2, unit="year")
    export, old = F.col("source_file") == "extended_export", F.col("occurred_at") < F.lit("1995-01-01").cast("timestamp")
    batches = (~export, export & old, export & ~old)
    with tidy(spark):
        events = written(log, "log-events", "zstd")
    for number, part in enumerate(batches):
        live.advance(spark, store, events.filter(part), number, facts, taken=lambda last=number == len(batches) - 1: last and forget(events))
    return live.resolved(spark, store).select("owner", "play_id", "track_id", "play_index")


_AWAY = "a(owner, from_date, to_date, zone) AS (SELECT (o_custkey % 20)::VARCHAR, o_orderdate::DATE, o_orderdate::DATE + (o_orderkey % 40)::INTEGER, CASE o_orderkey % 3 WHEN 0 THEN 'Asia/Tokyo' WHEN 1 THEN 'Asia/Kolkata' ELSE 'UTC' END FROM orders)"


@C.query("p_zones", "log", "orders", sql=_KEPT + ", " + _AWAY + """, z AS (SELECT k.owner, play_id, arg_max(zone, (from_date, zone)) AS zone FROM kept k JOIN a ON a.owner = k.owner AND ended::DATE BETWEEN from_date AND to_date GROUP BY ALL)
SELECT k.owner, play_id, coalesce(zone, CASE country WHEN 'JP' THEN 'Asia/Tokyo' END, 'UTC') AS zone, strftime(ended + to_minutes(CASE coalesce(zone, CASE country WHEN 'JP' THEN 'Asia/Tokyo' END) WHEN 'Asia/Tokyo' THEN 540 WHEN 'Asia/Kolkata' THEN 330 ELSE 0 END), '%Y-%m-%d %H:%M:%S') AS played_at FROM kept k LEFT JOIN z USING (owner, play_id)""")
def zones(log: DataFrame, orders: DataFrame) -> DataFrame:
    """Plays in the zone of the stay that began last, of many that overlap, else of the country, else of home (P2). A stay is an order here."""
    lasts = F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 40).cast("int"))
    zone = F.when(F.col("o_orderkey") % 3 == 0, "Asia/Tokyo").when(F.col("o_orderkey") % 3 == 1, "Asia/Kolkata").otherwise("UTC")
    away = orders.select((F.col("o_custkey") % 20).cast("string").alias("owner"), F.to_date("o_orderdate").alias("from_date"), lasts.alias("to_date"), zone.alias("zone"))
    countries = log.sparkSession.createDataFrame(list(ZONES.items()), "country string, zone string")
    placed = resolve.zones(resolve.supersede(timed(log)), away, countries, "UTC")
    return placed.select("owner", "play_id", "zone", F.date_format("played_at", "yyyy-MM-dd HH:mm:ss").alias("played_at"))
