"""Worklists, each by its own rule. Orders stand for attempts: the customer's number is what was asked for, the order's state what came of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlore.functions.compat import arg_max
from playlore.plans.base import Catalogue
from playlore.sources import worklists as work

C = Catalogue()
QUERIES, ORACLE = C.queries, C.oracle
TODAY = "2001-09-18"
METHODS = ("isrc", "albums", "owner", "name")
STATES = {"F": "found", "O": "missing", "P": "name"}
SINCE = 725_846_400  # the first second of 1993
_SONGS = "log_ AS (SELECT o_custkey AS track, o_custkey AS artist, 'Brand#' || (11 + o_custkey % 28) AS album, CASE o_orderstatus WHEN 'F' THEN 'found' WHEN 'O' THEN 'missing' WHEN 'P' THEN 'name' END AS state, o_orderdate::DATE AS tried FROM orders), song AS (SELECT *, CASE WHEN track % 10 > 1 THEN name || '|' || album END AS isrc, track % 10 = 0 AS local FROM tracks)"
_LOG = _SONGS + ", act AS (SELECT *, CASE WHEN artist % 3 > 0 THEN 'm' || artist END AS mbid, ['isrc', 'albums', 'owner', 'name'][artist % 4 + 1] AS method FROM artists)"


def _attempts(orders: DataFrame) -> DataFrame:
    state = F.element_at(F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv]), F.col("o_orderstatus"))
    asked = F.col("o_custkey")
    return orders.select(asked.alias("track"), asked.alias("artist"), F.concat(F.lit("Brand#"), (asked % 28 + 11).cast("string")).alias("album"), state.alias("state"), F.to_date("o_orderdate").alias("at"))


def _songs(tracks: DataFrame) -> DataFrame:
    """Tracks with a code, which the local ones and a tenth of the others lack."""
    code = F.when(F.col("track") % 10 > 1, F.concat("name", F.lit("|"), "album"))
    return tracks.select("track", "name", "album", code.alias("isrc"), (F.col("track") % 10 == 0).alias("local"))


def _acts(artists: DataFrame) -> DataFrame:
    """Artists with an entry, which a third lack, and how it was found."""
    method = F.element_at(F.array(*map(F.lit, METHODS)), (F.col("artist") % 4 + 1).cast("int"))
    return artists.select("artist", "artist_name", F.when(F.col("artist") % 3 > 0, F.concat(F.lit("m"), F.col("artist").cast("string"))).alias("mbid"), method.alias("method"))


def _by_code(songs: DataFrame, orders: DataFrame) -> DataFrame:
    """Attempts remembered by code."""
    asked = _attempts(orders).select("track", "state", "at")
    return songs.filter("isrc is not null").select("track", "isrc").join(asked, "track").select("isrc", "state", "at")


def _sql(key: str, base: str, rule: work.Rule, n: int, columns: str, attempts: str = "log_", first: str = "") -> str:
    asked = rule.asked or rule.key
    days = f"CASE state {' '.join(f'WHEN {s!r} THEN {d}' for s, d in rule.again.items())} END" if rule.again else "NULL"
    return f"""{_LOG}, b AS ({base}), a AS (SELECT {asked}, arg_max(state, (tried, state)) AS state, max(tried) AS tried FROM {attempts} WHERE {asked} IS NOT NULL GROUP BY 1), c AS (SELECT {key}, count(*) AS plays FROM plays {'JOIN tracks USING (track) ' if key == 'album' else ''}{'WHERE attended' if rule.attended else ''} GROUP BY 1),
q AS (SELECT b.*, plays, a.{asked} IS NULL AS untried FROM b JOIN c USING ({key}) LEFT JOIN a ON a.{asked} = b.{asked} WHERE a.{asked} IS NULL OR coalesce(DATE '{TODAY}' - tried > {days}, false) ORDER BY {first}{'untried DESC, ' if rule.untried_first else ''}plays DESC, {key} LIMIT {n})
SELECT {columns}, plays, untried FROM q"""


R = work.RULES


def _of_albums(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    return plays.join(tracks.select("track", "album"), "track")


@C.query("w_album_listeners", "plays", "tracks", "artists", "orders", sql=_sql("album", "SELECT album, arg_max(artist, (ms, play_id)) AS artist FROM plays JOIN tracks USING (track) GROUP BY album", R["album_listeners"], 20, "album, artist"))
def album_listeners(plays: DataFrame, tracks: DataFrame, artists: DataFrame, orders: DataFrame) -> DataFrame:
    """Albums whose listeners are unknown or sixty days old, whether they were found or not, with the artist of the longest play."""
    p = _of_albums(plays, tracks)
    base = p.groupBy("album").agg(arg_max(F.col("artist"), F.col("ms"), F.col("play_id")).alias("artist"))
    return work.due(base, _attempts(orders), p, R["album_listeners"], TODAY, 20)


@C.query("w_matches_due", "plays", "artists", "orders", sql=_sql("artist", "SELECT artist, artist_name FROM act WHERE mbid IS NULL", R["match"], 200, "artist, artist_name"))
def matches_due(plays: DataFrame, artists: DataFrame, orders: DataFrame) -> DataFrame:
    """Artists without an entry that were not tried for sixty days."""
    return work.due(_acts(artists).filter("mbid is null").drop("mbid", "method"), _attempts(orders), plays, R["match"], TODAY, 200)


@C.query("w_verify_due", "plays", "artists", "orders", sql=_sql("artist", "SELECT artist, artist_name, mbid FROM act WHERE mbid IS NOT NULL", R["verify"], 200, "artist, artist_name, mbid"))
def verify_due(plays: DataFrame, artists: DataFrame, orders: DataFrame) -> DataFrame:
    """Entries of unknown origin, or found by name alone more than thirty days ago."""
    return work.due(_acts(artists).filter("mbid is not null").drop("method"), _attempts(orders), plays, R["verify"], TODAY, 200)


_CODED = "(SELECT isrc, l.state, l.tried FROM log_ l JOIN song USING (track) WHERE isrc IS NOT NULL)"


@C.query("w_credits_due", "plays", "tracks", "liked", "orders", sql=_sql("track", "SELECT track, isrc FROM song WHERE isrc IS NOT NULL AND NOT local AND track NOT IN (SELECT track FROM liked)", R["credits"], 500, "track, isrc", _CODED))
def credits_due(plays: DataFrame, tracks: DataFrame, liked: DataFrame, orders: DataFrame) -> DataFrame:
    """Tracks with a code that have no credits, and whose code was never asked for, by any of its tracks (W9). Liked tracks stand for those with credits."""
    songs = _songs(tracks)
    base = songs.filter("isrc is not null and not local").join(liked.select("track"), "track", "left_anti").select("track", "isrc")
    return work.due(base, _by_code(songs, orders), plays, R["credits"], TODAY, 500)


@C.query("w_lineage_due", "plays", "tracks", "orders", sql=_sql("track", "SELECT track, isrc FROM song WHERE isrc IS NOT NULL AND NOT local", R["lineage"], 500, "track, isrc", _CODED))
def lineage_due(plays: DataFrame, tracks: DataFrame, orders: DataFrame) -> DataFrame:
    """Tracks whose code was never asked for samples and versions."""
    songs = _songs(tracks)
    return work.due(songs.filter("isrc is not null and not local").select("track", "isrc"), _by_code(songs, orders), plays, R["lineage"], TODAY, 500)


@C.query("w_features_due", "plays", "tracks", "orders", sql=_sql("track", "SELECT track, name, isrc FROM song WHERE name IS NOT NULL", R["features"], 500, "track, name, isrc", first="isrc IS NULL, "))
def features_due(plays: DataFrame, tracks: DataFrame, orders: DataFrame) -> DataFrame:
    """Tracks without audio features, or not found more than ninety days ago; those with a code first, by attended plays."""
    base = _songs(tracks).filter("name is not null").select("track", "name", "isrc")
    return work.due(base, _attempts(orders), plays, R["features"], TODAY, 500, F.col("isrc").isNull())


ROOM = work.budget(per_hour=300, used=120, batch=150)


@C.query("w_metadata_due", "plays", "tracks", "orders", sql=_sql("track", "SELECT track FROM song WHERE NOT local", R["metadata"], ROOM, "track"))
def metadata_due(plays: DataFrame, tracks: DataFrame, orders: DataFrame) -> DataFrame:
    """Tracks that were never looked up, as many as this hour has room for."""
    return work.due(_songs(tracks).filter("not local").select("track"), _attempts(orders), plays, R["metadata"], TODAY, ROOM)


_PLAYLISTS = "pl AS (SELECT c_custkey AS playlist, c_mktsegment = 'BUILDING' AS mine, c_nationkey AS snapshot, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 25 END AS items_snapshot, (SELECT max(o_orderdate)::DATE FROM orders o WHERE o.o_custkey = c.c_custkey) AS items_synced, CASE WHEN c_custkey % 11 = 0 THEN 'unreadable: closed' WHEN c_custkey % 13 = 0 THEN 'timed out' END AS sync_error FROM customer c)"


@C.query("w_playlists_due", "customers", "orders", sql=_PLAYLISTS + " SELECT playlist, mine, strftime(items_synced, '%Y-%m-%d') AS items_synced, (row_number() OVER (PARTITION BY mine ORDER BY items_synced NULLS FIRST, playlist))::INTEGER AS rank FROM pl WHERE (sync_error IS NULL OR sync_error NOT LIKE 'unreadable:%') AND (items_snapshot IS NULL OR items_snapshot <> snapshot)")
def playlists_due(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Playlists to read again, the owner's own and the others each in their order (W16). Customers stand for playlists, their orders for readings."""
    read = orders.groupBy(F.col("o_custkey").alias("playlist")).agg(F.max(F.to_date("o_orderdate")).alias("items_synced"))
    key = F.col("c_custkey")
    error = F.when(key % 11 == 0, "unreadable: closed").when(key % 13 == 0, "timed out")
    held = customers.select(key.alias("playlist"), (F.col("c_mktsegment") == "BUILDING").alias("mine"), F.col("c_nationkey").cast("long").alias("snapshot"), F.when(key % 5 > 0, key % 25).cast("long").alias("items_snapshot"), error.alias("sync_error"), key.alias("first_seen"))
    due = work.playlists_due(held.join(read, "playlist", "left"))
    rank = F.row_number().over(Window.partitionBy("mine").orderBy(F.asc_nulls_first("items_synced"), "playlist"))
    return due.select("playlist", "mine", F.date_format("items_synced", "yyyy-MM-dd").alias("items_synced"), rank.alias("rank"))


@C.query("w_capture_windows", "customers", "orders", sql=f"""h AS (SELECT o_custkey AS owner, max(epoch(o_orderdate))::BIGINT AS newest, min(epoch(o_orderdate))::BIGINT AS oldest FROM orders GROUP BY 1), a AS (SELECT c_custkey AS owner, {SINCE} AS since, c_custkey % 4 = 0 AS backfilled, newest, oldest FROM customer LEFT JOIN h ON owner = c_custkey)
SELECT owner, 'forward' AS kind, coalesce(greatest(newest + 1, since), since)::BIGINT AS first, NULL::BIGINT AS last FROM a UNION ALL SELECT owner, 'backfill', since::BIGINT, oldest - 1 FROM a WHERE NOT backfilled AND oldest > since + 1""")
def capture_windows(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Spans of time to ask a service of captures for (W17). Customers stand for accounts, orders for captures."""
    captures = orders.select(F.col("o_custkey").alias("owner"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("uts"))
    accounts = customers.select(F.col("c_custkey").alias("owner"), F.lit(SINCE).cast("long").alias("since"), (F.col("c_custkey") % 4 == 0).alias("backfilled"))
    return work.capture_windows(captures, accounts)


_SURE = "SELECT artist, mbid FROM act WHERE mbid IS NOT NULL AND method IN ('isrc', 'albums', 'owner')"


@C.query("w_wiki_due", "plays", "artists", "orders", sql=_sql("artist", _SURE, R["wiki"], 200, "artist, mbid"))
def wiki_due(plays: DataFrame, artists: DataFrame, orders: DataFrame) -> DataFrame:
    """Artists with a sure entry whose summary is missing, or due again after 180 days, or 90 where there was none."""
    return work.due(_acts(artists).filter("mbid is not null and method in ('isrc', 'albums', 'owner')").select("artist", "mbid"), _attempts(orders), plays, R["wiki"], TODAY, 200)


@C.query("w_origins_due", "plays", "artists", "orders", sql=_sql("artist", "SELECT artist, mbid FROM act WHERE mbid IS NOT NULL", R["origin"], 200, "artist, mbid", "(SELECT * FROM log_ WHERE state = 'found')"))
def origins_due(plays: DataFrame, artists: DataFrame, orders: DataFrame) -> DataFrame:
    """Artists with an entry and no origin (W18); an origin once stored is never asked for again."""
    return work.due(_acts(artists).filter("mbid is not null").select("artist", "mbid"), _attempts(orders).filter("state = 'found'"), plays, R["origin"], TODAY, 200)


@C.query("w_covers_due", "plays", "tracks", "artists", "orders", sql=_sql("album", "SELECT DISTINCT album FROM song JOIN plays USING (track) JOIN act USING (artist) WHERE mbid IS NOT NULL", R["cover"], 20, "album"))
def covers_due(plays: DataFrame, tracks: DataFrame, artists: DataFrame, orders: DataFrame) -> DataFrame:
    """Albums of artists with an entry, without a cover and never asked for, by attended plays."""
    p = _of_albums(plays, tracks)
    base = p.join(_acts(artists).filter("mbid is not null").select("artist"), "artist").select("album").distinct()
    return work.due(base, _attempts(orders), p, R["cover"], TODAY, 20)
