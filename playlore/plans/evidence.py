"""Artists looked up in a catalogue by ranked evidence, insights that keep their marks, and tables that come back from a snapshot.

The catalogue stands in for an outside one: entries are customers, with names of suppliers; their titles are orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlore.functions.compat import text
from playlore.functions.config import Lens
from playlore.functions.scratch import new_folder
from playlore.operators import identity, kept
from playlore.plans.base import Catalogue
from playlore.sources import snapshots

C = Catalogue()
QUERIES, ORACLE = C.queries, C.oracle
ALL, TODAY = Lens(), "2001-06-01"


def _padded(n) -> object:
    return F.concat(F.lit("SUPPLIER#"), F.lpad(n.cast("string"), 9, "0"))


def _evidence(plays: DataFrame, tracks: DataFrame, artists: DataFrame, customers: DataFrame, orders: DataFrame) -> dict[str, DataFrame]:
    key = F.col("c_custkey")
    return {
        "artists": artists.select("artist", F.col("artist_name").alias("name")),
        "codes": plays.filter("track % 4 = 0").groupBy("artist", F.concat(F.lit("i"), F.col("track").cast("string")).alias("isrc")).agg(F.count(F.lit(1)).alias("plays")),
        "credits": plays.filter("track % 8 = 0 and artist % 3 = 0").select("track", "artist").distinct().join(artists, "artist").select(F.concat(F.lit("i"), F.col("track").cast("string")).alias("isrc"), F.lit(0).alias("position"), F.upper("artist_name").alias("name"), (F.col("artist") * 3 + F.col("track") % 5).alias("entry")),
        "catalogue": customers.select(key.alias("entry"), _padded(key * 7 % 1301).alias("name"), F.array(_padded(key % 2003)).alias("aliases"), (60 + key % 41).alias("score")),
        "albums": plays.join(tracks.select("track", "album"), "track").select("artist", F.col("album").alias("title")).distinct(),
        "titles": orders.select(F.col("o_custkey").alias("entry"), F.concat(F.lit("BRAND"), (11 + F.col("o_orderkey") % 90).cast("string")).alias("title")),
    }


_NORM = lambda c: f"trim(regexp_replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_MATCH = f"""ar AS (SELECT artist, {_NORM('artist_name')} AS nm FROM artists), codes AS (SELECT artist, 'i' || track AS isrc, count(*) AS plays FROM plays WHERE track % 4 = 0 GROUP BY ALL),
asked AS (SELECT artist, isrc, row_number() OVER (PARTITION BY artist ORDER BY plays DESC, isrc) AS rank FROM codes QUALIFY rank <= {identity.CODES}),
credits AS (SELECT DISTINCT 'i' || track AS isrc, {_NORM('artist_name')} AS nm, artist * 3 + track % 5 AS entry FROM plays JOIN artists USING (artist) WHERE track % 8 = 0 AND artist % 3 = 0),
coded AS (SELECT artist, arg_min(entry, (rank, entry)) AS coded FROM asked JOIN ar USING (artist) JOIN credits USING (isrc, nm) GROUP BY artist),
cat AS (SELECT DISTINCT c_custkey AS entry, 60 + c_custkey % 41 AS score, {_NORM("'SUPPLIER#' || lpad(x::VARCHAR, 9, '0')")} AS nm FROM customer, LATERAL (SELECT unnest([c_custkey * 7 % 1301, c_custkey % 2003]) AS x) WHERE 60 + c_custkey % 41 >= {identity.SCORE}),
same AS (SELECT artist, entry, row_number() OVER (PARTITION BY artist ORDER BY score DESC, entry) AS rank FROM ar JOIN cat USING (nm) QUALIFY rank <= {identity.NAMESAKES}), nn AS (SELECT artist, count(*) AS n, arg_min(entry, rank) AS first FROM same GROUP BY artist),
mine AS (SELECT DISTINCT artist, {_NORM('album')} AS title FROM plays JOIN tracks USING (track)), theirs AS (SELECT o_custkey AS entry, {_NORM("'BRAND' || (11 + o_orderkey % 90)")} AS title FROM orders),
hits AS (SELECT artist, entry, rank, count(*) AS hits FROM same JOIN nn USING (artist) JOIN theirs USING (entry) JOIN mine USING (artist, title) WHERE n > 1 AND rank <= {identity.COMPARED} GROUP BY ALL), titled AS (SELECT artist, arg_min(entry, (-hits, rank)) AS titled FROM hits GROUP BY artist),
m AS (SELECT artist, CASE WHEN coded IS NOT NULL THEN 'isrc' WHEN coalesce(n, 0) = 0 THEN 'none' WHEN n = 1 THEN 'name' WHEN titled IS NOT NULL THEN 'albums' ELSE 'ambiguous' END AS method, coded, first, titled, coalesce(n, 0) AS n FROM ar LEFT JOIN coded USING (artist) LEFT JOIN nn USING (artist) LEFT JOIN titled USING (artist))"""


@C.query("w_catalogue_match", "plays", "tracks", "artists", "customers", "orders", sql=_MATCH + " SELECT artist, CASE method WHEN 'isrc' THEN coded WHEN 'name' THEN first WHEN 'albums' THEN titled END AS entry, method, CASE method WHEN 'isrc' THEN 0 ELSE n END AS candidates FROM m")
def catalogue_match(plays: DataFrame, tracks: DataFrame, artists: DataFrame, customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Each artist's entry in the catalogue, by code, name or albums, or why there is none."""
    return identity.match(**_evidence(plays, tracks, artists, customers, orders))


@C.query("w_catalogue_verify", "plays", "tracks", "artists", "customers", "orders", sql=_MATCH + " SELECT artist, first AS was, coded AS entry FROM m WHERE n > 0 AND coded <> first")
def catalogue_verify(plays: DataFrame, tracks: DataFrame, artists: DataFrame, customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Matches made by the best-ranked name before codes were known, that the codes contradict."""
    e = _evidence(plays, tracks, artists, customers, orders)
    by_name = identity.namesakes(e["artists"], e["catalogue"]).filter("rank = 1").select("artist", "entry", F.lit("name").alias("method"))
    return identity.verify(by_name, identity.by_code(e["artists"], e["codes"], e["credits"]))


def found(plays: DataFrame, today: str) -> DataFrame:
    """Obsessions and comebacks as of a day; thresholds fit the density of these tables."""
    p = ALL.plays(plays).filter(F.col("day") <= F.lit(today).cast("date"))
    return kept.obsessions(p, today, least=2).unionByName(kept.comebacks(p, today, days=60, silent=100, least=3))


_INSIGHTS = lambda name, today: f"""{name}_p AS (SELECT * FROM plays WHERE attended AND day <= DATE '{today}'),
{name}_w AS (SELECT owner, artist, date_trunc('week', day)::DATE AS wk, count(*) AS c FROM {name}_p WHERE DATE '{today}' - day <= 182 GROUP BY ALL), {name}_b AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY owner, artist ORDER BY wk RANGE BETWEEN INTERVAL 91 DAY PRECEDING AND INTERVAL 7 DAY PRECEDING), 0)::BIGINT AS prior FROM {name}_w),
{name}_o AS (SELECT * FROM {name}_b WHERE c >= 2 AND 13 * c >= 5 * prior QUALIFY row_number() OVER (PARTITION BY owner, artist ORDER BY c DESC, wk DESC) = 1),
{name}_d AS (SELECT owner, artist, day, count(*) AS n FROM {name}_p GROUP BY ALL), {name}_f AS (SELECT *, lag(day) OVER (PARTITION BY owner, artist ORDER BY day) AS prev, sum(n) OVER (PARTITION BY owner, artist) AS plays FROM {name}_d),
{name}_c AS (SELECT * FROM {name}_f WHERE DATE '{today}' - day <= 60 AND day - prev >= 100 AND plays >= 3 QUALIFY row_number() OVER (PARTITION BY owner, artist ORDER BY day DESC) = 1),
{name} AS (SELECT owner, 'obsession' AS kind, 'artist' AS subject_type, artist::VARCHAR AS subject_id, wk AS period_start, c || '|' || prior AS payload, c::DOUBLE / greatest(prior::DOUBLE / 13.0::DOUBLE, 1.0::DOUBLE) AS score FROM {name}_o
  UNION ALL SELECT owner, 'comeback', 'artist', artist::VARCHAR, day, (day - prev) || '|' || plays::BIGINT, (day - prev)::DOUBLE / 30.0::DOUBLE FROM {name}_c)"""  # noqa: E731
_BEFORE = "2001-04-01"
_ORDER = "surfaced, score DESC, kind, subject_id, period_start"


@C.query("f_unseen_insights", "plays", sql=f"""{_INSIGHTS('old', _BEFORE)}, {_INSIGHTS('new', TODAY)}, shown AS (SELECT *, false AS surfaced FROM old WHERE DATE '{_BEFORE}' - period_start <= {kept.DAYS} QUALIFY row_number() OVER (PARTITION BY owner ORDER BY {_ORDER}) <= 6),
marked AS (SELECT n.*, s.owner IS NOT NULL AS surfaced FROM new n LEFT JOIN shown s ON s.owner = n.owner AND s.kind = n.kind AND s.subject_id = n.subject_id AND s.period_start = n.period_start)
SELECT owner, kind, subject_id, strftime(period_start, '%Y-%m-%d') AS period_start, payload, score, surfaced, (row_number() OVER (PARTITION BY owner ORDER BY {_ORDER}))::INTEGER AS rank FROM marked WHERE DATE '{TODAY}' - period_start <= {kept.DAYS} QUALIFY rank <= 6""")
def unseen_insights(plays: DataFrame) -> DataFrame:
    """What to show next, two months after six insights were shown and all were found anew."""
    spark, root = plays.sparkSession, new_folder(plays.sparkSession, "insights")
    kept.rebuild(root, "1", found(plays, _BEFORE))
    kept.surface(root, "2", kept.unseen(kept.load(spark, root), _BEFORE))
    kept.rebuild(root, "3", found(plays, TODAY))
    next_ = kept.unseen(kept.load(spark, root), TODAY)
    return next_.select("owner", "kind", "subject_id", text(F.col("period_start")).alias("period_start"), "payload", "score", "surfaced", "rank")


@C.query("s_snapshot_restore", "liked", "artists", sql="SELECT 'liked' AS name, owner::VARCHAR AS a, track::VARCHAR AS b, strftime(added, '%Y-%m-%d') AS c FROM liked UNION ALL SELECT 'artists', artist::VARCHAR, artist_name, NULL FROM artists")
def snapshot_restore(liked: DataFrame, artists: DataFrame) -> DataFrame:
    """Two tables through a snapshot and back, in columns that have changed since."""
    spark, root = liked.sparkSession, new_folder(liked.sparkSession, "snapshots")
    snapshots.snapshot({"liked": liked.limit(0), "artists": artists.limit(0)}, root, "20010601")
    snapshots.snapshot({"liked": liked, "artists": artists}, root, "20010602")
    now = {"artists": spark.createDataFrame([], "artist_name string, artist long, born date")}
    back = snapshots.restore(spark, root, now)
    a = back["liked"].select(F.lit("liked").alias("name"), F.col("owner").cast("string").alias("a"), F.col("track").cast("string").alias("b"), text(F.col("added")).alias("c"))
    return a.unionByName(back["artists"].select(F.lit("artists").alias("name"), F.col("artist").cast("string").alias("a"), F.col("artist_name").alias("b"), text(F.col("born")).alias("c")))
