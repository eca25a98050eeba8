"""Lyrics: songs by word, moods, themes and how they go with plays; audio features by season, artist and session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlore.functions.compat import ratio, share, text
from playlore.functions.config import Lens
from playlore.operators import sessions
from playlore.operators.joins import top_by
from playlore.plans.base import Catalogue
from playlore.plans.sessions import _CUT, STREAM

C = Catalogue()
QUERIES, ORACLE = C.queries, C.oracle
ALL = Lens()
#: Listens on so many tracks' lyrics make a month's weather.
COVER = 15

_USE = "u AS (SELECT track, count(*) AS plays, count(*) FILTER (skipped) AS skips FROM plays WHERE attended GROUP BY track)"


def whole(name: str, times: int) -> Column:
    """A decimal as a whole number, so that sums agree in any order."""
    return F.round(F.col(name) * times).cast("long").alias(name)


def use(plays: DataFrame) -> DataFrame:
    return ALL.plays(plays).groupBy("track").agg(F.count(F.lit(1)).alias("plays"), F.count_if("skipped").alias("skips"))


@C.query("v_lyrics_effective", "lyrics", "overrides", sql="SELECT track, lang, mood, theme, coalesce(o.valence, l.valence) AS valence, o.valence IS NOT NULL AS edited FROM lyrics l LEFT JOIN overrides o USING (track) WHERE NOT coalesce(hidden, false)")
def lyrics_effective(lyrics: DataFrame, overrides: DataFrame) -> DataFrame:
    """Lyrics as the listener's marks leave them (V7): hidden ones gone, a valence by hand before the measured one."""
    o = overrides.select("track", "hidden", F.col("valence").alias("by_hand"))
    kept = lyrics.join(o, "track", "left").filter(~F.coalesce("hidden", F.lit(False)))
    return kept.select("track", "lang", "mood", "theme", F.coalesce("by_hand", "valence").alias("valence"), F.col("by_hand").isNotNull().alias("edited"))


@C.query("f_lyric_tracks", "lyrics", "plays", sql=_USE + ", w AS (SELECT track, unnest(words) AS word FROM lyrics), r AS (SELECT word, track, coalesce(plays, 0) AS plays, count(*) OVER (PARTITION BY word) AS songs, row_number() OVER (PARTITION BY word ORDER BY coalesce(plays, 0) DESC, track) AS rank FROM w LEFT JOIN u USING (track)) SELECT word, track, plays, songs, rank::INTEGER AS rank FROM r WHERE songs >= 3 AND rank <= 3")
def lyric_tracks(lyrics: DataFrame, plays: DataFrame) -> DataFrame:
    """The most played songs of each word that three songs or more have (F39, F104)."""
    w = lyrics.join(use(plays), "track", "left").select("track", F.coalesce("plays", F.lit(0)).alias("plays"), F.explode("words").alias("word"))
    songs = w.groupBy("word").agg(F.count(F.lit(1)).alias("songs")).filter("songs >= 3")
    return top_by(w.join(songs, "word"), ["word"], 3, F.desc("plays"), F.col("track")).select("word", "track", "plays", "songs", "rank")


def folded(term: str) -> list[str]:
    """A term with its plurals and its singular."""
    forms = [term, f"{term}s", f"{term}es"]
    return forms + ([term[:-1]] if term.endswith("s") and len(term) > 3 else [])


@C.query("f_lyric_search", "lyrics", "plays", sql=_USE + f""" SELECT track, CASE WHEN len(list_intersect(words, {folded("that")})) > 0 THEN 'word' ELSE 'theme' END AS found, coalesce(plays, 0) AS plays FROM lyrics LEFT JOIN u USING (track)
WHERE len(list_intersect(words, {folded("that")})) > 0 OR contains(theme, 'that') OR contains(theme, 'ight') ORDER BY plays DESC, track LIMIT 60""")
def lyric_search(lyrics: DataFrame, plays: DataFrame, term: str = "that", part: str = "ight") -> DataFrame:
    """Songs with a word, plurals folded, or with a theme like it."""
    word = F.arrays_overlap("words", F.array(*map(F.lit, folded(term))))
    hit = lyrics.filter(word | F.contains("theme", F.lit(term)) | F.contains("theme", F.lit(part))).select("track", F.when(word, "word").otherwise("theme").alias("found"))
    return hit.join(use(plays), "track", "left").select("track", "found", F.coalesce("plays", F.lit(0)).alias("plays")).orderBy(F.desc("plays"), "track").limit(60)


@C.query("f_lyric_overview", "lyrics", "plays", sql=_USE + " SELECT count(*) AS songs, count(*) FILTER (len(words) > 0) AS with_words, count(*) FILTER (lang IS NULL) AS no_language, count(plays) AS played, (sum(round(valence * 100)::BIGINT * coalesce(plays, 0)))::DOUBLE / (sum(coalesce(plays, 0)))::DOUBLE / 100 AS valence FROM lyrics LEFT JOIN u USING (track)")
def lyric_overview(lyrics: DataFrame, plays: DataFrame) -> DataFrame:
    """How far lyrics cover what is played, and their valence by plays (F105)."""
    n = F.coalesce("plays", F.lit(0))
    j = lyrics.join(use(plays), "track", "left")
    return j.agg(F.count(F.lit(1)).alias("songs"), F.count_if(F.size("words") > 0).alias("with_words"), F.count_if(F.col("lang").isNull()).alias("no_language"), F.count("plays").alias("played"), (F.sum(F.round(F.col("valence") * 100).cast("long") * n).cast("double") / F.sum(n).cast("double") / 100).alias("valence"))


@C.query("f_lyric_moods", "lyrics", "plays", sql="SELECT owner, mood, count(*) AS plays, avg(skipped::INT) AS skip_rate FROM plays JOIN lyrics USING (track) WHERE attended GROUP BY ALL")
def lyric_moods(lyrics: DataFrame, plays: DataFrame) -> DataFrame:
    """Plays of each mood, and how often they are skipped (F106)."""
    return ALL.plays(plays).join(lyrics.select("track", "mood"), "track").groupBy("owner", "mood").agg(F.count(F.lit(1)).alias("plays"), share(F.col("skipped")).alias("skip_rate"))


@C.query("f_lyric_weather", "lyrics", "plays", sql=f"SELECT owner, strftime(date_trunc('month', day), '%Y-%m-%d') AS month, count(*) AS plays, sum(round(valence * 100)::BIGINT)::DOUBLE / count(*) / 100 AS valence, avg((valence < -0.4)::INT) AS bleak, avg((valence > 0.4)::INT) AS bright FROM plays JOIN lyrics USING (track) WHERE attended GROUP BY ALL HAVING count(*) >= {COVER}")
def lyric_weather(lyrics: DataFrame, plays: DataFrame) -> DataFrame:
    """Each month's valence, and its bleak and bright shares (F107)."""
    m = ALL.plays(plays).join(lyrics.select("track", "valence"), "track").groupBy("owner", text(F.trunc("day", "month")).alias("month"))
    return m.agg(F.count(F.lit(1)).alias("plays"), (F.sum(F.round(F.col("valence") * 100).cast("long")).cast("double") / F.count(F.lit(1)) / 100).alias("valence"), share(F.col("valence") < -0.4).alias("bleak"), share(F.col("valence") > 0.4).alias("bright")).filter(F.col("plays") >= COVER)


@C.query("f_theme_drift", "lyrics", "plays", sql="SELECT owner, year(day)::INTEGER AS year, theme, count(*) AS plays, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY owner, year(day)) AS share FROM plays JOIN lyrics USING (track) WHERE attended GROUP BY owner, year(day), theme")
def theme_drift(lyrics: DataFrame, plays: DataFrame) -> DataFrame:
    """Each year's shares of themes (F108)."""
    n = ALL.plays(plays).join(lyrics.select("track", "theme"), "track").groupBy("owner", F.year("day").alias("year"), "theme").agg(F.count(F.lit(1)).alias("plays"))
    return n.withColumn("share", ratio(F.col("plays"), F.sum("plays").over(Window.partitionBy("owner", "year"))))


def _part(hour: Column) -> Column:
    return F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 18, "afternoon").otherwise("evening")


_PART = "CASE WHEN hour < 6 THEN 'night' WHEN hour < 12 THEN 'morning' WHEN hour < 18 THEN 'afternoon' ELSE 'evening' END"


@C.query("f_theme_clock", "lyrics", "plays", sql=f"""n AS (SELECT owner, {_PART} AS part, theme, count(*) AS n FROM plays JOIN lyrics USING (track) WHERE attended GROUP BY ALL)
SELECT owner, part, theme, n AS plays, round((n * sum(n) OVER (PARTITION BY owner))::DOUBLE / (sum(n) OVER (PARTITION BY owner, part) * sum(n) OVER (PARTITION BY owner, theme))::DOUBLE, 6) AS lift FROM n""")
def theme_clock(lyrics: DataFrame, plays: DataFrame) -> DataFrame:
    """How much more than usual a theme is heard in a part of the day (F109)."""
    n = ALL.plays(plays).join(lyrics.select("track", "theme"), "track").groupBy("owner", _part(F.col("hour")).alias("part"), "theme").agg(F.count(F.lit(1)).alias("plays"))
    over = lambda *k: F.sum("plays").over(Window.partitionBy("owner", *k))
    return n.withColumn("lift", F.round((F.col("plays") * over()).cast("double") / (over("part") * over("theme")).cast("double"), 6))


@C.query("f_valence_skips", "lyrics", "plays", sql="SELECT floor(valence * 4)::BIGINT AS band, count(*) AS plays, avg(skipped::INT) AS skip_rate FROM plays JOIN lyrics USING (track) WHERE attended GROUP BY 1")
def valence_skips(lyrics: DataFrame, plays: DataFrame) -> DataFrame:
    """Skips by bands of valence (F111)."""
    return ALL.plays(plays).join(lyrics.select("track", F.floor(F.col("valence") * 4).alias("band")), "track").groupBy("band").agg(F.count(F.lit(1)).alias("plays"), share(F.col("skipped")).alias("skip_rate"))


_REASONS = "array_to_string(list_filter([CASE WHEN len(words) = 0 THEN 'no words' END, CASE WHEN len(words) BETWEEN 1 AND 4 THEN 'few words' END, CASE WHEN lang IS NULL THEN 'no language' END, CASE WHEN mood = 'bright' AND valence < -0.5 OR mood = 'bleak' AND valence > 0.5 THEN 'mood against valence' END], lambda x: x IS NOT NULL), ', ')"


@C.query("f_lyric_hygiene", "lyrics", "plays", sql=_USE + f" SELECT track, {_REASONS} AS reasons, coalesce(plays, 0) AS plays FROM lyrics LEFT JOIN u USING (track) WHERE {_REASONS} <> ''")
def lyric_hygiene(lyrics: DataFrame, plays: DataFrame) -> DataFrame:
    """Lyrics that look wrong, and why (F113, F222)."""
    n = F.size("words")
    against = ((F.col("mood") == "bright") & (F.col("valence") < -0.5)) | ((F.col("mood") == "bleak") & (F.col("valence") > 0.5))
    why = F.concat_ws(", ", F.when(n == 0, "no words"), F.when(n.between(1, 4), "few words"), F.when(F.col("lang").isNull(), "no language"), F.when(against, "mood against valence"))
    return lyrics.withColumn("reasons", why).filter("reasons <> ''").join(use(plays), "track", "left").select("track", "reasons", F.coalesce("plays", F.lit(0)).alias("plays"))


@C.query("f_mood_quadrants", "lyrics", "tracks", sql="SELECT CASE WHEN valence >= 0 THEN CASE WHEN energy >= 0.5 THEN 'glad' ELSE 'serene' END ELSE CASE WHEN energy >= 0.5 THEN 'tense' ELSE 'gloomy' END END AS quadrant, count(*) AS songs, sum(round(bpm * 1000)::BIGINT)::DOUBLE / count(*) / 1000 AS bpm FROM lyrics JOIN tracks USING (track) GROUP BY 1")
def mood_quadrants(lyrics: DataFrame, tracks: DataFrame) -> DataFrame:
    """Songs by valence and energy (F221)."""
    up = F.col("energy") >= 0.5
    quadrant = F.when(F.col("valence") >= 0, F.when(up, "glad").otherwise("serene")).otherwise(F.when(up, "tense").otherwise("gloomy"))
    return lyrics.join(tracks, "track").groupBy(quadrant.alias("quadrant")).agg(F.count(F.lit(1)).alias("songs"), (F.sum(F.round(F.col("bpm") * 1000).cast("long")).cast("double") / F.count(F.lit(1)) / 1000).alias("bpm"))


@C.query("f_feature_coverage", "plays", "tracks", sql="SELECT owner, count(*) AS plays, count(t.track) AS with_features, count(t.track) FILTER (explicit) AS explicit FROM plays p LEFT JOIN tracks t USING (track) WHERE attended GROUP BY owner")
def feature_coverage(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """Plays whose song has features (F116)."""
    j = ALL.plays(plays).join(tracks.select("track", "explicit", F.lit(1).alias("known")), "track", "left")
    return j.groupBy("owner").agg(F.count(F.lit(1)).alias("plays"), F.count("known").alias("with_features"), F.count_if("explicit").alias("explicit"))


@C.query("f_keys_by_season", "plays", "tracks", sql="SELECT ['winter', 'spring', 'summer', 'autumn'][(month(day) % 12) // 3 + 1] AS season, count(*) AS plays, avg((key_mode = 'A')::INT) AS minor FROM plays JOIN tracks USING (track) WHERE attended GROUP BY 1")
def keys_by_season(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """The share of minor keys in each season (F119)."""
    season = F.element_at(F.array(*map(F.lit, ("winter", "spring", "summer", "autumn"))), (F.floor(F.month("day") % 12 / 3) + 1).cast("int"))
    return ALL.plays(plays).join(tracks.select("track", "key_mode"), "track").groupBy(season.alias("season")).agg(F.count(F.lit(1)).alias("plays"), share(F.col("key_mode") == "A").alias("minor"))


@C.query("f_feature_extremes", "plays", "tracks", sql="""n AS (SELECT owner, track FROM plays WHERE attended GROUP BY ALL HAVING count(*) >= 3), j AS (SELECT owner, track, bpm, loudness FROM n JOIN tracks USING (track))
SELECT owner, 'fastest' AS list, track, bpm AS value FROM j QUALIFY row_number() OVER (PARTITION BY owner ORDER BY bpm DESC, track) <= 5 UNION ALL SELECT owner, 'loudest', track, loudness FROM j QUALIFY row_number() OVER (PARTITION BY owner ORDER BY loudness DESC, track) <= 5""")
def feature_extremes(plays: DataFrame, tracks: DataFrame, least: int = 3) -> DataFrame:
    """The fastest and the loudest songs of those heard thrice (F122)."""
    j = ALL.plays(plays).groupBy("owner", "track").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).join(tracks.select("track", "bpm", "loudness"), "track")
    part = lambda name, c: top_by(j, ["owner"], 5, F.desc(c), F.col("track")).select("owner", F.lit(name).alias("list"), "track", F.col(c).alias("value"))
    return part("fastest", "bpm").unionByName(part("loudest", "loudness"))


@C.query("f_artist_sound", "plays", "tracks", sql="""p AS (SELECT owner, artist, round(bpm * 1000)::BIGINT AS bpm, round(energy * 1000000)::BIGINT AS energy, key_number FROM plays JOIN tracks USING (track) WHERE attended), o AS (SELECT owner, sum(bpm)::DOUBLE / count(*) AS bpm, sum(energy)::DOUBLE / count(*) AS energy FROM p GROUP BY 1),
k AS (SELECT owner, artist, arg_max(key_number, (n, -key_number)) AS key FROM (SELECT owner, artist, key_number, count(*) AS n FROM p GROUP BY ALL) GROUP BY ALL)
SELECT owner, artist, key, (a.bpm - o.bpm) / 1000 AS bpm_above, (a.energy - o.energy) / 1000000 AS energy_above FROM (SELECT owner, artist, sum(bpm)::DOUBLE / count(*) AS bpm, sum(energy)::DOUBLE / count(*) AS energy FROM p GROUP BY ALL) a JOIN o USING (owner) JOIN k USING (owner, artist)""")
def artist_sound(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """An artist's tempo, energy and commonest key against all that the listener hears (F124)."""
    p = ALL.plays(plays).join(tracks.select("track", whole("bpm", 1000), whole("energy", 1_000_000), "key_number"), "track")
    n = p.groupBy("owner", "artist", "key_number").agg(F.count(F.lit(1)).alias("n"), F.sum("bpm").alias("b"), F.sum("energy").alias("e"))
    a = n.groupBy("owner", "artist").agg(F.max_by("key_number", F.struct("n", -F.col("key_number"))).alias("key"), F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum("e").alias("e"))
    w = Window.partitionBy("owner")
    above = lambda c: F.col(c).cast("double") / F.col("n") - F.sum(c).over(w).cast("double") / F.sum("n").over(w)
    return a.select("owner", "artist", "key", (above("b") / 1000).alias("bpm_above"), (above("e") / 1_000_000).alias("energy_above"))


@C.query("f_session_arc", "stream_plays", "tracks", sql=_CUT + " SELECT owner, session, position::INTEGER AS position, energy, bpm FROM (SELECT owner, session, track, row_number() OVER (PARTITION BY owner, session ORDER BY played_at, play_id) AS position FROM s) JOIN tracks USING (track)")
def session_arc(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """Energy and tempo along each session (F127)."""
    s = sessions.sessionize(plays, STREAM).withColumn("position", F.row_number().over(Window.partitionBy("owner", "session").orderBy("played_at", "play_id")))
    return s.select("owner", "session", "track", "position").join(tracks.select("track", "energy", "bpm"), "track").select("owner", "session", "position", "energy", "bpm")


@C.query("f_camelot", "tracks", sql="SELECT code, regexp_extract(code, '^([0-9]{1,2})([AB])$', 1)::INTEGER AS number, regexp_extract(code, '^([0-9]{1,2})([AB])$', 2) AS letter, n AS songs FROM (SELECT key_number::VARCHAR || key_mode AS code, count(*) AS n FROM tracks GROUP BY 1)")
def camelot(tracks: DataFrame) -> DataFrame:
    """Key codes, taken apart (F211)."""
    code = tracks.groupBy(F.concat(F.col("key_number").cast("string"), F.col("key_mode")).alias("code")).agg(F.count(F.lit(1)).alias("songs"))
    part = lambda i: F.regexp_extract("code", "^([0-9]{1,2})([AB])$", i)
    return code.select("code", part(1).cast("int").alias("number"), part(2).alias("letter"), "songs")
