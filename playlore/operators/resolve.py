"""From the event log to resolved plays: one clock, one row a listen, canonical artists, albums and tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlore.functions.config import Tuning
from playlore.operators.joins import latest_cover, maybe_asked
from playlore.sources.ingest import PAYLOAD


def _ms(c: Column) -> Column:
    return F.make_dt_interval(secs=F.coalesce(c, F.lit(0)) / 1000.0)


def parsed(events: DataFrame, *carry: str) -> DataFrame:
    """The fields of each play event, and columns to carry along. Worth writing once, as what follows reads them several times."""
    # inline: a payload is parsed once a row, where fields of a column would each parse it again
    return events.filter("event_type = 'play'").select("owner", F.col("event_id").alias("play_id"), F.col("occurred_at").alias("raw_at"), "ingested_at", *carry, F.inline(F.array(F.from_json("payload", PAYLOAD))))


def normalise(events: DataFrame, t: Tuning = Tuning()) -> DataFrame:
    """One row a play, stamped at its end."""
    return timed(parsed(events), t)


def timed(e: DataFrame, t: Tuning = Tuning()) -> DataFrame:
    """Parsed events, stamped at their end.

    Exports stamp the end, other sources the start. A poll says how long a track is, not how long it was heard:
    where the next poll comes earlier, it ended there, and if much earlier it was skipped.
    """
    polled = F.col("source") == "recently_played_poll"
    w = Window.partitionBy("owner").orderBy("raw_at", "play_id")
    polls = e.filter(polled).withColumn("_next", F.timestamp_diff("MILLISECOND", F.col("raw_at"), F.lead("raw_at").over(w)))
    x = e.filter(~polled | F.col("source").isNull()).withColumn("_next", F.lit(None).cast("long")).unionByName(polls)  # only polls are sorted
    cut = F.coalesce((F.col("_next") >= 0) & (F.col("_next") < F.col("ms_played")), F.lit(False))
    skip = cut & (F.col("_next") < F.col("ms_played") - t.poll_skip_slack_ms) & (F.col("_next") < t.poll_skip_ratio * F.col("ms_played"))
    x = x.withColumns({"_skip": skip, "ms_played": F.when(cut, F.col("_next")).otherwise(F.col("ms_played"))})
    end = F.when(F.col("_skip"), F.lit("fwdbtn")).otherwise(F.col("end_reason"))
    return x.withColumns(
        {
            "played_at_utc": F.when(F.col("source") == "extended_export", F.col("raw_at")).otherwise(F.col("raw_at") + _ms(F.col("ms_played"))),
            "end_reason": end,
            "was_skipped": F.coalesce(F.col("_skip") | F.col("end_reason").isin("fwdbtn", "backbtn"), F.lit(False)),
            "under_30s": F.col("ms_played") < 1000 * t.short_play_seconds,
        }
    ).drop("_next", "_skip")


#: Microseconds that points may be apart.
_WIDTH = 30_000_000


def _maybe_asked(held: DataFrame, asking: DataFrame) -> DataFrame:
    return maybe_asked(held, asking, "owner", "a", "b")


def _spotted(plays: DataFrame) -> DataFrame:
    """(owner, play_id): the plays that give way to another."""
    is_source = lambda s: F.coalesce(F.col("source") == s, F.lit(False))
    kind = F.when(is_source("extended_export"), "x").when(is_source("recently_played_poll"), "q").when(is_source("scrobble"), "s")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    ms = _ms(F.col("ms_played"))
    start = F.when(is_source("extended_export"), F.col("played_at_utc") - ms).otherwise(F.col("raw_at"))
    times = [micros(c).alias(n) for n, c in (("raw", F.col("raw_at")), ("start", start), ("until", F.col("raw_at") + ms), ("ended", F.col("played_at_utc")))]
    id_, none = F.col("spotify_track_id"), F.lit(None).cast("string")
    plain = plays.select("owner", "play_id", kind.alias("of"), id_.alias("id"), F.lower("track_name").alias("title"), F.lower("artist_name").alias("by"), *times)
    by_id = plain.filter("id is not null").select("owner", "play_id", "of", F.col("id").alias("a"), none.alias("b"), "raw", "start", "until", "ended")
    by_name = plain.filter("title is not null and by is not null").select("owner", "play_id", "of", F.col("title").alias("a"), F.col("by").alias("b"), "raw", "start", "until", "ended", F.col("id").isNull().alias("nameless"))
    asking = by_id.filter("of in ('q', 's')").unionByName(by_name.filter("of = 's' and nameless").drop("nameless"))
    # a poll holds by its name and, as it also asks, is among asking by its id; most exports have a key that nothing asks for and stay where they are
    held = by_id.filter("of = 'x'").unionByName(by_name.filter("of in ('x', 'q')").drop("nameless"))
    rows = asking.unionByName(_maybe_asked(held, asking)).repartition("owner", "a", "b")

    def point(when: str, mark: str, at: str, asks: bool) -> Column:
        # by_name rows and by_id rows of equal spelling must not meet: the kind says which; a poll's times count double
        of = F.concat(F.lit(mark), F.when(F.col("named"), "name").otherwise("id"))
        return F.when(F.expr(when), F.struct(of.alias("kind"), (F.col(at) * (2 if mark == "poll " else 1)).alias("t"), F.lit(asks).alias("asks")))

    points = [
        point("of = 'x' and not named", "poll ", "start", False), point("of = 'x' and not named", "poll ", "ended", False), point("of = 'q' and not named", "poll ", "raw", True),
        point("of in ('x', 'q')", "start ", "start", False), point("of = 's'", "start ", "raw", True), point("of in ('x', 'q')", "end ", "raw", False), point("of = 's'", "end ", "until", True),
    ]
    each = rows.withColumn("named", F.col("b").isNotNull()).select("owner", "play_id", "a", "b", F.explode(F.filter(F.array(*points), lambda x: x.isNotNull())).alias("p")).select("owner", "play_id", "a", "b", "p.*")
    w = Window.partitionBy("owner", "a", "b", "kind").orderBy("t").rangeBetween(-_WIDTH, _WIDTH)
    return each.withColumn("near", F.max(F.when(~F.col("asks"), F.lit(1))).over(w)).filter("asks and near = 1").select("owner", "play_id").distinct()


#: Plays of other sources never give way.
_MAY_GO = "coalesce(source in ('recently_played_poll', 'scrobble'), false)"


def marked_superseded(plays: DataFrame) -> DataFrame:
    """plays with superseded: whether a play gives way to another."""
    gone = _spotted(plays).withColumn("superseded", F.lit(True))
    asks = plays.filter(_MAY_GO).join(gone, ["owner", "play_id"], "left").withColumn("superseded", F.coalesce("superseded", F.lit(False)))
    return asks.unionByName(plays.filter(f"not {_MAY_GO}").withColumn("superseded", F.lit(False)))  # these are not shuffled


def supersede(plays: DataFrame) -> DataFrame:
    """Polls give way to exports, scrobbles to both.

    A poll's stamp may be the start or the end, a scrobble may lack the id. Each play puts points in time under
    the keys by which others look for it, and asks at its own; one shuffle of plays by key answers all, points are made after it,
    and exports of keys that none asks for don't move. A poll's times count double, so that one width serves all.
    """
    return plays.filter(f"not {_MAY_GO}").unionByName(plays.filter(_MAY_GO).join(_spotted(plays), ["owner", "play_id"], "left_anti"))


def zones(plays: DataFrame, overrides: DataFrame | None, countries: DataFrame, home: str) -> DataFrame:
    """plays with zone and local time: a dated override of the owner, the one that began last, else the country's one zone, else home.

    overrides: owner, from_date, to_date, zone, or None. countries: country, zone, one row for a country of one zone.
    """
    if overrides is None:
        given = plays.withColumn("_zone", F.lit(None).cast("string"))
    else:
        spans = overrides.select("owner", "from_date", "to_date", F.col("zone").alias("_zone"))
        given = latest_cover(plays.withColumn("_at", F.to_date("played_at_utc")), spans, ["owner"], "_at", "from_date", "to_date", "from_date", "_zone").drop("_at")
    c = countries.select("country", F.col("zone").alias("_country_zone"))
    joined = given.join(F.broadcast(c), "country", "left").withColumn("zone", F.coalesce("_zone", "_country_zone", F.lit(home)))
    return joined.withColumn("played_at", F.from_utc_timestamp("played_at_utc", F.col("zone")).cast("timestamp_ntz")).drop("_zone", "_country_zone")


def _name(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


def identify(plays: DataFrame, merges: DataFrame) -> DataFrame:
    """plays with artist_id, album_id and track_id, merged artists redirected.

    merges: from_artist_id, into_artist_id.
    """
    artist = F.concat(F.lit("name:"), _name("artist_name"))
    m = merges.select(F.col("from_artist_id").alias("artist_id"), "into_artist_id")
    p = plays.withColumn("artist_id", artist).join(m, "artist_id", "left").withColumn("artist_id", F.coalesce("into_artist_id", "artist_id")).drop("into_artist_id")
    key = F.coalesce(F.substring("artist_id", 6, 1_000_000), F.lit(""))
    album = F.when(F.col("album_name").isNotNull() & F.col("artist_id").isNotNull(), F.concat(F.lit("name:"), F.md5(F.concat(key, F.lit("|"), _name("album_name")))))
    local = F.concat(F.lit("local:"), F.md5(F.concat(key, F.lit("|"), _name("track_name"))))
    return p.withColumns({"album_id": album, "track_id": F.coalesce("spotify_track_id", local)})


def merge_isrc(plays: DataFrame, isrcs: DataFrame) -> DataFrame:
    """Versions of one recording go to the one most played, the least id of equals (P8). isrcs: track_id, isrc."""
    counted = plays.groupBy("owner", "track_id").agg(F.count(F.lit(1)).alias("n")).join(isrcs.filter("isrc is not null"), "track_id")
    w = Window.partitionBy("owner", "isrc").orderBy(F.desc("n"), "track_id")
    target = counted.withColumn("to", F.first("track_id").over(w)).filter("to <> track_id").select("owner", "track_id", "to")
    return plays.join(target, ["owner", "track_id"], "left").withColumn("track_id", F.coalesce("to", "track_id")).drop("to")


def dimension(plays: DataFrame, id_: str, name: str, *carry: str) -> DataFrame:
    """(owner, id, name, plays ...): the name is the spelling most played, the latest of equals."""
    spelt = plays.filter(F.col(id_).isNotNull()).groupBy("owner", id_, name).agg(F.count(F.lit(1)).alias("n"), F.max("played_at").alias("last"), *[F.max(c).alias(c) for c in carry])
    return spelt.groupBy("owner", id_).agg(F.max_by(name, F.struct("n", "last", name)).alias(name), F.sum("n").alias("plays"), *[F.max(c).alias(c) for c in carry])


def aliases(plays: DataFrame, id_: str, name: str) -> DataFrame:
    """(owner, alias, id): every spelling, with the id it is mostly used for."""
    n = plays.filter(F.col(id_).isNotNull() & F.col(name).isNotNull()).groupBy("owner", F.col(name).alias("alias"), id_).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("owner", "alias").agg(F.max_by(id_, F.struct("n", id_)).alias(id_))


def resolve(events: DataFrame, merges: DataFrame, isrcs: DataFrame, overrides: DataFrame | None, countries: DataFrame, home: str = "UTC", t: Tuning = Tuning(), merge_versions: bool = True) -> DataFrame:
    """All of it, with each play's place among those of its track."""
    p = identify(zones(supersede(normalise(events, t)), overrides, countries, home), merges)
    p = merge_isrc(p, isrcs) if merge_versions else p
    index = F.row_number().over(Window.partitionBy("owner", "track_id").orderBy("played_at", "play_id"))
    return p.withColumn("play_index", index).withColumn("is_first", F.col("play_index") == 1)


def overridden(dim: DataFrame, edits: DataFrame, id_: str, columns: tuple[str, ...]) -> DataFrame:
    """A dimension with the owner's edits (entity_id, field, value) in place."""
    wide = edits.filter(F.col("field").isin(*columns)).groupBy(F.col("entity_id").alias(id_)).pivot("field", list(columns)).agg(F.first("value"))
    e = wide.select(id_, *[F.col(c).alias(f"_{c}") for c in columns])
    return dim.join(e, id_, "left").withColumns({c: F.coalesce(F.expr(f"try_cast(_{c} as {dim.schema[c].dataType.simpleString()})"), F.col(c)) for c in columns}).drop(*[f"_{c}" for c in columns])


def unresolved(events: DataFrame, resolved_through) -> DataFrame:
    """Events that came in after the watermark."""
    return events if resolved_through is None else events.filter(F.col("ingested_at") > F.lit(resolved_through))
