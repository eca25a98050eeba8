"""Resolution kept up to date batch by batch: only what a batch touches is computed and written again.

Tables below one folder, all Parquet:

    events      bucket, day, batch   every event once, in the batch that brought it
    plays       bucket, day          a row an event: where its resolved row is, and a digest of what that says
    resolved    bucket, part         the plays that stay, versions of a recording merged, each with its place among those of its track
    spellings   bucket, part         how often each artist, album and track is spelt how
    dimensions  bucket               artists, albums and tracks under their usual names
    progress    batch                written last: the batches that are done, and how far events have been taken in

An owner is in one bucket; a track is in one part of it, with all versions of its recording. Whether
a play gives way depends on plays within REACH days of it, so a batch affects the days of its events and REACH on
either side. These are computed from the events of those days and, to see all their neighbours, REACH more. What
differs from the plays table then names the parts to compute again; each reads its own old rows only. Every
table is written by overwriting the partitions that it was computed for, none else.

A batch is named by a number, as foreachBatch gives it. Events go under their batch, so a batch that runs
twice writes the same events twice to the same place; plays are overwritten last, after all that is derived from
the difference to them, so a batch that broke off finds the same difference again. A batch that is done changes nothing.

Rows are never removed from a partition without others being put in, as an overwritten partition that gets no row would
stay: plays that give way keep their row, marked, also among the resolved, and a name without plays keeps its row with a count of 0.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from playlore.functions.config import Tuning
from playlore.functions.scratch import tidy, written
from playlore.operators import resolve
from playlore.operators.joins import without
from playlore.sources.ingest import EVENTS, PAYLOAD

KINDS = {"artist": ("artist_id", "artist_name"), "album": ("album_id", "album_name"), "track": ("track_id", "track_name")}
PLAY = (
    f"owner string, play_id string, raw_at timestamp, ingested_at timestamp, {PAYLOAD}, played_at_utc timestamp, was_skipped boolean, under_30s boolean, superseded boolean, zone string, played_at timestamp_ntz,"
    " artist_id string, album_id string, track_id string"
)
RESOLVED = f"{PLAY}, isrc_track string, play_index int, is_first boolean"
SPELLING = "owner string, kind string, id string, name string, n long, last timestamp_ntz"
DIMENSION = "owner string, kind string, id string, name string, plays long"
SCHEMAS = {
    "events": f"{EVENTS}, bucket int, day date, batch long",
    "plays": "owner string, play_id string, part int, digest struct<a: long, b: int>, bucket int, day date",
    "resolved": f"{RESOLVED}, bucket int, part int",
    "spellings": f"{SPELLING}, bucket int, part int",
    "dimensions": f"{DIMENSION}, bucket int",
    "progress": "resolved_through timestamp, batch long",
}
PARTITIONS = {"events": ("bucket", "day", "batch"), "plays": ("bucket", "day"), "resolved": ("bucket", "part"), "spellings": ("bucket", "part"), "dimensions": ("bucket",), "progress": ("batch",)}
#: What is written so: twice as dense as Spark's default, in files that are read seldom.
ZSTD = "zstd"
#: Rows of a task where whole tracks or names are brought together.
ROWS = 100_000
#: Plays that are shuffled whole at once, some 2 GB; more go in turns, so that this disk does not grow with the tables.
TURN = 10_000_000


class Facts(NamedTuple):
    """What plays are resolved with. merges: from_artist_id, into_artist_id. isrcs: track_id, isrc. overrides: owner, from_date, to_date, zone, or None. countries: country, zone. When they change, rebuild."""

    merges: DataFrame
    isrcs: DataFrame
    overrides: DataFrame | None
    countries: DataFrame
    home: str = "UTC"


class Store(NamedTuple):
    """Where the tables are, how finely owners and their tracks are parted, and time: into days, months or years. reach: so many of these the longest play lasts, rounded up."""

    root: str
    buckets: int = 64
    parts: int = 16
    unit: str = "day"
    reach: int = 1

    def day(self, at: str) -> Column:
        return F.trunc(F.to_date(at), self.unit) if self.unit != "day" else F.to_date(at)

    def around(self, days: DataFrame) -> DataFrame:
        """(bucket, day) and the days within reach of them."""
        far = f"interval {self.reach} {self.unit}"
        near = F.expr(f"explode(sequence(to_date(day - {far}), to_date(day + {far}), interval 1 {self.unit}))")
        return days.select("bucket", near.alias("day")).distinct()


def table(spark: SparkSession, store: Store, name: str) -> DataFrame:
    """A table as it is; empty before its first rows."""
    try:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{store.root}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMAS[name])


def put(store: Store, name: str, rows: DataFrame) -> None:
    """Overwrites the partitions that rows have, and no other. The rows of LAID tables come as laid deals them, so they are not shuffled again."""
    keys = PARTITIONS[name]
    dealt = rows.coalesce(1) if name == "progress" else rows if name in LAID else rows.hint("rebalance", *keys)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{store.root}/{name}", compression=ZSTD)


LAID = ("resolved", "dimensions")


def laid(rows: DataFrame, count: int, partitions: int, keys: tuple[str, ...], *of: str | Column) -> DataFrame:
    """rows, of so many in so many partitions, with _cell: a hash of what must stay together in a partition. A task has some ROWS rows, and there are not many more files than tasks and partitions."""
    tasks = max(1, -(-count // ROWS))
    cells = max(1, -(-2 * tasks // max(1, partitions)))
    return rows.withColumn("_cell", F.pmod(F.xxhash64(*of), F.lit(cells)).cast("int")).repartition(tasks, *keys, "_cell")


def bucket_of(owner: Column, store: Store) -> Column:
    return F.pmod(F.xxhash64(owner), F.lit(store.buckets)).cast("int")


def _of(rows: DataFrame, partitions: DataFrame) -> DataFrame:
    """The rows of some partitions. The condition on them, which holds for all, lets Spark prune by them when it runs: files of others are not read."""
    return rows.join(partitions.filter("bucket >= 0"), partitions.columns, "left_semi")


def take_in(spark: SparkSession, store: Store, batch: DataFrame, number: int) -> DataFrame:
    """Writes the batch's events that no earlier batch brought; gives the (bucket, day) that have some."""
    placed = batch.filter("occurred_at is not null")
    again = placed.groupBy(F.xxhash64("owner", "event_id")).count().filter("count > 1")  # whole events are shuffled for it only if some come twice
    placed = placed if again.isEmpty() else placed.dropDuplicates(["owner", "event_id"])
    placed = placed.withColumns({"bucket": bucket_of(F.col("owner"), store), "day": store.day("occurred_at"), "batch": F.lit(number).cast("long")})
    known = table(spark, store, "events").filter(F.col("batch") < number).select("bucket", "day", "owner", "event_id")
    put(store, "events", without(placed, known, "bucket", "day", "owner", "event_id"))
    return table(spark, store, "events").filter(F.col("batch") == number).select("bucket", "day").distinct()


def computed(events: DataFrame, store: Store, days: DataFrame, facts: Facts, t: Tuning, number: int) -> DataFrame:
    """The plays of some (bucket, day), from the parsed events of those days and their neighbours. _fresh: whether the event came with this batch."""
    plays = resolve.marked_superseded(resolve.timed(events, t))
    named = resolve.identify(resolve.zones(plays, facts.overrides, facts.countries, facts.home), facts.merges)
    placed = named.withColumns({"bucket": bucket_of(F.col("owner"), store), "day": store.day("raw_at"), "_fresh": F.col("batch") == number})
    columns = days.sparkSession.createDataFrame([], f"{PLAY}, bucket int, day date, _fresh boolean").columns
    codes = facts.isrcs.filter("isrc is not null").groupBy("track_id").agg(F.min("isrc").alias("_code"))
    coded = _of(placed, days).select(*columns).join(codes, "track_id", "left").withColumn("isrc", F.col("_code")).drop("_code")
    said = [c for c in coded.columns if c != "_fresh"]
    nulls = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in said])  # hashes pass nulls over
    return coded.withColumns({"part": _part(store), "_digest": F.struct(F.xxhash64(nulls, *said).alias("a"), F.hash(nulls, *said).alias("b"))})


def _turns(sizes: dict[int, int]) -> list[list[int]]:
    """Numbers with their rows, put together up to TURN rows."""
    out, rows = [[]], 0
    for k, n in sorted(sizes.items()):
        if out[-1] and rows + n > TURN:
            out, rows = [*out, []], 0
        out[-1].append(k)
        rows += n
    return out


def indexed(plays: DataFrame, count: int, partitions: int) -> DataFrame:
    """Plays of whole parts, so many in so many (bucket, part), with isrc_track (what they merge into by their own id and isrc), play_index and is_first; marked plays have none.

    One shuffle by part and recording, after which they are also written: the versions of a recording, and so all plays that are counted together, are in one task.
    """
    kept = ~F.col("superseded")
    dealt = plays.drop("isrc_track").withColumn("_of", F.coalesce("isrc", "track_id"))
    at = ("bucket", "part", "_cell", "owner", "_of")
    versions = Window.partitionBy(*at, "isrc")
    counted = laid(dealt, count, partitions, ("bucket", "part"), "owner", "_of").withColumn("_n", F.count_if(kept).over(versions.partitionBy(*at, "isrc", "track_id")))
    most = F.min(F.when(kept & F.col("isrc").isNotNull(), F.struct(-F.col("_n"), "track_id"))).over(versions)["track_id"]
    merged = counted.withColumn("isrc_track", F.coalesce(most, F.col("track_id"))).drop("_n")
    w = Window.partitionBy(*at, "isrc_track", "superseded").orderBy("played_at", "play_id")
    return merged.withColumn("play_index", F.when(kept, F.row_number().over(w))).withColumn("is_first", F.coalesce(F.col("play_index") == 1, F.lit(False))).drop("_of", "_cell")


def spellings(resolved: DataFrame) -> DataFrame:
    """How often each id has which name in a part, 0 if only marked plays have it."""
    ids = F.array(*[F.struct(F.lit(k).alias("kind"), F.col("isrc_track" if k == "track" else i).alias("id"), F.col(n).alias("name")) for k, (i, n) in KINDS.items()])
    each = resolved.select("bucket", "part", "owner", "superseded", "played_at", F.explode(ids).alias("x")).select("*", "x.*").filter("id is not null")
    stay = F.when(~F.col("superseded"), F.col("played_at"))
    return each.groupBy("owner", "kind", "id", "name", "bucket", "part").agg(F.count_if(~F.col("superseded")).alias("n"), F.max(stay).alias("last"))


def dimensions(spelt: DataFrame, count: int, buckets: int) -> DataFrame:
    """Each id under the name most played, the latest of equals, with its plays; of so many spellings in so many buckets. One shuffle, by bucket and id."""
    at = ("bucket", "_cell", "owner", "kind", "id")
    whole = laid(spelt, count, buckets, ("bucket",), "owner", "kind", "id").groupBy(*at, "name").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    return whole.groupBy(*at).agg(F.max_by("name", F.struct("n", "last", "name")).alias("name"), F.sum("n").alias("plays")).select("owner", "kind", "id", "name", "plays", "bucket")


def _part(store: Store) -> Column:
    """Where a track's rows are: with those of its recording."""
    return F.pmod(F.xxhash64(F.coalesce("isrc", "track_id")), F.lit(store.parts)).cast("int")


#: What names a row of the plays table.
_KEY = ("bucket", "day", "owner", "play_id")


def _differing(new: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new rows that are not among the old, and the keys and parts of the old rows that are not among the new. Rows whose key the other side lacks are not shuffled; old and new ones of one key are compared by a digest."""
    came = without(new, old, *_KEY, also=("_digest",))
    went = without(old.select(*_KEY, "part", "_digest"), new, *_KEY, also=("_digest",))
    return came, went.select(*_KEY, "part")


def advance(spark: SparkSession, store: Store, batch: DataFrame, number: int, facts: Facts, t: Tuning = Tuning(), taken: Callable[[], object] = lambda: None) -> dict[str, int]:
    """Takes a batch in and brings every table up to date; the number of partitions written of each. A batch that is done writes none. taken is called when the batch is in the store and won't be read again."""
    if not table(spark, store, "progress").filter(F.col("batch") >= number).isEmpty():
        return {}
    with tidy(spark) as scratch:
        return _advance(spark, store, batch, number, facts, t, taken, scratch)


def _advance(spark: SparkSession, store: Store, batch: DataFrame, number: int, facts: Facts, t: Tuning, taken: Callable[[], object], scratch: list[DataFrame]) -> dict[str, int]:
    def kept(df: DataFrame, name: str) -> DataFrame:
        scratch.append(written(df, name, ZSTD))
        return scratch[-1]

    through = kept(batch.agg(F.max("ingested_at").alias("resolved_through")), "batch-through").withColumn("batch", F.lit(number).cast("long"))
    days = store.around(kept(take_in(spark, store, batch, number), "batch-days"))
    present = table(spark, store, "events").select("bucket", "day").distinct()
    days = kept(days.join(present, ["bucket", "day"], "left_semi"), "batch-reach")
    taken()
    if days.isEmpty():
        put(store, "progress", through)
        return {}
    with tidy(spark) as parsed:
        parsed.append(events := written(resolve.parsed(_of(table(spark, store, "events"), store.around(days)), "batch"), "batch-plays", ZSTD))
        turns = max(1, -(-events.count() // TURN))
        of = F.pmod(F.hash("owner"), F.lit(turns))
        new = reduce(DataFrame.unionByName, [kept(computed(events.filter(of == k) if turns > 1 else events, store, days, facts, t, number), "batch-computed") for k in range(turns)])
    old = _of(table(spark, store, "plays"), days).withColumnRenamed("digest", "_digest")
    fresh = new.filter("_fresh")  # if the batch broke off, the old rows may have some; they are written again
    came, went = _differing(new.filter("not _fresh"), old)
    came = came.unionByName(fresh)
    narrow = lambda df, is_new: df.select(*_KEY, "part", F.lit(is_new).alias("_new"))
    changed = kept(narrow(came, True).unionByName(narrow(went, False)), "batch-changed")
    written_parts = {}
    if not changed.isEmpty():
        parts = kept(changed.select("bucket", "part").distinct(), "batch-parts")
        number_of = (F.col("bucket") * store.parts + F.col("part")).alias("_p")
        there = _of(table(spark, store, "resolved"), parts).select("bucket", "part").unionByName(changed.select("bucket", "part"))
        sizes = {r["_p"]: r["count"] for r in there.groupBy(number_of).count().collect()}  # as many rows as partitions
        for turn in _turns(sizes):
            some = lambda df: df.filter(number_of.isin(turn))  # noqa: B023, E731
            held = some(table(spark, store, "resolved")).drop("isrc_track", "play_index", "is_first")
            held = without(held, some(changed), "bucket", "part", "owner", "play_id", sift=True)  # the new too, if the batch broke off after writing them
            rows = held.unionByName(some(came).drop("day", "_digest", "_fresh"))
            put(store, "resolved", indexed(rows, sum(sizes[k] for k in turn), len(turn)))  # what held reads is replaced when all of it is written
            put(store, "spellings", spellings(some(table(spark, store, "resolved"))))
        buckets = parts.select("bucket").distinct()
        spelt = _of(table(spark, store, "spellings"), buckets)
        written_parts = {"resolved": len(sizes), "dimensions": buckets.count()}
        put(store, "dimensions", dimensions(spelt, spelt.count(), written_parts["dimensions"]))
        touched = kept(changed.select("bucket", "day").distinct(), "batch-touched")
        put(store, "plays", _of(new.select("owner", "play_id", "part", F.col("_digest").alias("digest"), "bucket", "day"), touched))
        written_parts["plays"] = touched.count()
    put(store, "progress", through)
    return written_parts


def resolved(spark: SparkSession, store: Store) -> DataFrame:
    """The plays that stay; track_id is that of the version most played."""
    return table(spark, store, "resolved").filter("not superseded").withColumn("track_id", F.col("isrc_track")).drop("isrc_track", "superseded", "bucket", "part")


def names(spark: SparkSession, store: Store, kind: str) -> DataFrame:
    """(owner, id, name, plays) of the artists, albums or tracks that have plays."""
    return table(spark, store, "dimensions").filter((F.col("kind") == kind) & (F.col("plays") > 0)).select("owner", "id", "name", "plays")


def resolved_through(spark: SparkSession, store: Store) -> datetime | None:
    """The latest time of taking in that every table has."""
    return table(spark, store, "progress").agg(F.max("resolved_through")).first()[0]


def follow(stream: DataFrame, store: Store, checkpoint: str, facts: Facts, t: Tuning = Tuning()) -> StreamingQuery:
    """Keeps the tables up to date with a stream of events, late ones included, however late."""
    return stream.writeStream.foreachBatch(lambda batch, number: advance(batch.sparkSession, store, batch, number, facts, t)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rebuild(spark: SparkSession, store: Store, into: Store, facts: Facts, t: Tuning = Tuning()) -> None:
    """All tables anew from the events of a store, as one batch into another; for when facts or thresholds change."""
    last = table(spark, store, "progress").agg(F.max("batch")).first()[0]
    advance(spark, into, table(spark, store, "events").drop("bucket", "day", "batch"), last or 0, facts, t)
