"""Insights that are found anew each night and keep what their reader has done with them.

A rebuild replaces all insights; one that was there before, by its natural key, keeps its mark, with other numbers in it or not. The
store is a row of snapshots, so a rebuild or a marking that breaks off leaves the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playlore.operators.joins import top_by
from playlore.sources import snapshots

KEY = ("owner", "kind", "subject_type", "subject_id", "period_start")
#: Snapshots that are kept, days back that are shown, and the weight of songs that keep coming back.
KEEP, DAYS, EARWORM = 2, 120, 0.6


def merged(found: DataFrame, held: DataFrame | None) -> DataFrame:
    """found (KEY, payload, score) with surfaced: whether an insight of the same key was surfaced before."""
    one = found.groupBy(*KEY).agg(F.max_by(F.struct("payload", "score"), F.struct("score", "payload")).alias("x")).select(*KEY, "x.*")
    if held is None:
        return one.withColumn("surfaced", F.lit(False))
    marks = held.filter("surfaced").select(*KEY, F.lit(True).alias("surfaced")).distinct()
    return one.join(marks, list(KEY), "left").withColumn("surfaced", F.coalesce("surfaced", F.lit(False)))


def load(spark: SparkSession, root: str) -> DataFrame | None:
    return snapshots.restore(spark, root)["insights"] if snapshots.complete(spark, root) else None


def rebuild(root: str, stamp: str, found: DataFrame) -> None:
    """Puts found in place of all insights; marks stay."""
    snapshots.snapshot({"insights": merged(found, load(found.sparkSession, root))}, root, stamp, KEEP)


def surface(root: str, stamp: str, shown: DataFrame) -> None:
    """Marks the insights whose KEY is in shown."""
    held = load(shown.sparkSession, root)
    if held is None:
        raise ValueError(f"there are no insights in {root}")
    seen = shown.select(*KEY, F.lit(True).alias("_seen")).distinct()
    marked = held.join(seen, list(KEY), "left").withColumn("surfaced", F.col("surfaced") | F.coalesce("_seen", F.lit(False))).drop("_seen")
    snapshots.snapshot({"insights": marked}, root, stamp, KEEP)


def unseen(insights: DataFrame, today: str, n: int = 6) -> DataFrame:
    """The n insights of each owner to show next (F57): those not shown yet first, recent ones or songs that keep coming back."""
    recent = insights.filter((F.datediff(F.lit(today).cast("date"), "period_start") <= DAYS) | (F.col("kind") == "earworm"))
    weight = F.when(F.col("kind") == "earworm", EARWORM * F.col("score")).otherwise(F.col("score"))
    return top_by(recent.withColumn("_w", weight), ["owner"], n, F.col("surfaced"), F.desc("_w"), F.col("kind"), F.col("subject_id"), F.col("period_start")).drop("_w")


def obsessions(plays: DataFrame, today: str, weeks: int = 26, least: int = 15, times: int = 5) -> DataFrame:
    """The week of an artist, of the last so many, with far more plays than a usual one of the 13 before (P32). plays: owner, artist, day."""
    week = F.date_sub("day", F.weekday("day"))
    w = plays.filter(F.datediff(F.lit(today).cast("date"), "day") <= 7 * weeks).groupBy("owner", "artist", week.alias("wk")).agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("owner", "artist").orderBy(F.unix_date("wk")).rangeBetween(-91, -7)
    b = w.withColumn("prior", F.coalesce(F.sum("c").over(before), F.lit(0))).filter((F.col("c") >= least) & (13 * F.col("c") >= times * F.col("prior")))
    best = b.groupBy("owner", "artist").agg(F.max_by(F.struct("wk", "c", "prior"), F.struct("c", "wk")).alias("x")).select("owner", "artist", "x.*")
    score = F.col("c").cast("double") / F.greatest(F.col("prior").cast("double") / 13.0, F.lit(1.0))
    return _insight(best, "obsession", "artist", F.col("artist"), F.col("wk"), F.concat_ws("|", F.col("c").cast("string"), F.col("prior").cast("string")), score)


def comebacks(plays: DataFrame, today: str, days: int = 60, silent: int = 180, least: int = 20) -> DataFrame:
    """The last return, in so many days, of an artist after a long silence (P34). plays: owner, artist, day."""
    d = plays.groupBy("owner", "artist", "day").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("owner", "artist")
    f = d.withColumns({"prev": F.lag("day").over(by.orderBy("day")), "plays": F.sum("n").over(by)})
    f = f.filter((F.datediff(F.lit(today).cast("date"), "day") <= days) & (F.datediff("day", "prev") >= silent) & (F.col("plays") >= least))
    best = f.groupBy("owner", "artist").agg(F.max_by(F.struct("day", "prev", "plays"), "day").alias("x")).select("owner", "artist", "x.*")
    quiet = F.datediff("day", "prev")
    return _insight(best, "comeback", "artist", F.col("artist"), F.col("day"), F.concat_ws("|", quiet.cast("string"), F.col("plays").cast("string")), quiet.cast("double") / 30.0)


def _insight(rows: DataFrame, kind: str, subject: str, id_, start, payload, score) -> DataFrame:
    return rows.select("owner", F.lit(kind).alias("kind"), F.lit(subject).alias("subject_type"), id_.cast("string").alias("subject_id"), start.alias("period_start"), payload.alias("payload"), score.alias("score"))
