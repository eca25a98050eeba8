"""What to look up next: one table of attempts, and a rule for each kind of look-up.

An entity is due if it was never tried, or if its last attempt ended in a state
whose days have passed. Each rule is one aggregation of attempts, one of plays
and two joins on the entity's key, so nothing grows beyond the inputs; the limit is
the number of calls that a run may make.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """key: the entity; asked: the column of an entity that attempts are remembered by, if another.

    again: state -> days after which it is due again; a state that isn't named is final.
    attended: only plays that were listened to count. untried_first: before those due again.
    """

    key: str
    asked: str | None = None
    again: dict[str, int] = field(default_factory=dict)
    attended: bool = False
    untried_first: bool = False


#: Days until an attempt is repeated, by what came of the last one.
RULES = {
    "album_listeners": Rule("album", again={"found": 60, "missing": 60}, untried_first=True),
    "match": Rule("artist", again={"found": 60, "missing": 60}),
    "verify": Rule("artist", again={"name": 30}),
    "credits": Rule("track", asked="isrc"),
    "lineage": Rule("track", asked="isrc"),
    "features": Rule("track", again={"missing": 90}, attended=True),
    "metadata": Rule("track"),
    "wiki": Rule("artist", again={"found": 180, "missing": 90}, untried_first=True),
    "origin": Rule("artist"),
    "cover": Rule("album", attended=True),
}


def last_attempts(attempts: DataFrame, key: str) -> DataFrame:
    """(key, state, at): the last attempt of each; of several on one day the greatest state."""
    last = F.max(F.struct("at", "state")).alias("last")
    return attempts.filter(F.col(key).isNotNull()).groupBy(key).agg(last).select(key, "last.state", "last.at")


def due(entities: DataFrame, attempts: DataFrame, plays: DataFrame, rule: Rule, today: str, n: int, *first: Column) -> DataFrame:
    """The first n entities to try, with plays and untried.

    entities: rule.key once each, and what a call needs; attempts: the asked column, state, at (a date).
    Entities that were never played are left out. Order: first, then the untried if the rule says so, then
    plays, then the key. Attempts without a key or a date are never of use: without a date they count as made long ago only for
    states that expire. An empty table of attempts leaves all entities untried.
    """
    asked = rule.asked or rule.key
    last = last_attempts(attempts, asked)
    days = F.coalesce(*[F.when(F.col("state") == s, F.lit(d)) for s, d in rule.again.items()], F.lit(None).cast("int"))
    old = F.datediff(F.lit(today).cast("date"), "at")
    counted = (plays.filter("attended") if rule.attended else plays).groupBy(rule.key).agg(F.count(F.lit(1)).alias("plays"))
    known = last.withColumn("_due", F.coalesce(F.coalesce(old, F.lit(2**31 - 1)) > days, F.lit(False))).select(asked, "_due")
    asks = entities.join(counted, rule.key).join(known, asked, "left").filter("_due is null or _due").withColumn("untried", F.col("_due").isNull()).drop("_due")
    order = [*first, *([F.desc("untried")] if rule.untried_first else []), F.desc("plays"), F.col(rule.key)]
    return asks.orderBy(*order).limit(n)


def budget(per_hour: int, used: int, batch: int) -> int:
    """How many calls are left in this hour, a batch at most."""
    return max(0, min(per_hour - used, batch))


def playlists_due(playlists: DataFrame, error_prefix: str = "unreadable:") -> DataFrame:
    """Readable playlists whose snapshot has moved or that were never read: the owner's own first, then the longest unread."""
    readable = F.col("sync_error").isNull() | ~F.col("sync_error").startswith(error_prefix)
    moved = F.col("items_snapshot").isNull() | ~F.col("items_snapshot").eqNullSafe(F.col("snapshot"))
    return playlists.filter(readable & moved).orderBy(F.desc("mine"), F.asc_nulls_first("items_synced"), "first_seen", "playlist")


def capture_windows(captures: DataFrame, accounts: DataFrame) -> DataFrame:
    """(owner, kind, first, last): what to ask a service of captures for, seconds since the epoch.

    Forward from the newest capture on, without an end; then the gap from `since` up to the oldest one, unless it is
    closed. accounts: owner, since, backfilled. An owner without captures is asked from `since` on, and has no gap.
    """
    held = captures.groupBy("owner").agg(F.max("uts").alias("newest"), F.min("uts").alias("oldest"))
    a = accounts.join(held, "owner", "left")
    forward = F.struct(F.lit("forward").alias("kind"), F.coalesce(F.greatest(F.col("newest") + 1, "since"), "since").alias("first"), F.lit(None).cast("long").alias("last"))
    gap = F.when(~F.col("backfilled") & (F.col("oldest") > F.col("since") + 1), F.struct(F.lit("backfill").alias("kind"), F.col("since").alias("first"), (F.col("oldest") - 1).alias("last")))
    return a.select("owner", F.explode(F.filter(F.array(forward, gap), lambda x: x.isNotNull())).alias("w")).select("owner", "w.*")


#: Hours after which a playlist by rule is due again.
CADENCE_HOURS = {"daily": 20, "weekly": 6 * 24 + 20}


def refresh_due(definitions: DataFrame, now: str, sky: str | None, forced: list[str] | None = None) -> DataFrame:
    """Definitions that were never built, or longer ago than their cadence, and whose gate is open under today's sky (F191).

    definitions: definition, cadence, gate (null: open), built. Any cadence but daily is weekly. Forced ones are due whatever else holds.
    """
    hours = F.when(F.col("cadence") == "daily", CADENCE_HOURS["daily"]).otherwise(CADENCE_HOURS["weekly"])
    old = F.col("built").isNull() | (F.timestamp_diff("SECOND", F.col("built"), F.lit(now).cast("timestamp_ntz")) >= 3600 * hours)
    is_open = F.col("gate").isNull() | F.col("gate").eqNullSafe(F.lit(sky))
    return definitions.filter((old & is_open) | F.col("definition").isin(forced or []))
