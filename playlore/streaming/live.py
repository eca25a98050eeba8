"""Histories that keep coming: files land, micro-batches add what is new, sessions are kept up to date."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from playlore.sources.ingest import EVENTS


def event_stream(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Events from Parquet files as they land."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def table_of(spark: SparkSession, path: str) -> DataFrame:
    """The table of events, in partitions by day; empty where there is none yet."""
    schema = f"{EVENTS}, day date"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_new(stream: DataFrame, table: str, checkpoint: str, fresh: Callable[[DataFrame, DataFrame], DataFrame], late: str = "2 days") -> StreamingQuery:
    """Adds to the table what fresh(batch, held) lets pass. Exact repeats within the watermark never reach it; a batch that runs twice adds nothing the second time, as fresh sees the table.

    held is only the days of the batch and the ones beside them, by the table's partitions, however long the history is.
    """

    def add(batch: DataFrame, _: int) -> None:
        span = batch.agg(F.to_date(F.min("occurred_at")).alias("first"), F.to_date(F.max("occurred_at")).alias("last"), F.count(F.lit(1)).alias("n")).first()
        if not span["n"]:
            return
        near = F.col("day").isNull() if span["first"] is None else F.col("day").between(F.date_sub(F.lit(span["first"]), 1), F.date_add(F.lit(span["last"]), 1)) | F.col("day").isNull()
        held = table_of(batch.sparkSession, table).filter(near).drop("day")
        fresh(batch, held).withColumn("day", F.to_date("occurred_at")).write.mode("append").partitionBy("day").parquet(table)

    once = stream.withWatermark("occurred_at", late).dropDuplicatesWithinWatermark(["owner", "event_id"])
    return once.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def by_event_id(batch: DataFrame, held: DataFrame) -> DataFrame:
    return batch.join(held.select("owner", "event_id"), ["owner", "event_id"], "left_anti")


def windowed_counts(stream: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Plays in tumbling or sliding windows; a window is final once the watermark has passed it."""
    at = F.window("occurred_at", length, slide) if slide else F.window("occurred_at", length)
    return stream.withWatermark("occurred_at", late).groupBy("owner", at.alias("w")).agg(F.count(F.lit(1)).alias("plays")).select("owner", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "plays")


SESSION = "owner string, start timestamp, end timestamp, plays long"
STATE = "rows array<struct<at:timestamp, id:string, car:boolean>>"


def _gap(at: pd.Timestamp, car: bool, gap: float, night: float, car_gap: float) -> float:
    return car_gap if car else night if at.hour >= 23 or at.hour < 6 else gap


def live_sessions(stream: DataFrame, gap: float = 1800, night: float = 2700, car_gap: float = 3600, late: str = "1 hour") -> DataFrame:
    """Sessions by the adaptive gap, each sent once the watermark says that nothing can join or split it.

    An owner's state holds only the plays of sessions that are still open. A gap is judged by the play
    before it, exactly as the batch operator does, so late plays within the watermark are put in order first.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = [tuple(r) for r in state.get[0]] if state.exists else []
        for b in batches:
            rows += list(zip(b["occurred_at"], b["event_id"], b["car"].fillna(False).astype(bool), strict=True))
        rows = sorted(set((pd.Timestamp(a), i, bool(c)) for a, i, c in rows))
        now = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        sessions: list[list] = []
        for r in rows:
            last = sessions[-1][-1] if sessions else None
            if last is not None and (r[0] - last[0]).total_seconds() < _gap(last[0], last[2], gap, night, car_gap):
                sessions[-1].append(r)
            else:
                sessions.append([r])
        over = [s for s in sessions if (now - s[-1][0]).total_seconds() >= _gap(s[-1][0], s[-1][2], gap, night, car_gap)]
        left = [r for s in sessions[len(over) :] for r in s]
        if left:
            state.update(([{"at": a.to_pydatetime(), "id": i, "car": c} for a, i, c in left],))
            state.setTimeoutTimestamp(int(max(left[-1][0].timestamp() * 1000 + car_gap * 1000, state.getCurrentWatermarkMs() + 1)))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], s[0][0], s[-1][0], len(s)) for s in over], columns=["owner", "start", "end", "plays"])

    platform = F.lower(F.get_json_object("payload", "$.platform"))
    rows = stream.select("owner", "event_id", "occurred_at", platform.rlike("auto|car").alias("car")).withWatermark("occurred_at", late)
    return rows.groupBy("owner").applyInPandasWithState(update, SESSION, STATE, "append", GroupStateTimeout.EventTimeTimeout)
