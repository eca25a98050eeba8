"""Operators that keep state between batches, in RocksDB: sessions that are still open, and days whose details fall due.

State is kept for each key on the executors and in the checkpoint, so it survives both; it is never read as a whole. Timers run on
event time: what is due when the watermark passes a point is sent then, whether or not the key has a row in that batch.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from playlore.functions.scratch import written
from playlore.sources import ingest
from playlore.streaming.live import SESSION, table_of

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _ms(at: dt.datetime) -> int:
    return int(pd.Timestamp(at).value // 1_000_000)


class OpenSessions(StatefulProcessor):
    """The plays of a listener's sessions that may still grow; a timer stands where the last of them is over.

    A gap is judged by the play before it, so late plays within the watermark are put in order first. handle is Spark's; gaps are in seconds.
    """

    def __init__(self, gap: float, night: float, car: float):
        self.gaps = (gap, night, car)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "at timestamp, id string, car boolean")

    def _gap_ms(self, play: tuple) -> int:
        gap, night, car = self.gaps
        hour = pd.Timestamp(play[0]).hour
        return int(1000 * (car if play[2] else night if hour >= 23 or hour < 6 else gap))

    def _settle(self, key: tuple, plays: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        sessions: list[list[tuple]] = []
        for p in sorted(set(plays)):
            if sessions and _ms(p[0]) - _ms(sessions[-1][-1][0]) < self._gap_ms(sessions[-1][-1]):
                sessions[-1].append(p)
            else:
                sessions.append([p])
        over = [s for s in sessions if watermark - _ms(s[-1][0]) >= self._gap_ms(s[-1])]
        left = [p for s in sessions[len(over) :] for p in s]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if left:
            self.open.put(left)
            self.handle.registerTimer(_ms(left[-1][0]) + self._gap_ms(left[-1]))
        else:
            self.open.clear()
        if over:
            yield pd.DataFrame([(key[0], s[0][0], s[-1][0], len(s)) for s in over], columns=["owner", "start", "end", "plays"])

    def _held(self) -> list[tuple]:
        return [(pd.Timestamp(at).to_pydatetime(), i, bool(car)) for at, i, car in self.open.get()]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        plays = self._held()
        for b in rows:
            plays += [(pd.Timestamp(at).to_pydatetime(), i, bool(car)) for at, i, car in zip(b["occurred_at"], b["event_id"], b["car"], strict=True)]
        yield from self._settle(key, plays, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, self._held(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def open_sessions(stream: DataFrame, gap: float = 1800, night: float = 2700, car_gap: float = 3600, late: str = "1 hour") -> DataFrame:
    """Sessions of a stream of events by the adaptive gap, each sent once the watermark says that nothing can join or split it."""
    car = F.coalesce(F.lower(F.get_json_object("payload", "$.platform")).rlike("auto|car"), F.lit(False))
    rows = stream.select("owner", "event_id", "occurred_at", car.alias("car")).withWatermark("occurred_at", late)
    return rows.groupBy("owner").transformWithStateInPandas(OpenSessions(gap, night, car_gap), SESSION, "append", "eventTime")


DUE = "owner string, source_file string, day date"


class DaysDue(StatefulProcessor):
    """The days on which a device sent something, each with a timer where the device's retention ends; a day that is past it is due at once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day long", "due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, due = timerValues.getCurrentWatermarkInMs(), set()
        for b in rows:
            for day, keep in set(zip(b["day_ms"].tolist(), b["retention_days"].tolist(), strict=True)):
                ends = day + DAY_MS * (int(keep) + 1)
                if ends <= now:
                    due.add(day)
                elif not self.days.containsKey((day,)):
                    self.days.updateValue((day,), (ends,))
                    self.handle.registerTimer(ends)
        yield from self._sent(key, sorted(due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        due = sorted(day for (day,), (ends,) in list(self.days.iterator()) if ends <= now)
        for day in due:
            self.days.removeKey((day,))
        yield from self._sent(key, due)

    def _sent(self, key: tuple, days: list[int]) -> Iterator[pd.DataFrame]:
        if days:
            yield pd.DataFrame({"owner": key[0], "source_file": key[1], "day": [dt.date(1970, 1, 1) + dt.timedelta(milliseconds=d) for d in days]})

    def close(self) -> None:
        pass


def days_due(stream: DataFrame, devices: DataFrame, late: str = "1 hour") -> DataFrame:
    """(owner, source_file, day): days of a device whose details are past its retention, sent when they fall due.

    devices: owner, device_id, retention_days; devices without a retention keep everything.
    """
    limits = devices.filter("retention_days is not null").select("owner", F.concat(F.lit("scrobble:"), F.col("device_id")).alias("source_file"), F.col("retention_days").cast("int").alias("retention_days"))
    rows = stream.withWatermark("occurred_at", late).join(limits, ["owner", "source_file"])
    seen = rows.select("owner", "source_file", "occurred_at", (F.unix_date(F.to_date("occurred_at")).cast("long") * DAY_MS).alias("day_ms"), "retention_days")
    return seen.groupBy("owner", "source_file").transformWithStateInPandas(DaysDue(), DUE, "append", "eventTime")


def scrub_due(due: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Writes the days that fell due again without their details: of the table of events (partitions by day) only those days, of these only the devices' rows.

    A day that is scrubbed twice is as it was, so a batch may run again.
    """

    def scrub(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fell = written(batch.distinct(), "days-due")
        if fell.isEmpty():
            return
        held = table_of(spark, table).join(fell.select("day").distinct().filter("day is not null"), "day", "left_semi")
        marks = fell.select("owner", F.regexp_replace("source_file", "^scrobble:", "").alias("device_id"), "day", F.lit(-1).alias("retention_days"))
        parts = [ingest.scrubbed(held.filter(F.col("day") == F.lit(d)), marks.filter(F.col("day") == F.lit(d)), F.col("occurred_at")) for d in sorted(r.day for r in fell.select("day").distinct().collect())]
        for part in parts:  # a partition each, so that its rows are read before it is overwritten
            written(part, "scrubbed-day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(table)

    return due.writeStream.foreachBatch(scrub).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_until_current(frame: DataFrame, name: str, checkpoint: str, take: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Starts a stream over all that there is, into a table in memory or a function of batches."""
    w = frame.writeStream.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    return (w.foreachBatch(take) if take else w.format("memory").queryName(name)).start()
