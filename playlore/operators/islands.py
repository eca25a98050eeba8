"""Gaps and islands: runs of consecutive values, runs of equal values, sessions by a gap rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_runs(days: DataFrame, keys: list[str], day: str = "day", step: int = 1) -> DataFrame:
    """keys, start, end, length: runs of days that are `step` apart. Days may repeat."""
    one = days.select(*keys, F.col(day)).distinct()
    w = Window.partitionBy(*keys).orderBy(day)
    marked = one.withColumn("_run", F.date_sub(F.col(day), (F.row_number().over(w) * step).cast("int")))
    return marked.groupBy(*keys, "_run").agg(F.min(day).alias("start"), F.max(day).alias("end"), F.count(F.lit(1)).alias("length")).drop("_run")


def change_runs(df: DataFrame, keys: list[str], order: list[str], changed: Column, name: str = "run") -> DataFrame:
    """df with the number of its run: a new one starts wherever changed holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    flagged = df.withColumn("_new", F.when(F.coalesce(changed, F.lit(False)), 1).otherwise(0))
    return flagged.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def gap_sessions(df: DataFrame, owner: str, at: str, tie: str, limit_seconds: Column, name: str = "session") -> DataFrame:
    """df with a session number for each owner. A row opens a session unless less than limit_seconds have passed since the row before.

    limit_seconds may use previous_<column> of hour and platform, which are added for it.
    """
    w = Window.partitionBy(owner).orderBy(at, tie)
    seen = df.withColumns({"gap_seconds": F.timestamp_diff("MICROSECOND", F.lag(at).over(w), F.col(at)) / 1e6, "previous_hour": F.hour(F.lag(at).over(w)), "previous_platform": F.lag("platform").over(w)})
    opens = F.col("gap_seconds").isNull() | (F.col("gap_seconds") >= limit_seconds)
    numbered = seen.withColumn("_new", F.when(opens, 1).otherwise(0)).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.drop("_new", "previous_hour", "previous_platform")


def last_known(value: Column, keys: list[str], *order) -> Column:
    """The last value up to this row that is not null."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
