"""Joins that Spark has no operator for, as compositions of those it has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, values: list[str]) -> DataFrame:
    """left with the values of right's latest row of the same keys with since <= at; nulls where there is none.

    One shuffle by key: both sides are stacked and the last known values are carried forward, so no
    pairs are formed. Among right rows of the same key and time the greatest values win.
    """
    names = left.columns
    marked = left.select(*[F.col(c) for c in names], F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(_struct(right, values)).alias("_v"))
    events = right.select(*[F.col(k) for k in keys], *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names if c not in keys], F.col(since).cast(left.schema[at].dataType).alias("_at"), F.lit(0).alias("_side"), F.struct(*values).alias("_v"))
    both = marked.unionByName(events)
    w = Window.partitionBy(*keys).orderBy("_at", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    return filled.select(*names, *[F.col("_v")[v].alias(v) for v in values])


def _struct(df: DataFrame, values: list[str]) -> str:
    return "struct<" + ",".join(f"{v}:{df.schema[v].dataType.simpleString()}" for v in values) + ">"


def near_in_time(left: DataFrame, right: DataFrame, keys: list[str], at: str, other_at: str, seconds: float, how: str = "left_anti") -> DataFrame:
    """Rows of left that have (left_semi) or lack (left_anti) a row of right with equal keys within so many seconds.

    Time is cut into buckets of that length; a row of right is put into three of them, so the join is on equal keys.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1e6)).cast("long")
    a = left.withColumn("_bucket", bucket(at))
    b = right.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(other_at).alias("_other"), F.explode(F.sequence(bucket(other_at) - 1, bucket(other_at) + 1)).alias("_b"))
    apart = F.abs(F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("_other").cast("timestamp")))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_bucket") == F.col("_b"), apart <= seconds * 1e6]
    return a.join(b, reduce(Column.__and__, on), how).drop("_bucket")


#: The most bits of a bitmap of keys that are asked for: 32 MB, for any number of them.
_BITS = 1 << 28


def asked_mark(held: DataFrame, asking: DataFrame, *keys: str) -> DataFrame:
    """held with _maybe: whether some row of asking may have its keys, false if surely none has; a bitmap of hashed keys with eight bits a key."""
    bits = min(_BITS, 1 << max(15, (8 * asking.count()).bit_length()))  # a number of rows
    spot = F.pmod(F.xxhash64(*keys), F.lit(bits))
    marks = asking.select(spot.alias("s")).groupBy(F.expr("s div 32768").alias("_bucket")).agg(F.expr("bitmap_construct_agg(s % 32768)").alias("_bits"))
    met = held.withColumn("_s", spot).withColumn("_bucket", F.expr("_s div 32768")).join(F.broadcast(marks), "_bucket", "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_s") % 32768 / 8 + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, (F.col("_s") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return met.select(*held.columns, F.coalesce(hit, F.lit(False)).alias("_maybe"))


def maybe_asked(held: DataFrame, asking: DataFrame, *keys: str) -> DataFrame:
    """The held rows whose keys some row of asking may have, a few others too."""
    return asked_mark(held, asking, *keys).filter("_maybe").drop("_maybe")


def without(held: DataFrame, asking: DataFrame, *keys: str, also: tuple[str, ...] = (), sift: bool = False) -> DataFrame:
    """The held rows that no row of asking has the keys of (and what else is named), nulls being equal. Only those that may be asked for are shuffled; the others stay where they are. sift: those of asking that held lacks too, for an asking that is much larger."""
    m = asked_mark(held, asking, *keys)
    other = (maybe_asked(asking, held, *keys) if sift else asking).select(*[F.col(k).alias(f"_asked_{k}") for k in (*keys, *also)])
    met = m.filter("_maybe").drop("_maybe").join(other, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_asked_{k}")) for k in (*keys, *also)]), "left_anti")
    return m.filter("not _maybe").drop("_maybe").unionByName(met)


def spread(df: DataFrame, count: int, *keys: str, rows: int = 100_000) -> DataFrame:
    """df, of so many rows, dealt by keys into parts of some 100,000 (rows), so that what a task sorts and counts does not grow with the table."""
    return df.repartition(max(1, -(-count // rows)), *keys)


def any_of(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], key: str, columns: list[str]) -> DataFrame:
    """(key, columns): an OR of equalities as a union of equi-joins, each pair of rows once."""
    parts = [left.join(right, left[a] == right[b]).select(left[key], *[right[c] for c in columns]) for a, b in pairs]
    return reduce(DataFrame.unionByName, parts).distinct()


def latest_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the last in that order."""
    w = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def top_by(df: DataFrame, keys: list[str], n: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first n rows of each key, with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def _blocks(day: Column, levels: int) -> Column:
    """The aligned blocks that a day lies in, of 1, 2, 4 ... days."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", day, k).alias("block")))


def _cover(first: Column, last: Column, levels: int) -> Column:
    """The fewest aligned blocks that make up the days from first to last, two of a length at most but for the longest."""
    part = lambda k, b: F.array(F.struct(k.alias("level"), b.alias("block")))
    none = F.array().cast("array<struct<level:int,block:int>>")
    start = F.struct(first.alias("lo"), (last + 1).alias("hi"), none.alias("out"))

    def step(a: Column, k: Column) -> Column:
        left = (a["lo"] < a["hi"]) & (a["lo"] % 2 == 1)
        lo = F.when(left, a["lo"] + 1).otherwise(a["lo"])
        right = (lo < a["hi"]) & (a["hi"] % 2 == 1)
        hi = F.when(right, a["hi"] - 1).otherwise(a["hi"])
        out = F.concat(a["out"], F.when(left, part(k, a["lo"])).otherwise(none), F.when(right, part(k, hi)).otherwise(none))
        return F.struct(F.call_function("shiftright", lo, F.lit(1)).alias("lo"), F.call_function("shiftright", hi, F.lit(1)).alias("hi"), out.alias("out"))

    def rest(a: Column) -> Column:
        longest = F.transform(F.sequence(a["lo"], a["hi"] - 1), lambda b: F.struct(F.lit(levels - 1).alias("level"), b.alias("block")))
        return F.concat(a["out"], F.when(a["lo"] < a["hi"], longest).otherwise(none))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 2)), start, step, rest)


#: Days are counted from here, so that those of four-digit years are not negative, and fit LEVELS bits.
EPOCH, LEVELS = 800_000, 22


def day_number(day: Column) -> Column:
    return (F.unix_date(day) + EPOCH).cast("int")


def day_blocks(day: Column, levels: int = LEVELS) -> Column:
    """An array of (level, block): the aligned blocks of 1, 2, 4 ... days around a day."""
    return _blocks(day_number(day), levels)


def span_blocks(first: Column, last: Column, levels: int = LEVELS) -> Column:
    """An array of (level, block): the aligned blocks that make up the days from first to last, both included; some 2 log2(days) of them."""
    return _cover(day_number(first), day_number(last), levels)


def latest_cover(points: DataFrame, spans: DataFrame, keys: list[str], day: str, first: str, last: str, order: str, value: str) -> DataFrame:
    """points with the value of the span of equal keys that covers its day; of several the one with the greatest order, then value; null without one.

    No pair of a point and a span is formed, however many spans overlap: each span is cut into aligned blocks of days, of the spans of one block only
    the winner stays, and each key and day looks up the few blocks that it lies in. Null keys, days and ends match nothing.
    """
    cut = spans.filter(F.col(first) <= F.col(last)).select(*keys, F.struct(F.col(order).alias("o"), F.col(value).alias("v")).alias("_won"), F.explode(span_blocks(F.col(first), F.col(last))).alias("_b"))
    winners = cut.groupBy(*keys, "_b").agg(F.max("_won").alias("_won"))
    asked = points.select(*keys, F.col(day).alias("_day")).filter("_day is not null").distinct().withColumn("_b", F.explode(day_blocks(F.col("_day"))))
    found = asked.join(winners, [*keys, "_b"]).groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys], "_day").agg(F.max("_won").alias("_won"))
    on = [F.col(k) == F.col(f"_of_{k}") for k in keys] + [F.col(day) == F.col("_day")]
    return points.join(found, reduce(Column.__and__, on), "left").select(*points.columns, F.col("_won.v").alias(value))
