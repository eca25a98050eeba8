"""Expressions whose meaning differs between engines, stated once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS = 3_600_000.0


def hours(ms: Column) -> Column:
    """Milliseconds as hours. Not rounded: a sum of whole numbers and one division are exact in any engine, rounding is not."""
    return ms.cast("double") / F.lit(HOUR_MS)


def minutes(ms: Column) -> Column:
    return ms.cast("double") / F.lit(60_000.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null where b is 0."""
    return a.cast("double") / F.when(b != 0, b.cast("double"))


def share(condition: Column) -> Column:
    """The share of rows where condition holds."""
    return F.avg(condition.cast("double"))


def week(day: Column) -> Column:
    """The Monday of the ISO week."""
    return F.date_sub(day, F.weekday(day))


def month(day: Column) -> Column:
    return F.trunc(day, "month")


def dow0(day: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(day) - 1


def text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def arg_max(value: Column, *order: Column) -> Column:
    """value where order is greatest, rows with a null value left out; later orders break ties."""
    return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))


def arg_min(value: Column, *order: Column) -> Column:
    return F.min_by(value, F.when(value.isNotNull(), F.struct(*order)))


def entropy_bits(p: Column) -> Column:
    """The term of a share p in an entropy in bits; 0 for p = 0."""
    return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)
