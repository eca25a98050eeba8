"""Distances between tracks as a disc jockey has them: keys on the Camelot wheel, tempos as ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_distance(number_a: Column, mode_a: Column, number_b: Column, mode_b: Column) -> Column:
    """Steps on the wheel of twelve, one more for the other mode; 1.5 where a key is unknown."""
    apart = F.abs(number_a - number_b)
    steps = F.least(apart, 12 - apart) + F.when(mode_a == mode_b, 0).otherwise(1)
    return F.coalesce(steps.cast("double"), F.lit(1.5))


def tempo_distance(a: Column, b: Column) -> Column:
    """Semitones between tempos, half and double tempo counting as near."""
    ratio = F.abs(F.log2(a / b))
    return F.least(ratio * 12, F.abs(ratio - 1) * 12 + 0.15)
