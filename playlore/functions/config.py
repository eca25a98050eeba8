"""Parameters of the pipeline and of the queries; none is read from a global place."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import ClassVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _clamped(x: float, low: float, high: float) -> float:
    return min(max(x, low), high)


@dataclass(frozen=True)
class Tuning:
    """Bounds are enforced when made with sane()."""

    short_play_seconds: float = 30
    gap_min: float = 30
    gap_night_min: float = 45
    gap_car_min: float = 60
    attention_gap_min: float = 120
    loop_repeat: float = 0.25
    discovery_novelty: float = 0.5
    wander_entropy: float = 2.5
    restless_skip: float = 0.4
    stuck_repeat_plays: int = 8
    poll_skip_ratio: float = 0.85
    poll_skip_slack_ms: int = 15_000
    binge_hours: float = 3
    skiphall_min_shown: int = 8
    skiphall_min_rate: float = 0.85
    scene_floor: float = 0.3

    BOUNDS: ClassVar[dict[str, tuple[float, float]]] = {"short_play_seconds": (5, 120), "gap_min": (5, 1440), "gap_night_min": (5, 1440), "gap_car_min": (5, 1440), "attention_gap_min": (10, 1440), "stuck_repeat_plays": (3, 50), "poll_skip_ratio": (0.1, 1), "skiphall_min_rate": (0.1, 1), "scene_floor": (0, 1)}

    def sane(self) -> "Tuning":
        return replace(self, **{f.name: _clamped(getattr(self, f.name), *self.BOUNDS[f.name]) for f in fields(self) if f.name in self.BOUNDS})


@dataclass(frozen=True)
class EraParams:
    threshold: float = 0.04
    gap_weeks: int = 6
    min_weeks: int = 3
    top_artists: int = 40

    def sane(self) -> "EraParams":
        return EraParams(_clamped(self.threshold, 0.0, 1.0), int(_clamped(self.gap_weeks, 1, 52)), int(_clamped(self.min_weeks, 1, 26)), int(_clamped(self.top_artists, 5, 200)))


@dataclass(frozen=True)
class Lens:
    """What nearly every query looks through: attended plays of an inclusive range of years."""

    attended_only: bool = True
    first_year: int | None = None
    last_year: int | None = None

    def plays(self, df: DataFrame) -> DataFrame:
        """Filters alone, on plain columns, so that they reach the scan."""
        return self._years(df.filter("attended") if self.attended_only else df, "day")

    def sessions(self, df: DataFrame) -> DataFrame:
        return self._years(df.filter("attention <> 'unattended'") if self.attended_only else df, "day")

    def _years(self, df: DataFrame, day: str) -> DataFrame:
        if self.first_year is not None:
            df = df.filter(F.col(day) >= F.lit(f"{self.first_year}-01-01").cast("date"))
        if self.last_year is not None:
            df = df.filter(F.col(day) < F.lit(f"{self.last_year + 1}-01-01").cast("date"))
        return df
