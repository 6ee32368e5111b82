"""Run settings, passed to operators on the driver; defaults equal the product's defaults."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field


@dataclass(frozen=True)
class GridSpec:
    """A regular projected grid: cell (iy, ix) sits at (x0 + ix*dx, y0 + iy*dy)."""

    x0: float
    y0: float
    dx: float
    dy: float
    nx: int
    ny: int


@dataclass(frozen=True)
class SplitDates:
    """Inclusive date ranges of the three sample splits."""

    train_start: dt.date
    train_end: dt.date
    val_start: dt.date
    val_end: dt.date
    test_start: dt.date
    test_end: dt.date


@dataclass(frozen=True)
class Channel:
    variable: str
    level: str

    @property
    def name(self) -> str:
        return f"{self.variable}_{self.level.split('_')[0]}"


@dataclass(frozen=True)
class ReductionRules:
    """Byte budget of a sample set and the steps allowed to meet it."""

    budget_gb: float = 180.0
    drop_upper_air: bool = True
    two_hour_cadence_after_72h: bool = True
    cap_samples_per_incident: int = 240


@dataclass(frozen=True)
class SampleSettings:
    run_start: dt.date
    run_end: dt.date
    splits: SplitDates
    grid: GridSpec
    channels: tuple[Channel, ...]
    label: Channel
    patch: tuple[int, int] = (256, 256)
    leads: tuple[int, ...] = (12, 24)
    buffer_km: float = 30.0
    sample_hours: tuple[int, ...] | None = None
    hotspot_channel: str = "FRP"
    reduction: ReductionRules = field(default_factory=ReductionRules)
