"""Thresholds of the rules, as dataclasses; the defaults are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

MINUTE_MS, DAY_MS = 60_000, 86_400_000


@dataclass(frozen=True)
class Stays:
    agreement_m: float = 100.0
    cluster_radius_m: float = 150.0
    reportable_ms: int = 60_000
    merge_ms: int = 5 * MINUTE_MS


@dataclass(frozen=True)
class Keep:
    min_seconds: float = 30.0
    min_length_m: float = 50.0
    min_extent_m: float = 50.0


@dataclass(frozen=True)
class Quality:
    max_accuracy_m: float = 50.0
    raised_by: float = 2.5
    raised_most_kmh: float = 350.0
    standing_jump_m: float = 10.0
    stray_kmh: float = 40.0
    stray_times: float = 4.0


@dataclass(frozen=True)
class Dwell:
    corral_m: float = 55.0
    min_s: float = 600.0
    soft_exit_s: float = 120.0
    hard_exit_m: float = 110.0
    merge_s: float = 900.0
    merge_m: float = 100.0
    drift_m_min: float = 4.0
    decimate_s: float = 15.0


#: Short stops at a track's edges.
BRIEF = Dwell(min_s=30.0, soft_exit_s=30.0, merge_s=120.0, drift_m_min=10.0, decimate_s=5.0)


@dataclass(frozen=True)
class Edge:
    bin_s: float = 10.0
    tolerance_s: float = 15.0
    moving_mps: float = 0.7
    lookback_s: float = 30.0
    fraction: float = 1 / 3


@dataclass(frozen=True)
class Journeys:
    night_hour: int = 3
    name_floor_ms: int = 2 * 3_600_000
    names: int = 3


@dataclass(frozen=True)
class Live:
    min_fixes: int = 4
    span_s: float = 20.0
    moving_m: float = 40.0
    still_m: float = 15.0
    resume_s: float = 180.0
    give_up_s: float = 240.0  # 0: reception is never given up
    hold_s: float = 0.0  # how long a stop that nothing bears out is held; 0: it needs no bearing out
    departures_open: bool = False  # whether a departure alone opens a track
