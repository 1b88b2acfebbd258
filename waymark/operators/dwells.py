"""Rules that walk along one recording: dwells, stops at its edges, and thinned lines.

A recording is one row with an array of its fixes: Spark gathers and orders it,
and a task walks the arrays of a batch one after the other. What a walk holds is
one recording.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.config import BRIEF, Dwell, Edge
from waymark.operators.points import TRACK
from waymark.schemas import group_of

FIX = ("ts_ms", "seq", "lat", "lon", "speed")
_A, _E2 = 6_378_137.0, 0.00669437999014


def recordings(points: DataFrame, by: tuple[str, ...] = TRACK) -> DataFrame:
    """One row per track, or by other columns: by, floor_mps, fixes in order; only good fixes."""
    p = points.where(~F.col("ignored"))
    fix = F.struct("ts_ms", "seq", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.col("speed").cast("double").alias("speed"))
    moves = F.when(group_of(F.col("activity")).isin("VEHICLE", "AIR"), F.lit(5 / 3.6)).otherwise(F.lit(0.0))
    return p.groupBy(*by).agg(F.max(moves).alias("floor_mps"), F.array_sort(F.collect_list(fix)).alias("fixes"))


def near_m(lat1, lon1, lat2, lon2):
    """Metres between near points, by the ellipsoid's radii at their mean latitude; arrays or numbers."""
    mid = np.radians((lat1 + lat2) / 2)
    w = 1 - _E2 * np.sin(mid) ** 2
    north = np.radians(lat2 - lat1) * _A * (1 - _E2) / w**1.5
    east = np.radians(lon2 - lon1) * _A * np.cos(mid) / np.sqrt(w)
    return np.hypot(north, east)


def one_near_m(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """near_m of two points."""
    mid = math.radians((lat1 + lat2) / 2)
    w = 1 - _E2 * math.sin(mid) ** 2
    north = math.radians(lat2 - lat1) * _A * (1 - _E2) / w**1.5
    east = math.radians(lon2 - lon1) * _A * math.cos(mid) / math.sqrt(w)
    return math.hypot(north, east)


class Fixes:
    """A recording's columns as arrays."""

    def __init__(self, values: pa.StructArray):
        self.t, self.seq, self.lat, self.lon, self.speed = (values.field(c).to_numpy(zero_copy_only=False) for c in FIX)

    def metres(self, i: int, j) -> np.ndarray:
        return near_m(self.lat[i], self.lon[i], self.lat[j], self.lon[j])


def walked(recordings: DataFrame, walk, schema: str, names: list[str]) -> DataFrame:
    """Rows that ``walk(fixes, floor_mps)`` yields for each recording, after the columns that it is told by."""
    by = [c for c in recordings.columns if c not in ("floor_mps", "fixes")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors, lists = batch.columns[-2:]
            values, at = lists.values, lists.offsets.to_numpy()
            out: list[tuple] = []
            for k, floor in enumerate(floors.to_pylist()):
                out += [(k, *row) for row in walk(Fixes(values.slice(at[k], at[k + 1] - at[k])), floor)]
            rows, *columns = list(zip(*out)) or [()] * (1 + len(names))
            told = batch.select(by).take(pa.array(list(rows), pa.int64()))
            yield pa.RecordBatch.from_arrays([*told.columns, *(pa.array(list(c), kind) for c, kind in zip(columns, kinds))], [*by, *names])

    kinds = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[x.split()[1]] for x in schema.split(", ")]
    whole = ", ".join(f"{c} {recordings.schema[c].dataType.simpleString()}" for c in by)
    return recordings.select(*by, "floor_mps", "fixes").mapInArrow(run, f"{whole}, {schema}")


def thinned(t: np.ndarray, every_ms: float) -> np.ndarray:
    """Rows at least some time after the last one taken, and the last row."""
    taken, last = [], None
    for i, now in enumerate(t.tolist()):
        if last is None or now - last >= every_ms:
            taken.append(i)
            last = now
    if taken and taken[-1] != len(t) - 1:
        taken.append(len(t) - 1)
    return np.array(taken, np.int64)


def dwells_of(f: Fixes, rule: Dwell) -> list[tuple[int, int, float, float, int]]:
    """(entry, exit, lat, lon, samples): where a recording stayed within a corral around its running mean."""
    rows = thinned(f.t, rule.decimate_s * 1000)
    if len(rows) < 2 or f.t[rows[-1]] - f.t[rows[0]] < rule.min_s * 1000:
        return []
    t, lat, lon = (x[rows].tolist() for x in (f.t, f.lat, f.lon))
    found, i = [], 0
    while i < len(t) - 1:
        y, x, n, inside = lat[i], lon[i], 1, i
        for j in range(i + 1, len(t)):
            d = one_near_m(lat[j], lon[j], y, x)
            if d <= rule.corral_m:
                n += 1
                y, x, inside = y + (lat[j] - y) / n, x + (lon[j] - x) / n, j
            elif d > rule.hard_exit_m or t[j] - t[inside] >= rule.soft_exit_s * 1000:
                break
        span = t[inside] - t[i]
        drift = one_near_m(lat[i], lon[i], lat[inside], lon[inside]) / (span / 60_000) if span else 0.0
        if span >= rule.min_s * 1000 and drift <= rule.drift_m_min:
            found.append((t[i], t[inside], y, x, n))
            i = inside + 1
        else:
            i += 1
    joined = found[:1]
    for late in found[1:]:
        early = joined[-1]
        if late[0] - early[1] <= rule.merge_s * 1000 and one_near_m(early[2], early[3], late[2], late[3]) <= rule.merge_m:
            n = early[4] + late[4]
            mean = [(early[k] * early[4] + late[k] * late[4]) / n for k in (2, 3)]
            joined[-1] = (early[0], late[1], *mean, n)
        else:
            joined.append(late)
    return joined


def dwells(points: DataFrame, rule: Dwell = Dwell()) -> DataFrame:
    """device_id, track_id, entry_ms, exit_ms, lat, lon, samples."""
    return walked(recordings(points), lambda f, _: dwells_of(f, rule), "entry_ms long, exit_ms long, lat double, lon double, samples long", ["entry_ms", "exit_ms", "lat", "lon", "samples"])


def moving_bins(f: Fixes, rule: Edge, floor_mps: float, solo_mps: float = 2.5) -> np.ndarray:
    """Ascending numbers of the time bins in which enough fixes move.

    A fix moves if its displacement since the first fix in the lookback says so, and
    its own speed, where it has one. A bin needs its share of moving fixes, one that
    is fast enough alone, and no less than the activity's floor.
    """
    width, look = rule.bin_s * 1000, rule.lookback_s * 1000
    steps = np.sort(np.diff(f.t))
    usual = max(1, int(steps[len(steps) // 4])) if len(steps) else 1
    least = 2 if width // usual >= 2 else 1
    bins = f.t // int(width)
    i = np.arange(1, len(f.t))
    anchor = np.minimum(np.searchsorted(f.t, f.t[1:] - look, "left"), i)
    anchor = np.where(anchor == i, i - 1, anchor)
    dt = f.t[i] - f.t[anchor]
    with np.errstate(divide="ignore", invalid="ignore"):
        pace = near_m(f.lat[anchor], f.lon[anchor], f.lat[i], f.lon[i]) / (dt / 1000)
    own = f.speed[i].astype(float)
    votes = (dt >= look / 3) & (pace >= rule.moving_mps) & ~(own < rule.moving_mps)
    if not votes.any():
        return np.zeros(0, np.int64)
    # a bin's fixes stand together, so each bin is a stretch of the arrays
    own_bins, first = np.unique(bins[i], return_index=True)
    fast = np.add.reduceat(votes.astype(np.int64), first)
    peak = np.maximum.reduceat(np.where(votes, pace, -np.inf), first)
    held = np.searchsorted(bins, own_bins, "right") - np.searchsorted(bins, own_bins)
    needed = np.maximum(least, (held * rule.fraction).astype(np.int64))
    return own_bins[(fast > 0) & ((peak >= solo_mps) | ((fast >= needed) & (peak >= floor_mps)))]


def edge_stays_of(f: Fixes, floor_mps: float, rule: Edge, dwell: Dwell) -> list[tuple[str, int, int]]:
    """(side, boundary, stay_ms): a stop before a recording's first move, or after its last one."""
    stops = dwells_of(f, dwell)
    bins = moving_bins(f, rule, floor_mps) if stops else np.zeros(0, np.int64)
    if not len(bins):
        return []
    width = int(rule.bin_s * 1000)

    def cut(side: str, instant: float) -> int | None:
        """The row that stays, if its span is as narrow as a stop."""
        rows = np.flatnonzero(f.t < instant if side == "END" else f.t >= instant)
        if not len(rows):
            return None
        k = int(rows[-1] if side == "END" else rows[0])
        span = np.flatnonzero(f.t >= f.t[k] if side == "END" else f.t <= f.t[k])
        return k if f.metres(int(span[0]), span).max() <= dwell.hard_exit_m else None

    def known(side: str, instant: float) -> bool:
        return bool((f.t < instant).any() if side == "END" else (f.t >= instant).any())

    out = []
    edges = [("START", f.t[0], stops[0][0] - f.t[0], bins[0] * width, stops[0][1]), ("END", f.t[-1], f.t[-1] - stops[-1][1], (bins[-1] + 1) * width, stops[-1][0])]
    for side, edge, off, instant, bound in edges:
        if off > rule.tolerance_s * 1000 or not known(side, instant):
            continue
        k = cut(side, instant)
        k = cut(side, bound) if k is None else k
        if k is not None and abs(int(edge) - int(f.t[k])) >= dwell.min_s * 1000:
            out.append((side, int(f.t[k]), abs(int(edge) - int(f.t[k]))))
    return out


def raw(points: DataFrame) -> DataFrame:
    """Points as recorded: flags that the edge rule set before are taken off."""
    mine = F.coalesce(F.col("ignore_reason") == "edge_stay", F.lit(False))
    return points.withColumn("ignored", F.col("ignored") & ~mine).withColumn("ignore_reason", F.when(~mine, F.col("ignore_reason")))


def edge_stays(points: DataFrame, rule: Edge = Edge(), dwell: Dwell = BRIEF) -> DataFrame:
    """device_id, track_id, side (START or END), boundary_ms, stay_ms; two rows a track at most."""
    p = raw(points) if "ignore_reason" in points.columns else points
    return walked(recordings(p), lambda f, floor: edge_stays_of(f, floor, rule, dwell), "side string, boundary_ms long, stay_ms long", ["side", "boundary_ms", "stay_ms"])


def settled(points: DataFrame, rule: Edge = Edge(), dwell: Dwell = BRIEF) -> DataFrame:
    """Points with what lies beyond an edge stop ignored as edge_stay; running it again changes nothing."""
    p = raw(points if "ignore_reason" in points.columns else points.withColumn("ignore_reason", F.lit(None).cast("string")))
    stays = edge_stays(p, rule, dwell).groupBy(*TRACK).agg(F.max(F.when(F.col("side") == "START", F.col("boundary_ms"))).alias("_from"), F.max(F.when(F.col("side") == "END", F.col("boundary_ms"))).alias("_to"))
    p = p.join(stays.hint("merge"), list(TRACK), "left")
    out = ~F.col("ignored") & F.coalesce((F.col("ts_ms") < F.col("_from")) | (F.col("ts_ms") > F.col("_to")), F.lit(False))
    return p.withColumn("ignore_reason", F.when(out, "edge_stay").otherwise(F.col("ignore_reason"))).withColumn("ignored", F.col("ignored") | out).drop("_from", "_to")


def overruns(points: DataFrame) -> DataFrame:
    """What was flagged as edge_stay before the first and after the last good fix: side, stay_ms, fixes."""
    g = points.where(~F.col("ignored")).groupBy(*TRACK).agg(F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"))
    p = points.where("ignore_reason = 'edge_stay'").join(g, list(TRACK))
    side = F.when(F.col("ts_ms") < F.col("first"), "START").when(F.col("ts_ms") > F.col("last"), "END")
    o = p.withColumn("side", side).where("side is not null").groupBy(*TRACK, "side", "first", "last").agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b"), F.count("*").alias("fixes"))
    return o.select(*TRACK, "side", F.when(F.col("side") == "START", F.col("first") - F.col("a")).otherwise(F.col("b") - F.col("last")).alias("stay_ms"), "fixes")


#: Fixes between a chord's ends from which on arrays are faster than a loop.
LONG_CHORD = 64


def farthest(y: list[float], x: list[float], a: int, b: int) -> tuple[float, int]:
    """The greatest squared distance of the places between a and b from the chord of these two, and where it is."""
    dy, dx = y[b] - y[a], x[b] - x[a]
    length = dy * dy + dx * dx
    if b - a > LONG_CHORD:
        py, px = np.array(y[a + 1 : b]) - y[a], np.array(x[a + 1 : b]) - x[a]
        part = np.clip((py * dy + px * dx) / length, 0, 1) if length else np.zeros(len(py))
        off = (py - part * dy) ** 2 + (px - part * dx) ** 2
        k = int(off.argmax())
        return float(off[k]), a + 1 + k
    most, at = -1.0, a + 1
    for i in range(a + 1, b):
        py, px = y[i] - y[a], x[i] - x[a]
        part = (py * dy + px * dx) / length if length else 0.0
        part = 0.0 if part < 0 else 1.0 if part > 1 else part
        ey, ex = py - part * dy, px - part * dx
        off = ey * ey + ex * ex
        if off != off:  # as argmax: a place that is no number counts as farthest
            return off, i
        if off > most:
            most, at = off, i
    return most, at


def line_rows(lat: np.ndarray, lon: np.ndarray, tolerance: float) -> np.ndarray:
    """Rows that a line of arrays keeps."""
    return np.array(line_places(lat.tolist(), lon.tolist(), tolerance), np.int64)


def line_places(lat: list[float], lon: list[float], tolerance: float) -> list[int]:
    """Rows that a line keeps: first those beyond a radius of the last one, then Douglas and Peucker's."""
    end = len(lat) - 1
    if end <= 1:
        return list(range(len(lat)))
    most = tolerance * tolerance
    kept, y0, x0 = [0], lat[0], lon[0]
    for i in range(1, len(lat)):
        if (lat[i] - y0) ** 2 + (lon[i] - x0) ** 2 > most:
            kept.append(i)
            y0, x0 = lat[i], lon[i]
    if (y0, x0) != (lat[end], lon[end]):
        kept.append(end)
    y, x = [lat[i] for i in kept], [lon[i] for i in kept]
    keep = [0] if len(kept) == 1 else [0, len(kept) - 1]
    open_ = [(0, len(kept) - 1)]
    while open_:
        a, b = open_.pop()
        if b - a < 2:
            continue
        off, k = farthest(y, x, a, b)
        if off > most:
            keep.append(k)
            open_ += [(a, k), (k, b)]
    return [kept[k] for k in sorted(keep)]


def simplified(points: DataFrame, tolerance: float = 1e-4, by: tuple[str, ...] = TRACK) -> DataFrame:
    """device_id, track_id, seq of the good fixes that a line within a tolerance in degrees keeps; a line a track, or by other columns."""
    return walked(recordings(points, by), lambda f, _: [(int(f.seq[i]),) for i in line_rows(f.lat, f.lon, tolerance)], "seq long", ["seq"])
