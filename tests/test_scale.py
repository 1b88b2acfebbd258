"""Rules that have to stay linear in a device's or a recording's rows, against plain versions of themselves."""

import time

import numpy as np
from pyspark.sql import functions as F

from waymark.config import DAY_MS, Edge
from waymark.operators import dwells, journeys, shown
from waymark.plans.history import History

SF = "/root/testdata/sf0.001"
HOUR = 3_600_000


def test_windows_of_a_device_with_many_stays(spark):
    n = 40_000
    stays = spark.range(n).select(F.lit(1).cast("long").alias("device_id"), (F.col("id") * 2 * HOUR).alias("start"), (F.col("id") * 2 * HOUR + HOUR).alias("end"))
    nights = [(1, k, k * DAY_MS + 3 * HOUR, (k + 1) * DAY_MS + 3 * HOUR) for k in range(0, 3000, 7)]
    trips = spark.createDataFrame(nights, "device_id long, first_night long, first_at long, last_at long")
    began = time.perf_counter()
    got = {r.first_night: (r.left_home, r.reached_home) for r in journeys.windows(trips, stays, 1 << 50).collect()}
    assert time.perf_counter() - began < 20
    starts, ends = np.arange(n) * 2 * HOUR, np.arange(n) * 2 * HOUR + HOUR
    for _, k, first, last in nights:
        assert got[k] == (ends[ends <= first].max() if (ends <= first).any() else None, starts[starts >= last].min())


def plain_bins(f, rule, floor_mps, solo_mps=2.5):
    width, look = rule.bin_s * 1000, rule.lookback_s * 1000
    steps = sorted(np.diff(f.t).tolist())
    least = 2 if width // max(1, steps[len(steps) // 4]) >= 2 else 1
    pace, votes = {}, set()
    for i in range(1, len(f.t)):
        a = next(k for k in range(i + 1) if f.t[k] >= f.t[i] - look)
        a = i - 1 if a == i else a
        dt = f.t[i] - f.t[a]
        pace[i] = dwells.one_near_m(f.lat[a], f.lon[a], f.lat[i], f.lon[i]) / (dt / 1000) if dt else 0.0
        if dt >= look / 3 and pace[i] >= rule.moving_mps and not f.speed[i] < rule.moving_mps:
            votes.add(i)
    out = []
    for b in sorted({int(t // width) for t in f.t}):
        fast = [pace[i] for i in votes if f.t[i] // width == b]
        held = sum(int(t // width) == b for t in f.t)
        if fast and (max(fast) >= solo_mps or (len(fast) >= max(least, int(held * rule.fraction)) and max(fast) >= floor_mps)):
            out.append(b)
    return out


class Track:
    def __init__(self, seed, n, step):
        rng = np.random.default_rng(seed)
        self.t = np.cumsum(rng.integers(1, step, n)) * 1000
        pace = np.where(rng.random(n) < 0.5, 0, rng.random(n) * 2e-5)
        self.lat, self.lon = 38 + np.cumsum(pace), -9 + np.cumsum(pace) / 2
        self.speed = np.where(rng.random(n) < 0.3, np.nan, rng.random(n) * 2)


def test_moving_bins():
    for seed in range(30):
        f = Track(seed, 150, 2 + seed % 9)
        assert dwells.moving_bins(f, Edge(), [0.0, 1.4][seed % 2]).tolist() == plain_bins(f, Edge(), [0.0, 1.4][seed % 2])
    day = Track(1, 48 * 3600, 2)
    began = time.perf_counter()
    dwells.moving_bins(day, Edge(), 0.0)
    assert time.perf_counter() - began < 1


def test_journey_lines_are_lines_of_whole_stretches(spark):
    h = History(spark, SF)
    got = sorted(map(tuple, shown.journey_lines(h.windows, h.tracks, h.points, 1e-4).collect()))
    windows = [(r.device_id, r.first_night, r.a, r.b) for r in h.windows.collect()]
    tracks = [(r.device_id, r.track_id, r.started_at, r.ended_at) for r in h.tracks.collect()]
    shown_in = sorted((d, n, t) for d, n, a, b in windows for e, t, s, u in tracks if d == e and s < b and a < u)
    fixes = {}
    for r in h.points.collect():
        fixes.setdefault((r.device_id, r.track_id), []).append(r)
    want = []
    for d, n, t in shown_in:
        lines, carried = [], False
        for r in sorted(fixes[d, t], key=lambda r: (r.ts_ms, r.seq)):
            carried |= r.segment_start
            if r.ignored:
                continue
            if carried or not lines:
                lines.append([])
            lines[-1].append(r)
            carried = False
        for k, line in enumerate(lines):
            rows = dwells.line_rows(np.array([r.lat for r in line]), np.array([r.lon for r in line]), 1e-4)
            want += [(d, n, t, k, line[i].seq) for i in rows]
    assert got == sorted(want) and got
