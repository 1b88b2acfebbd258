"""Decision tables of the rules that walk along a recording."""

import random

import numpy as np
import pytest

from waymark.config import BRIEF, Dwell, Edge
from waymark.operators import dwells

SCHEMA = "device_id long, track_id long, activity string, seq int, ts_ms long, lat double, lon double, speed double, ignored boolean, ignore_reason string, segment_start boolean"
M = 1 / 111_195  # degrees of latitude in a metre


def recording(legs, activity="DRIVING", track=1, step_s=5, doppler=False, noise=0.0):
    """Fixes northward: legs are (seconds, metres per second)."""
    rng, rows, t, y = random.Random(track), [], 0, 0.0
    for seconds, pace in legs:
        for _ in range(0, seconds, step_s):
            rows.append((1, track, activity, len(rows), 1_700_000_000_000 + t * 1000, 38 + y * M + rng.uniform(-noise, noise) * M, -9.0, float(pace) if doppler else None, False, None, False))
            t, y = t + step_s, y + pace * step_s
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_a_stop_is_one_dwell(spark):
    got = dwells.dwells(frame(spark, recording([(300, 10), (900, 0), (300, 10)]))).collect()
    assert len(got) == 1
    assert 880 <= (got[0]["exit_ms"] - got[0]["entry_ms"]) / 1000 <= 940
    assert abs(got[0]["lat"] - (38 + 3000 * M)) < 60 * M


@pytest.mark.parametrize("legs,n", [([(300, 10), (500, 0), (300, 10)], 0), ([(3000, 10)], 0), ([(1200, 0.08)], 0), ([(1200, 0.0)], 1), ([(700, 0), (60, 20), (700, 0)], 2), ([(60, 0)], 0)])
def test_dwell_table(spark, legs, n):
    # too short; on the move; drifting through; all of it; two places; shorter than a dwell
    assert dwells.dwells(frame(spark, recording(legs))).count() == n


def test_near_dwells_merge(spark):
    legs = [(700, 0), (30, 3), (700, 0)]  # 90 m apart, half a minute between
    assert dwells.dwells(frame(spark, recording(legs))).count() == 1
    assert dwells.dwells(frame(spark, recording(legs)), Dwell(merge_m=50.0)).count() == 2


def test_edge_stays(spark):
    both = recording([(120, 0), (300, 20), (180, 0)], noise=1.0)
    got = {r["side"]: r for r in dwells.edge_stays(frame(spark, both)).collect()}
    assert set(got) == {"START", "END"}
    assert 90_000 <= got["START"]["stay_ms"] <= 130_000 and 150_000 <= got["END"]["stay_ms"] <= 190_000
    assert not dwells.edge_stays(frame(spark, recording([(600, 10)]))).count()
    assert not dwells.edge_stays(frame(spark, recording([(600, 0)], noise=1.0))).count()


def test_doppler_vetoes_and_is_vetoed(spark):
    still = [(*r[:7], 3.0, *r[8:]) for r in recording([(300, 0)], noise=1.0)]  # phantom speed, no displacement
    assert not dwells.edge_stays(frame(spark, still)).count()
    f = dwells.Fixes.__new__(dwells.Fixes)
    rows = recording([(100, 10)])
    f.t, f.lat, f.lon = (np.array([r[k] for r in rows]) for k in (4, 5, 6))
    f.speed = np.zeros(len(rows))
    assert not len(dwells.moving_bins(f, Edge(), 0.0))
    f.speed = np.full(len(rows), np.nan)
    assert len(dwells.moving_bins(f, Edge(), 0.0)) >= 9


def test_settled_twice_is_settled_once(spark):
    rows = recording([(120, 0), (300, 20), (180, 0)], noise=1.0) + recording([(300, 20)], track=2)
    once = dwells.settled(frame(spark, rows))
    flags = lambda df: sorted((r["track_id"], r["seq"], r["ignored"], r["ignore_reason"]) for r in df.collect())
    assert flags(once) == flags(dwells.settled(once.select(*frame(spark, rows).columns)))
    out = {r["side"]: r for r in dwells.overruns(once).collect()}
    stays = {r["side"]: r for r in dwells.edge_stays(frame(spark, rows)).collect()}
    assert {s: o["stay_ms"] for s, o in out.items()} == {s: x["stay_ms"] for s, x in stays.items()}


def test_floor_of_vehicles(spark):
    crawl = [(120, 0), (120, 1.0), (120, 0)]  # slower than a vehicle goes
    assert dwells.edge_stays(frame(spark, recording(crawl, "WALKING", noise=0.2))).count() >= dwells.edge_stays(frame(spark, recording(crawl, "DRIVING", noise=0.2))).count()


@pytest.mark.parametrize("seed", range(4))
def test_line_keeps_what_matters(seed):
    rng = np.random.default_rng(seed)
    y, x = np.cumsum(rng.normal(0, 1e-4, 300)), np.cumsum(rng.normal(0, 1e-4, 300))
    kept = dwells.line_rows(y, x, 2e-4)
    assert kept[0] == 0 and kept[-1] == 299 and (np.diff(kept) > 0).all() and len(kept) < 200
    a, b = np.stack([y, x], 1)[kept[:-1]], np.stack([y, x], 1)[kept[1:]]
    for p in np.stack([y, x], 1):
        d = b - a
        t = np.clip(((p - a) * d).sum(1) / (d * d).sum(1), 0, 1)
        assert np.sqrt((((a + t[:, None] * d) - p) ** 2).sum(1)).min() <= 4e-4 + 1e-12  # once for each pass


def test_small_lines():
    assert dwells.line_rows(np.array([]), np.array([]), 1.0).tolist() == []
    assert dwells.line_rows(np.array([1.0, 1.0]), np.array([2.0, 2.0]), 1.0).tolist() == [0, 1]
    assert dwells.line_rows(np.zeros(5), np.zeros(5), 1.0).tolist() == [0]


def test_empty(spark):
    e = frame(spark, [])
    assert dwells.dwells(e).count() == dwells.edge_stays(e).count() == dwells.simplified(e).count() == dwells.settled(e).count() == 0
    assert BRIEF.min_s == 30.0


def test_long_and_short_chords_keep_the_same_places(monkeypatch):
    rng = np.random.default_rng(3)
    for n in (3, 20, 200):
        y, x = np.cumsum(rng.normal(0, 1e-4, n)), np.cumsum(rng.normal(0, 1e-4, n))
        for gap in (None, n // 2):
            if gap:
                y[gap] = np.nan
            kept = []
            for least in (0, 1000):
                monkeypatch.setattr(dwells, "LONG_CHORD", least)
                kept.append(dwells.line_rows(y, x, 1e-4).tolist())
            assert kept[0] == kept[1]
