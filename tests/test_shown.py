"""Clocks of rows, colour ramps, tracks as columns, packed atlases, places at the ends of trips."""

import datetime as dt
import math
import tempfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from waymark.operators import dwells, places, ramps, zones
from waymark.operators.cities import ATLAS
from waymark.sources import columnar, packed_atlas
from waymark.sources.shared import kept

UTC = dt.timezone.utc
FIX = "device_id long, track_id long, seq int, ts_ms long, lat double, lon double, activity string, speed double, alt double, cn0 double, ignored boolean, ignore_reason string, segment_start boolean, extra string"


def ms(*when):
    return int(dt.datetime(*when, tzinfo=UTC).timestamp() * 1000)


def fixes(rng, track, n, odd=0.2):
    lat, lon = 38 + np.cumsum(rng.normal(0, 2e-4, n)), -9 + np.cumsum(rng.normal(0, 2e-4, n))
    reason = lambda: [None, "accuracy", "jump", "no_gnss", "edge_stay", "other"][rng.integers(6)]
    return [(1, track, i, 1000 * i, float(lat[i]), float(lon[i]), "WALKING", None if i % 5 == 0 else 1.5, None, None, bool(rng.random() < odd), reason(), bool(rng.random() < 0.1), "x") for i in range(n)]


# --- ramps


def bands(spark, rows, metric, imperial=False):
    got = ramps.ramped(spark.createDataFrame(rows, FIX), metric, imperial).orderBy("track_id", "seq").collect()
    return [(r["red"], r["blue"], r["band"]) for r in got]


def row(seq, activity="WALKING", speed=None, alt=None, cn0=None, track=1):
    return (1, track, seq, seq * 1000, 38.0, -9.0, activity, speed, alt, cn0, False, None, False, None)


def test_speed_anchors_follow_activity_and_units(spark):
    rows = [row(0, "WALKING", 5 / 3.6), row(1, "DRIVING", 90 / 3.6), row(2, "HOVERCRAFT", 30 / 3.6), row(3, None, 500.0), row(4, "FLIGHT", 0.0)]
    assert bands(spark, rows, "speed") == [(2.0, 8.0, 16), (30.0, 150.0, 16), (30.0, 150.0, 0), (30.0, 150.0, 32), (200.0, 1000.0, 0)]
    assert [b[:2] for b in bands(spark, rows, "speed", True)] == [(1.0, 5.0), (20.0, 90.0), (20.0, 90.0), (20.0, 90.0), (150.0, 650.0)]


def test_elevation_spans_a_track(spark):
    rows = [row(0, alt=100.0), row(1, alt=None), row(2, alt=140.0), row(3, alt=120.0), row(0, alt=7.0, track=2), row(1, alt=7.0, track=2), row(0, track=3)]
    assert bands(spark, rows, "elevation") == [(100, 140, 0), (100, 140, None), (100, 140, 32), (100, 140, 16), (7, 8, 0), (7, 8, 0), (None, None, None)]
    legend = {r["track_id"]: (r["left"], r["middle"], r["right"]) for r in ramps.legends(ramps.ramped(spark.createDataFrame(rows, FIX), "elevation")).collect()}
    assert legend == {1: (100, 120, 140), 2: (7, 8, 8), 3: (None, None, None)}


def test_signal_and_unknown_metrics(spark):
    assert [b for *_, b in bands(spark, [row(0, cn0=15.0), row(1, cn0=60.0), row(2), row(3, cn0=30.0)], "cn0")] == [0, 32, None, 16]
    assert bands(spark, [], "cn0") == []
    with pytest.raises(ValueError):
        ramps.ramped(spark.createDataFrame([], FIX), "colour")


# --- clocks

ZONES = [(1, 10, "Europe/Lisbon"), (1, 20, "Europe/Madrid"), (1, 30, None), (2, 10, "Asia/Tokyo")]
BETWEEN = "device_id long, kind string, after_track_id long, start long, end long, from_place long, to_place long"


def slices(spark, rows, now=ms(2024, 6, 9)):
    z = zones.interval_zones(spark.createDataFrame(rows, BETWEEN), spark.createDataFrame(ZONES, "device_id long, place long, zone string"))
    got = zones.filed_day(zones.sliced(z, F.lit(now))).orderBy("after_track_id", "slice_start").collect()
    return [(r["after_track_id"], r["slice_start"], r["slice_end"], r["holds_start"], r["holds_end"], r["zone"], r["end_zone"], str(r["day"])) for r in got]


def test_stays_are_cut_at_the_midnights_of_their_place(spark):
    a, b = ms(2024, 6, 1, 20), ms(2024, 6, 2, 5)
    cut = ms(2024, 6, 1, 22)  # Madrid's midnight in summer
    assert slices(spark, [(1, "STAY", 1, a, b, 20, None)]) == [(1, a, cut, True, False, "Europe/Madrid", "Europe/Madrid", "2024-06-01"), (1, cut, b, False, True, "Europe/Madrid", "Europe/Madrid", "2024-06-02")]
    # one place, two devices: each has its own
    assert slices(spark, [(2, "STAY", 1, a, b, 10, 10)]) == [(1, a, b, True, True, "Asia/Tokyo", "Asia/Tokyo", "2024-06-02")]


def test_days_of_23_and_25_hours(spark):
    a, b = ms(2024, 3, 30, 12), ms(2024, 4, 1, 12)
    spring = [s[1:3] for s in slices(spark, [(1, "STAY", 1, a, b, 20, 20)])]
    assert [(y - x) / 3.6e6 for x, y in spring] == [11, 23, 14]
    autumn = [s[1:3] for s in slices(spark, [(1, "STAY", 1, ms(2024, 10, 26, 12), ms(2024, 10, 28, 12), 20, 20)])]
    assert [(y - x) / 3.6e6 for x, y in autumn] == [10, 25, 13]


def test_a_gap_is_cut_at_its_arrivals_midnight(spark):
    a, b = ms(2024, 6, 1, 21), ms(2024, 6, 1, 22, 30)
    cut = ms(2024, 6, 1, 22)
    assert slices(spark, [(1, "GAP", 1, a, b, 10, 20)]) == [(1, a, cut, True, False, "Europe/Lisbon", None, "2024-06-01"), (1, cut, b, False, True, None, "Europe/Madrid", "2024-06-02")]
    # the other way it is one day in Lisbon still
    assert slices(spark, [(1, "GAP", 1, a, b, 20, 10)]) == [(1, a, b, True, True, "Europe/Madrid", "Europe/Lisbon", "2024-06-01")]


def test_places_without_a_clock_have_the_devices(spark):
    a = ms(2024, 6, 1, 12)
    rows = [(1, "STAY", 1, a, a + 1, 30, 30), (1, "STAY", 2, a, a + 1, None, None), (1, "GAP", 3, a, a + 1, 99, 20), (1, "STAY", 4, a, None, 10, 10)]
    got = slices(spark, rows, a + 5)
    assert [(s[0], s[2], s[5], s[6]) for s in got] == [(1, a + 1, "UTC", "UTC"), (2, a + 1, "UTC", "UTC"), (3, a + 1, "UTC", "Europe/Madrid"), (4, None, "Europe/Lisbon", "Europe/Lisbon")]
    assert slices(spark, []) == []


# --- columns


def test_columns_hold_every_fix(spark):
    rng = np.random.default_rng(3)
    rows = [f for t in range(8) for f in fixes(rng, t, int(rng.integers(1, 60)))]
    # a track of ignored fixes only, and fixes at one instant
    rows += [(1, 90, i, 0, 38.0, -9.0, "WALKING", 1.0, None, None, True, "jump", True, "x") for i in range(3)]
    rows += [(1, 91, i, 0, 38.0 + i, -9.0, None, None, 5.0, None, False, None, False, "x") for i in range(3)]
    c = kept(columnar.packed(spark.createDataFrame(rows, FIX).repartition(5)), "columns")
    got = {(r["track_id"], r["seq"]): r for r in columnar.unpacked(c).collect()}
    assert len(got) == len(rows)
    carried = {}
    for d, t, i, at, lat, lon, _, speed, alt, _, ignored, reason, start, _ in rows:
        g = got[t, i]
        carried[t] = carried.get(t, False) or start
        assert (g["ts_ms"], g["lat"], g["lon"], g["speed"], g["alt"], g["ignored"]) == (at, lat, lon, speed, alt, ignored)
        assert g["ignore_reason"] == (None if not ignored else reason if reason in columnar.REASONS else "accuracy")
        assert g["break"] == (carried[t] and not ignored)
        if not ignored:
            carried[t] = False
    by_track = {r["track_id"]: r for r in c.collect()}
    assert by_track[90]["bbox"] is None and by_track[90]["lines"] == [[], []]
    assert tuple(by_track[91]["bbox"]) == (38.0, -9.0, 40.0, -9.0)


def test_lines_are_those_of_each_stretch(spark):
    rng = np.random.default_rng(4)
    rows = [f for t in range(6) for f in fixes(rng, t, 120)]
    got = {r["track_id"]: r["lines"] for r in columnar.packed(spark.createDataFrame(rows, FIX)).collect()}
    for t in range(6):
        want, carried = [[]], False
        for _, _, i, _, lat, lon, _, _, _, _, ignored, _, start, _ in [r for r in rows if r[1] == t]:
            carried |= start
            if ignored:
                continue
            if carried and want[-1]:
                want.append([])
            carried = False
            want[-1].append((i, lat, lon))
        for level, tolerance in enumerate(columnar.LEVELS):
            lines = []
            for stretch in want:
                if len(stretch) > 1:
                    n, lat, lon = map(np.array, zip(*stretch))
                    lines.append(n[dwells.line_rows(lat, lon, tolerance)].tolist())
            assert got[t][level] == lines
        assert sum(map(len, got[t][1])) < sum(map(len, got[t][0]))


def test_no_points_no_columns(spark):
    c = columnar.packed(spark.createDataFrame([], FIX))
    assert c.count() == 0 and columnar.unpacked(c).count() == 0


# --- atlases

CITIES = [(38.7223, -9.1393, 517, "PT", "Europe/Lisbon", "Lisboa"), (-33.45694, -70.64827, 70_000, "CL", "America/Santiago", "Santiago"), (38.7223, -9.1393, 0, "PT", "Europe/Lisbon", "Água"), (0.0, 179.999999, None, "FJ", None, "東" * 85), (1.0, 2.0, 3, "X", "UTC", "no country"), (None, 2.0, 3, "PT", "UTC", "no place"), (1.0, 2.0, 3, None, "UTC", "none")]


def as_rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("files", [1, 3])
def test_an_atlas_packs_and_parses(spark, files):
    made = packed_atlas.packed(spark.createDataFrame(CITIES, ATLAS), files)
    folder = Path(tempfile.mkdtemp(prefix="spark-"))
    for k, r in enumerate(made.collect()):
        (folder / f"{k}.bin").write_bytes(r["content"])
        one = packed_atlas.decode(bytes(r["content"])).column(0).to_pylist()
        assert one == sorted(one)
    got = as_rows(packed_atlas.parsed(spark.read.format("binaryFile").load(str(folder))).fillna("", ["zone"]))
    want = sorted((lat, lon, min(p or 0, 65_535), c, z or "", n) for lat, lon, p, c, z, n in CITIES[:4])
    assert [g[2:] for g in got] == [w[2:] for w in want]
    assert all(math.isclose(a, b, abs_tol=1e-9) for g, w in zip(got, want) for a, b in zip(g[:2], w[:2]))


def test_what_is_no_atlas_is_refused(spark):
    good = bytes(packed_atlas.packed(spark.createDataFrame(CITIES, ATLAS)).first()["content"])
    assert packed_atlas.decode(good).num_rows == 4
    for bad in (b"", b"WATL2" + good[5:], good[:5], good[:-1], good[:20], good[:5] + b"\xff\xff\xff\xff" + good[9:], good[:9] + b"\x00\x00" + good[11:]):
        with pytest.raises(ValueError):
            packed_atlas.decode(bad)
    with pytest.raises(PythonException, match="not a packed atlas"):
        packed_atlas.parsed(spark.createDataFrame([(b"PNG..",)], "content binary")).collect()
    with pytest.raises(PythonException, match="1 to 255 bytes"):
        packed_atlas.packed(spark.createDataFrame([(1.0, 2.0, 3, "PT", "UTC", "x" * 256)], ATLAS)).collect()
    marked = packed_atlas.packed(spark.createDataFrame(CITIES, ATLAS), magic=b"OTHER")
    assert packed_atlas.parsed(marked, magic=b"OTHER").count() == 4


def test_an_empty_atlas_has_no_file(spark):
    made = packed_atlas.packed(spark.createDataFrame([], ATLAS), 2)
    assert made.count() == 0 and packed_atlas.parsed(made).count() == 0


# --- places


def test_ends_of_trips_add_places_once(spark):
    pins = spark.createDataFrame([(1, 0, 38.0, -9.0, 150.0), (2, 0, 39.0, -9.0, 150.0)], "device_id long, seed_index long, lat double, lon double, radius_m double")
    near = 38.5005
    rows = [
        (1, 1, 38.0, -9.0, " Home ", 38.5, -9.0, " New "),  # the first is held by a pin
        (1, 2, 38.5, -9.0, "A", near, -9.0, "B"),  # the second by the first
        (1, 3, 38.5, -9.0, "  ", near, -9.0, "B"),  # but not by one without a name
        (1, 4, 38.5, -9.0, "A", 38.6, -9.0, "B"),
        (1, 5, None, None, "A", 38.6, -9.0, None),
        (1, 6, 38.0, -9.0, "in a pin", 38.0005, -9.0, "too"),
        (1, 7, 39.0, -9.0, "another device's pin", 38.0, -9.0, "x"),
    ]
    d = spark.createDataFrame(rows, "device_id long, trip long, from_lat double, from_lon double, from_label string, to_lat double, to_lon double, to_label string")
    got = {(r["trip"], r["side"]): r["label"] for r in places.end_places(d, pins, ["device_id", "trip"]).collect()}
    assert got == {(1, "to"): "New", (2, "from"): "A", (3, "to"): "B", (4, "from"): "A", (4, "to"): "B", (7, "from"): "another device's pin"}


def test_captured_counts(spark):
    pins = spark.createDataFrame([(1, 0, 38.0, -9.0, 150.0), (1, 1, 38.001, -9.0, 150.0), (1, 2, 40.0, -9.0, 150.0)], "device_id long, seed_index long, lat double, lon double, radius_m double")
    at = spark.createDataFrame([(1, 38.0, -9.0), (1, 38.0005, -9.0), (1, None, None), (2, 40.0, -9.0)], "device_id long, lat double, lon double")
    assert {r["seed_index"]: r["captured"] for r in places.captured(at, pins).collect()} == {0: 2, 1: 2, 2: 0}
