"""Decision tables on a flat earth, local calendars, and order-dependent rules against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waymark.functions import geo, text
from waymark.operators import cities, intervals, places, points, suggest, tracks

ENDS = "device_id long, track_id long, started_at long, ended_at long, start_lat double, start_lon double, end_lat double, end_lon double, start_pin long, end_pin long"
MIN = 60_000


def east(metres):
    return 1.0 + metres / 100_000


def verdict(spark, gap_ms, metres, pins=(None, None), known=(True, True)):
    a = (1, 1, 0, 10 * MIN, 1.0, 1.0, 1.0 if known[0] else None, east(0) if known[0] else None, None, pins[0])
    b = (1, 2, 10 * MIN + gap_ms, 99 * MIN, 1.0 if known[1] else None, east(metres) if known[1] else None, 1.0, 1.0, pins[1], None)
    pairs = intervals.between_tracks(spark.createDataFrame([a, b], ENDS))
    row = intervals.verdicts(pairs, distance=geo.flat_m).first()
    return row["kind"], row["reason"]


@pytest.mark.parametrize(
    "args,want",
    [
        ((MIN, 99.9), ("STAY", None)),
        ((MIN, 100.1), ("GAP", "MOVED_UNRECORDED")),
        ((0, 10), ("STAY", None)),
        ((0, 500), ("NONE", None)),
        ((-1, 0), ("NONE", None)),
        ((MIN, 500, (3, 3)), ("STAY", None)),
        ((MIN, 500, (3, 4)), ("GAP", "MOVED_UNRECORDED")),
        ((MIN, 0, (None, None), (False, True)), ("GAP", "UNKNOWN_ENDPOINT")),
        ((MIN, 0, (3, 3), (True, False)), ("GAP", "UNKNOWN_ENDPOINT")),
        ((0, 0, (None, None), (True, False)), ("NONE", None)),
    ],
)
def test_verdicts(spark, args, want):
    assert verdict(spark, *args) == want


def ms(stamp):
    return int(pd.Timestamp(stamp).timestamp() * 1000)


def test_slices_on_a_short_day(spark):
    stay = [(1, 1, ms("2024-03-30T22:00Z"), ms("2024-04-01T05:00Z"), "Europe/Lisbon")]
    s = spark.createDataFrame(stay, "device_id long, after_track_id long, start long, end long, zone string")
    rows = intervals.per_day(s, F.lit(ms("2024-05-01")), "zone").orderBy("slice_start").collect()
    hours = [(r["slice_end"] - r["slice_start"]) / 3_600_000 for r in rows]
    assert hours == [2, 23, 6]  # the clock goes forward on the 31st
    assert [(r["holds_start"], r["holds_end"]) for r in rows] == [(True, False), (False, False), (False, True)]


def test_open_and_edge_slices(spark):
    rows = [(1, 1, ms("2024-01-01T10:00Z"), None), (1, 2, ms("2024-01-01T00:00Z"), ms("2024-01-02T00:00Z")), (1, 3, ms("2024-01-01T12:00Z"), ms("2024-01-01T12:00Z"))]
    s = spark.createDataFrame(rows, "device_id long, after_track_id long, start long, end long")
    got = intervals.per_day(s, F.lit(ms("2024-01-02T08:00Z"))).collect()
    assert [r["slice_end"] for r in sorted(got, key=lambda r: r["slice_start"]) if r["after_track_id"] == 1] == [ms("2024-01-02"), None]
    assert [sum(r["after_track_id"] == k for r in got) for k in (2, 3)] == [1, 1]


def test_goldens_of_distance():
    lat = np.array([0.0, 0.0, 60.0, 5.0])
    got = geo.ellipsoid_m(lat, np.zeros(4), lat + np.array([0.001, 0, 0, 0]), np.array([0.0, 0.001, 0.001, 0.0]))
    assert got == pytest.approx([110.574, 111.319, 55.8, 0], abs=0.02) and got.dtype == np.float32


def test_verdict_order(spark):
    rows = [(1, 1, 5.0, 0.0, 0.0, "PURGE"), (0, 3, 900.0, 0.0, 0.0, "DISCARD"), (5, 0, 29.0, 900.0, 900.0, "DISCARD"), (5, 0, 30.0, 49.0, 900.0, "DISCARD"), (5, 0, 30.0, 50.0, 49.0, "DISCARD"), (5, 0, 30.0, 50.0, 50.0, "KEEP")]
    df = spark.createDataFrame(rows, "good_count long, ignored_count long, seconds double, distance_m double, extent_m double, want string")
    assert all(r["v"] == r["want"] for r in df.withColumn("v", tracks.verdict(df)).collect())


@pytest.mark.parametrize("seed,lat", [(0, 0.0), (1, 38.0), (2, -70.0)])
def test_clusters_against_brute_force(spark, seed, lat):
    rng = random.Random(seed)
    pins = [(1, k, lat + rng.uniform(-0.004, 0.004), rng.uniform(-0.004, 0.004), rng.choice([100.0, 150.0, 300.0])) for k in range(3)]
    ends = [(1, t, t * 1000 + rng.randint(0, 900), s, lat + rng.uniform(-0.01, 0.01), rng.uniform(-0.01, 0.01)) for t in range(150) for s in (True, False)]
    order = sorted(ends, key=lambda e: (e[2], e[1], not e[3]))
    anchors, want = [(p[2], p[3], p[4]) for p in pins], {}
    for e in order:
        d = [float(geo.ellipsoid_m(e[4], e[5], a[0], a[1])) for a in anchors]
        fits = [k for k in range(len(d)) if d[k] <= anchors[k][2]]
        if not fits:
            anchors.append((e[4], e[5], 150.0))
        want[e[1], e[3]] = min(fits, key=lambda k: (d[k], k)) if fits else len(anchors) - 1
    got = places.greedy_clusters(spark.createDataFrame(ends, "device_id long, track_id long, started_at long, is_start boolean, lat double, lon double"), spark.createDataFrame(pins, "device_id long, seed_index long, lat double, lon double, radius_m double"))
    assert {(r["track_id"], r["is_start"]): r["cluster"] for r in got.collect()} == want


ATLAS = [(48.857, 2.352, 2100, "FR", "Europe/Paris", "Paris"), (48.873, 2.36, 90, "FR", "Europe/Paris", "Quartier"), (48.80, 2.30, 0, "FR", "Europe/Paris", "Hameau"), (43.77, 7.5, 30, "FR", "Europe/Paris", "Menton"), (43.79, 7.6, 25, "IT", "Europe/Rome", "Ventimiglia"), (43.80, 7.62, 1, "IT", "Europe/Rome", "A"), (43.81, 7.63, 1, "IT", "Europe/Rome", "B"), (-17.7, 179.99, 5, "FJ", "Pacific/Fiji", "East"), (0.0, 0.0, 1, "XX", "UTC", "Null")]


@pytest.mark.parametrize("at,want", [((48.872, 2.361), "Paris"), ((48.80, 2.301), "Hameau"), ((43.775, 7.53), "Ventimiglia"), ((-17.7, -179.99), "East"), ((48.857, 2.352), "Paris"), ((5.0, 10.0), "Null")])
def test_city_table(at, want):
    book = cities.Atlas(pd.DataFrame(ATLAS, columns=["lat", "lon", "population_k", "country", "zone", "name"]))
    assert book.rows["name"][book.name(*at)[0]] == want


@pytest.mark.parametrize("distance", [geo.sphere_m, geo.ellipsoid_m])
@pytest.mark.parametrize("at", [(180 - 48.872, 2.361 + 180), (360 + 48.872, 2.361 - 360), (-180 - 48.872, 2.361 + 180)])
def test_city_beyond_a_pole(distance, at):
    book = cities.Atlas(pd.DataFrame(ATLAS, columns=["lat", "lon", "population_k", "country", "zone", "name"]), distance)
    row, metres = book.name(*at)
    assert book.rows["name"][row] == "Paris" and metres == pytest.approx(book.name(48.872, 2.361)[1], abs=0.01)


def test_city_far_beyond_a_pole():
    # the nearest city lies much further off in latitude than in metres
    book = cities.Atlas(pd.DataFrame([(38.0, -9.0, 5, "XA", "UTC", "A")], columns=["lat", "lon", "population_k", "country", "zone", "name"]), geo.sphere_m)
    assert book.name(120.0, 171.0)[1] == pytest.approx(float(geo.sphere_m(60.0, -9.0, 38.0, -9.0)), abs=0.01)


def test_short_arcs_bend_where_asked(spark):
    ends = spark.createDataFrame([(89.99, 0.0, 89.99, 40.0), (90.0, 0.0, 90.0, 0.0)], "a double, b double, c double, d double")
    size = lambda **k: [r["n"] for r in ends.select(F.size(geo.arc(F.col("a"), F.col("b"), F.col("c"), F.col("d"), **k)).alias("n")).collect()]
    assert size() == [2, 2] and size(straight=0.0) == [3, 2]


def test_an_arc_works_out_each_value_once(spark):
    df = spark.range(1).select(geo.arc(F.col("id") * 1.0, F.lit(2.0), F.col("id") * 3.0, F.lit(40.0)).alias("path"))
    plan = df._jdf.queryExecution().analyzed().toString().lower()
    assert [plan.count(f"{f}(") for f in ("acos", "atan2", "sqrt", "ceil")] == [1, 2, 1, 1], plan


def test_city_of_nothing(spark):
    atlas = spark.createDataFrame([], cities.ATLAS)
    p = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 2.0)], "id long, lat double, lon double")
    assert [r["city"] for r in cities.named(p, atlas).collect()] == [None, None]
    assert cities.Atlas(pd.DataFrame([], columns=["lat", "lon", "population_k", "country", "zone", "name"])).name(0.0, 0.0) is None


def test_names(spark):
    df = spark.createDataFrame([(" Café ÉTÉ ", "cafe"), ("x", " "), ("Straße", "STRASSE"), (None, "a")], "name string, needle string")
    got = df.select(text.holds(F.col("name"), F.col("needle")).alias("h")).collect()
    assert [r["h"] for r in got] == [True, False, False, None]


def test_suggestions_need_known_names(spark):
    known = spark.createDataFrame([("Lidl", "groceries"), ("Lidl Norte", "groceries"), ("Mercado Sul", "groceries"), ("Parque Norte", "outdoors"), ("Parque da Paz", "outdoors"), (None, "food"), ("x", None)], "label string, category string")
    asked = spark.createDataFrame([("lidl sul",), ("PARQUE",), ("zzzzqq",), ("",)], "name string")
    got = {(r["name"], r["rank"]): r["category"] for r in suggest.suggestions(asked, known).collect()}
    assert got[("lidl sul", 1)] == "groceries" and got[("PARQUE", 1)] == "outdoors"
    assert not any(n in ("zzzzqq", "") for n, _ in got)


def test_empty_history(spark):
    e = spark.createDataFrame([], ENDS)
    assert intervals.verdicts(intervals.between_tracks(e)).count() == 0
    p = spark.createDataFrame([], "device_id long, track_id long, seq int, ts_ms long, lat double, lon double, ignored boolean, segment_start boolean, speed double")
    assert tracks.stats(p).count() == points.carried_breaks(p).count() == points.leading_stray(p).count() == 0
