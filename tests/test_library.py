"""Edits, lists and live rules by decision tables and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.functions import arrays
from waymark.operators import cities, dwells, library, motion, shown
from waymark.schemas import ACTIVITIES, ceiling_kmh, group_of
from waymark.streaming.live import Recorder, group

#: Activities, their groups, and the fastest steps in km/h.
GROUPS = {"WALKING": "FOOT", "RUNNING": "FOOT", "CYCLING": "BIKE", "DRIVING": "VEHICLE", "TAXI": "VEHICLE", "TRANSIT": "VEHICLE", "FERRY": "VEHICLE", "FLIGHT": "AIR", "STILL": "STILL", "UNKNOWN": "UNKNOWN"}


def test_groups_of_all_activities(spark):
    df = spark.createDataFrame([(k,) for k in [*GROUPS, "OLD_CODE"]], "activity string")
    got = {r["activity"]: r["g"] for r in df.select("activity", group_of(F.col("activity")).alias("g")).collect()}
    assert got == GROUPS | {"OLD_CODE": "UNKNOWN"} and set(ACTIVITIES) == set(GROUPS)
    assert {k: group(k) for k in GROUPS} == GROUPS
    assert max(c for g, c in ACTIVITIES.values() if g == group("FERRY")) == 350
    assert df.where("activity = 'FERRY'").select(ceiling_kmh(F.col("activity"))).first()[0] == 120


def test_a_drive_that_becomes_a_ferry_goes_on():
    from waymark.config import Live

    r, rule = Recorder(), Live()
    for what, at in (("DRIVING", 0), ("FERRY", 60_000)):
        events = r.reading(what, None, at, 180_000, rule)
    assert [e["event"] for e in events] == ["CONTINUE"] and r.track_no == 1


def test_ferries_have_a_vehicle_s_floor(spark):
    rows = [(1, 1, k, k * 1000, 0.0, 0.0, None, False, "FERRY") for k in range(3)]
    df = spark.createDataFrame(rows, "device_id long, track_id long, seq int, ts_ms long, lat double, lon double, speed double, ignored boolean, activity string")
    assert dwells.recordings(df).first()["floor_mps"] == pytest.approx(5 / 3.6)


@pytest.mark.parametrize("code", ["PPL", "PPLA", "PPLA5", "PPLC", "PPLF", "PPLG", "PPLL", "PPLR", "PPLS", "STLMT"])
def test_settlements(code):
    assert code in cities.SETTLEMENTS


@pytest.mark.parametrize("code", ["PPLX", "PPLH", "PPLQ", "PPLW", "PPLCH"])
def test_no_settlements(code):
    assert code not in cities.SETTLEMENTS


def test_rows_of_a_gazetteer(spark):
    row = lambda code, country: ("1", "Name", "x", "x", "1.5", "2.5", "P", code, country, *["x"] * 5, "1499", "x", "x", "Europe/Lisbon", "x")
    raw = spark.createDataFrame([row("PPLR", "PT"), row("PPLX", "PT"), row("PPL", "")], ", ".join(f"c{k} string" for k in range(19)))
    assert [tuple(r) for r in cities.atlas_of(raw).collect()] == [(1.5, 2.5, 1, "PT", "Europe/Lisbon", "Name")]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_fold_rows_is_a_fold(spark, n):
    """Rows of a running sum that starts again above 50."""
    rng = random.Random(n)
    values = [rng.randint(0, 20) for _ in range(n)]
    df = spark.createDataFrame([(values,)], "v array<int>")

    def step(acc, x):
        total = acc["sum"] + x
        return F.struct(F.when(total > 50, 0).otherwise(total).alias("sum")), F.when(total > 50, total)

    got = df.select(arrays.fold_rows("v", F.struct(F.lit(0).alias("sum")), step, "int").alias("out")).first()["out"]
    want, total = [], 0
    for x in values:
        total += x
        if total > 50:
            want.append(total)
            total = 0
    assert got == want


def test_retyped_walk_gets_its_jumps_back(spark):
    kmh = [0, 5, 100, 5, 5]
    at, rows = 0.0, []
    for k, v in enumerate(kmh):
        at += v / 3.6 * 60 / 111_195
        rows.append((1, 1, k, k * 60_000, at, 0.0, None, k in (2, 3), {2: "jump", 3: "accuracy"}.get(k), "WALKING"))
    fixes = spark.createDataFrame(rows, "device_id long, track_id long, seq int, ts_ms long, lat double, lon double, speed double, ignored boolean, ignore_reason string, activity string")
    trips = spark.createDataFrame([(1, 1, "WALKING")], "device_id long, track_id long, activity string")
    for activity, ignored in (("DRIVING", {3}), ("RUNNING", {2, 3}), ("FERRY", {3})):
        change = spark.createDataFrame([(1, 1, activity)], "device_id long, track_id long, activity string")
        t, f = library.retyped(trips, fixes, change)
        assert t.first()["activity"] == activity
        assert {r["seq"] for r in f.where("ignored").collect()} == ignored, activity
    _, f = library.retyped(trips, fixes, change.limit(0))
    assert {r["seq"] for r in f.where("ignored").collect()} == {2, 3}


def test_discard_restore_delete(spark):
    t = spark.createDataFrame([(1, 1, 0, 9, None, None), (1, 2, 5, None, None, None), (1, 3, 7, 8, 3, "old")], "device_id long, track_id long, started_at long, ended_at long, discarded_at long, discard_reason string")
    chosen = spark.createDataFrame([(1, 2, 20, "hand")], "device_id long, track_id long, at long, reason string")
    d = library.discarded(t, chosen)
    assert sorted(tuple(r)[1:] for r in d.collect()) == [(1, 0, 9, None, None), (2, 5, 20, 20, "hand"), (3, 7, 8, 3, "old")]
    back = library.restored(d, chosen)
    assert [r["discard_reason"] for r in back.orderBy("track_id").collect()] == [None, None, "old"]
    assert {r["track_id"] for r in library.without(t, chosen).collect()} == {1, 3}
    assert {r["track_id"]: r["state"] for r in library.listed(t).collect()} == {1: "kept", 2: "open", 3: "discarded"}


def test_zone_shift(spark):
    rows = [("2024-01-15T12:00:00Z", "Europe/Lisbon", "Europe/Paris", -60), ("2024-07-15T12:00:00Z", "Asia/Kolkata", "UTC", 330), ("2024-03-31T00:30:00Z", "Europe/Lisbon", "America/New_York", 240)]
    df = spark.createDataFrame([(*r,) for r in rows], "at string, zone string, other string, want int").withColumn("ms", F.unix_millis(F.to_timestamp("at")))
    assert all(r["got"] == r["want"] for r in df.withColumn("got", shown.zone_shift_minutes(F.col("ms"), F.col("zone"), F.col("other"))).collect())


def test_card_states(spark):
    table = {
        # armed, tracking, recording, paused, suspended, points, has_track, set_up
        (False, True, True, False, False, 9, True, True): "STATS_ONLY",
        (True, True, True, False, True, 2, True, False): "LIVE_MAP",
        (True, True, True, False, True, 1, True, True): "NO_GPS_SIGNAL",
        (True, True, True, False, False, 2, False, True): "WAITING_FOR_GPS",
        (True, True, False, True, False, 2, True, True): "PAUSED",
        (True, True, False, False, False, 2, True, True): "WAITING_FOR_MOVEMENT",
        (True, False, False, True, False, 0, False, True): "STARTING",
        (True, False, False, True, False, 0, False, False): "SETUP",
        (False, False, False, False, False, 0, False, False): "SETUP",
    }
    names = ["armed", "tracking", "recording", "paused", "suspended", "points", "has_track", "set_up"]
    df = spark.createDataFrame([(*k, v) for k, v in table.items()], ", ".join(f"{n} {'int' if n == 'points' else 'boolean'}" for n in names) + ", want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", motion.card_state(*[F.col(n) for n in names])).collect())


def test_deaf_readings(spark):
    rows = [(1, 500, 400, 100, 400_000, True), (None, 500, 400, 100, 400_000, False), (1, 400, 400, 100, 400_000, False), (1, 500, 400, 500, 400_000, False), (1, 500, 400, 100, 300_500, False)]
    df = spark.createDataFrame(rows, "event long, reading long, last long, armed long, now long, want boolean")
    got = df.withColumn("got", motion.proves_deaf(F.col("event"), F.col("reading"), F.col("last"), F.col("armed"), F.col("now")))
    assert all(r["got"] == r["want"] for r in got.collect())
