"""The gate that readings pass, what is known of their source, and the numbered log of effects."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from waymark.config import Live, Quality
from waymark.streaming import live
from waymark.streaming.live import Recorder

MIN = 60_000
RESUME = 180_000
M = 1 / 111_195
HELD = Live(hold_s=90.0)
FAST, SLOW = ("MOVING", 20.0), ("MOVING", 2.0)
UNKNOWN, STOPPED = ("UNKNOWN", 0.0), ("STOPPED", 0.0)


class Ground(Recorder):
    """A recorder whose ground is told."""

    seen = UNKNOWN

    def motion(self, now, rule):
        return self.seen


def started(activity, rule=HELD):
    r = Ground()
    r.reading(activity, None, 0, RESUME, rule)
    assert r.confirmed == activity and r.phase == "RECORDING"
    return r


def read(r, raw, ground, at=MIN, rule=HELD):
    r.seen = ground
    return [e["event"] for e in r.reading(raw, None, at, RESUME, rule) if e["event"] not in live.QUIET]


# what is trusted, what is read, what the ground does, the rule: is it parked, and why
TABLE = [
    ("DRIVING", "STILL", FAST, HELD, "CONTRADICTED"),
    ("DRIVING", "STILL", SLOW, HELD, "CONTRADICTED"),
    ("DRIVING", "STILL", UNKNOWN, HELD, "UNCORROBORATED"),
    ("DRIVING", "STILL", UNKNOWN, Live(), None),
    ("DRIVING", "STILL", STOPPED, HELD, None),
    ("DRIVING", "WALKING", FAST, HELD, "CONTRADICTED"),
    ("DRIVING", "WALKING", SLOW, HELD, None),
    ("DRIVING", "WALKING", UNKNOWN, HELD, None),
    ("WALKING", "DRIVING", FAST, HELD, None),
    ("WALKING", "CYCLING", UNKNOWN, HELD, None),
    ("DRIVING", "DRIVING", FAST, HELD, None),
]


@pytest.mark.parametrize("trusted,raw,ground,rule,kind", TABLE)
def test_what_is_parked(trusted, raw, ground, rule, kind):
    r = started(trusted, rule)
    got = read(r, raw, ground, rule=rule)
    assert r.held_kind == kind and r.confirmed == (trusted if kind else raw)
    assert ("HELD" in got) == bool(kind)


def fix(r, at, ground, rule=HELD):
    r.seen = ground
    x = {"at_ms": at, "seq": at, "lat": 38.0, "lon": -9.0, "accuracy": 5.0, "gnss_ok": True}
    return [(e["event"], e["at_ms"]) for e in r.fix(x, RESUME, rule, Quality()) if e["event"] != "POINT"]


def test_a_contradicted_stop_lands_when_the_ground_agrees_or_says_nothing():
    for ground in (STOPPED, UNKNOWN):
        r = started("DRIVING")
        read(r, "STILL", FAST)
        assert fix(r, 2 * MIN, FAST) == [] and r.held == "STILL"
        # no wait ends it
        assert r.tick(50 * MIN, RESUME) == []
        assert fix(r, 51 * MIN, ground) == [("PAUSE", 51 * MIN)]


def test_an_unborne_stop_lands_at_its_own_time():
    r = started("DRIVING")
    read(r, "STILL", UNKNOWN)
    assert fix(r, MIN + 30_000, UNKNOWN) == [] and fix(r, MIN + 40_000, SLOW) == []
    assert fix(r, MIN + 50_000, STOPPED) == [("PAUSE", MIN)]
    r = started("DRIVING")
    read(r, "STILL", UNKNOWN)
    assert r.tick(MIN + 89_999, RESUME) == []
    assert [(e["event"], e["at_ms"]) for e in r.tick(MIN + 90_000, RESUME)] == [("PAUSE", MIN)]
    assert r.deadline == MIN + RESUME and r.held is None


def test_one_slot():
    r = started("DRIVING")
    read(r, "STILL", FAST)
    assert read(r, "CYCLING", FAST) == ["FINISH", "START"] and r.held is None
    r = started("DRIVING")
    read(r, "STILL", FAST)
    assert read(r, "DRIVING", FAST) == [] and r.held is None
    r = started("DRIVING")
    read(r, "STILL", FAST)
    r.arm(2 * MIN)
    assert r.held is None and r.confirmed == "STILL"
    assert read(r, "STILL", FAST) == []


def test_a_departure_is_adopted():
    rule = Live(departures_open=True)
    at = lambda t, m: {"at_ms": t, "seq": 0, "lat": 38 + m * M, "lon": -9.0, "accuracy": 5.0}
    r = Recorder()
    r.position(at(0, 0), rule, RESUME)
    assert [e["event"] for e in r.position(at(MIN, 400), rule, RESUME)] == ["DEPARTED", "START"]
    assert r.confirmed == "UNKNOWN" and r.activity == "UNKNOWN"
    # the stop that ends it is a change
    assert [e["event"] for e in r.reading("STILL", None, 2 * MIN, RESUME, rule)] == ["PAUSE"]


def hears(r, event, now):
    return [e["event"] for e in r.reading("STILL", event, now, RESUME, Live())]


def test_two_proofs_of_deafness_warn_and_a_live_reading_clears():
    r = Recorder()
    assert hears(r, 0, 10) == []  # not armed: nothing is judged
    r.arm(MIN)
    assert hears(r, 2 * MIN, 2 * MIN + 5_000) == ["READ"]
    assert hears(r, 3 * MIN, 5 * MIN) == ["RESTART", "READ"]  # late, and it moves the clock on
    assert hears(r, 3 * MIN + 500, 6 * MIN) == ["READ"]  # late, but a repeat
    assert hears(r, 5 * MIN, 7 * MIN) == ["DEAF", "READ"]  # the restart didn't take; no restart so soon
    assert hears(r, 7 * MIN, 9 * MIN) == ["READ"] and r.warned  # warned once
    assert hears(r, 12 * MIN, 14 * MIN) == ["RESTART", "READ"]
    assert hears(r, 14 * MIN + 30_000, 14 * MIN + 31_000) == ["READ"]  # prompt, but it may answer the restart
    assert hears(r, 16 * MIN, 16 * MIN + 1_000) == ["HEARS", "READ"] and not r.warned
    assert hears(r, 17 * MIN, 19 * MIN) == ["READ"]  # one proof is one again, and the last restart is 5 min ago, no more
    assert hears(r, None, 30 * MIN) == ["READ"]  # without a time of its own it proves nothing
    r.arm(31 * MIN)
    assert hears(r, 30 * MIN + 30_000, 33 * MIN) == ["READ"]  # older than the session


def rows(device, shift):
    x = lambda kind, t, activity=None, event=None, m=0: (device, kind, None, t + shift, 0, 38 + m * M, -9.0, 5.0, True, activity, event)
    return [
        [x("armed", 0), x("position", 1_000), x("activity", 10_000, "WALKING", 9_000), *[x("fix", 10_000 + k * 5_000, m=k * 6) for k in range(1, 20)]],
        [x("activity", 120_000, "STILL", 119_000), x("activity", 200_000, "WALKING", 199_000), *[x("fix", 200_000 + k * 5_000, m=120 + k * 6) for k in range(1, 9)]],
        [x("activity", 260_000, "DRIVING", 259_000), x("activity", 300_000, "STILL", 299_000)],
        [x("position", 9_000_000), x("position", 9_100_000, m=900)],
        [x("position", 20_000_000, m=900)],
    ]


def test_the_log_is_the_same_after_a_restart(spark):
    """A batch whose commit was lost runs again; and every batch may be the last before a restart."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    parts = [a + b for a, b in zip(rows(1, 0), rows(2, 500))]
    frames = [spark.createDataFrame(p, live.INPUT).withColumn("at", F.timestamp_millis("at_ms")) for p in parts]

    def run(folder, files):
        for k in files:
            frames[k].coalesce(1).write.parquet(f"{folder}/in/{k}")
        stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        live.effect_log(stream, f"{folder}/log", f"{folder}/check", "1 second", rule=Live(hold_s=30.0)).awaitTermination(200)

    def log(folder):
        return sorted((r.device_id, r.n, r.effect, r.at_ms, r.track_no, r.activity, r.value) for r in spark.read.parquet(f"{folder}/log").collect())

    once, often = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    run(once, range(len(frames)))
    for k in range(len(frames)):
        run(often, [k])
        if k in (1, 3):  # as if the driver had been lost after the batch was written and before it was committed
            commits = sorted((int(f) for f in os.listdir(f"{often}/check/commits") if f.isdigit()))
            for name in (f"{commits[-1]}", f".{commits[-1]}.crc"):
                os.path.exists(f"{often}/check/commits/{name}") and os.remove(f"{often}/check/commits/{name}")
    assert log(often) == log(once)
    for device in (1, 2):
        mine = [r for r in log(once) if r[0] == device]
        assert [r[1] for r in mine] == list(range(1, len(mine) + 1))
        assert [r[2] for r in mine if r[2] != "STAMP_READING"] == ["ARM_FENCE", "GPS_ON", "OPEN_TRACK", "GPS_OFF", "WAKE_AT", "GPS_ON", "GPS_OFF", "CLOSE_TRACK", "GPS_ON", "OPEN_TRACK", "GPS_OFF", "WAKE_AT", "GPS_OFF", "CLOSE_TRACK", "ARM_FENCE", "DISARM_FENCE", "ARM_FENCE"]
