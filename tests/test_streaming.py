"""The live recorder's rules, a replay through Structured Streaming, and tables that follow their tracks."""

import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.config import Live, Quality
from waymark.operators import intervals, points
from waymark.plans.history import History
from waymark.streaming import live, upkeep
from waymark.streaming.live import Recorder

SF = "/root/testdata/sf0.001"
M = 1 / 111_195
MIN = 60_000
RESUME = 180_000


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def fix(t, metres, accuracy=5.0, gnss=True):
    return {"at_ms": t, "seq": t, "lat": 38 + metres * M, "lon": -9.0, "accuracy": accuracy, "gnss_ok": gnss}


class Driven:
    def __init__(self):
        self.r, self.log = Recorder(), []

    def reading(self, activity, t, event=None):
        self.log += self.r.reading(activity, event, t, RESUME, Live())
        return self

    def fix(self, *a, **k):
        self.log += self.r.fix(fix(*a, **k), RESUME, Live(), Quality())
        return self

    @property
    def events(self):
        return [(e["event"], e["at_ms"]) for e in self.log if e["event"] != "POINT"]

    @property
    def reasons(self):
        return [e["reason"] for e in self.log if e["event"] == "POINT"]


def test_session_table():
    d = Driven().reading("WALKING", 0).reading("RUNNING", MIN).reading("STILL", 2 * MIN).reading("WALKING", 4 * MIN)
    assert d.events == [("START", 0), ("CONTINUE", MIN), ("PAUSE", 2 * MIN), ("RESUME", 4 * MIN)]
    d = Driven().reading("WALKING", 0).reading("STILL", MIN).reading("WALKING", MIN + RESUME)
    assert d.events == [("START", 0), ("PAUSE", MIN), ("FINISH", MIN + RESUME), ("START", MIN + RESUME)]
    d = Driven().reading("WALKING", 0).reading("STILL", MIN).reading("DRIVING", 2 * MIN)
    assert d.events == [("START", 0), ("PAUSE", MIN), ("FINISH", 2 * MIN), ("START", 2 * MIN)]
    d = Driven().reading("WALKING", 0).reading("DRIVING", MIN)
    assert d.events == [("START", 0), ("FINISH", MIN), ("START", MIN)] and d.r.track_no == 2
    assert Driven().reading("STILL", 0).events == []


def test_reading_clock():
    d = Driven().reading("WALKING", 10 * MIN, 8 * MIN).reading("RUNNING", 11 * MIN, 5 * MIN).reading("STILL", 12 * MIN, 99 * MIN)
    assert d.events == [("START", 8 * MIN), ("CONTINUE", 8 * MIN), ("PAUSE", 12 * MIN)]
    assert Driven().reading("WALKING", 500 * MIN, 10 * MIN).events == [("START", 500 * MIN)]


def test_fixes_are_judged_in_order():
    d = Driven().reading("WALKING", 0)
    d.fix(1000, 0).fix(6000, 10).fix(11_000, 500).fix(16_000, 20).fix(21_000, 30, accuracy=50.0).fix(26_000, 900, gnss=False).fix(26_000, 15, accuracy=None)
    assert d.reasons == [None, None, "jump", None, "accuracy", "no_gnss", None]
    assert Driven().fix(0, 0).log == []  # nothing is recorded without a session


def test_motion_and_contradiction():
    d = Driven().reading("DRIVING", 0)
    for k in range(8):
        d.fix(k * 5000, k * 60)
    assert d.log[-1]["motion"] == "MOVING"
    d.reading("STILL", 36_000)
    assert d.events[-1] == ("HELD", 36_000) and d.r.phase == "RECORDING"
    for k in range(8, 30):
        d.fix(k * 5000, 7 * 60)
    assert ("PAUSE" in [e for e, _ in d.events]) and d.r.phase == "PAUSED"


def test_arrival_is_backdated():
    d = Driven().reading("WALKING", 0)
    for k in range(80):
        d.fix(k * 5000, 0)
    names = [e for e, _ in d.events]
    assert "ARRIVED" in names and "FINISH" in names
    since = dict(d.events)["ARRIVED"]
    assert since <= 30_000


def test_carried_walk_is_renamed():
    d = Driven().reading("WALKING", 0)
    for k in range(60):
        d.fix(k * 5000, k * 100)  # 20 m/s
    d.reading("CYCLING", 310_000)
    assert [e["activity"] for e in d.log if e["event"] == "FINISH"] == ["UNKNOWN"]


def test_nothing_good_for_long():
    d = Driven().reading("DRIVING", 0)
    for k in range(250):
        d.fix(k * 10_000, 0, accuracy=100.0)
    # tried again after 120, 240 and 480 s, for 240 s each time; nothing is recorded between
    assert [(e, t // 1000) for e, t in d.events if e in ("GAVE_UP", "PROBED")] == [("GAVE_UP", 240), ("PROBED", 360), ("GAVE_UP", 600), ("PROBED", 840), ("GAVE_UP", 1080), ("PROBED", 1560), ("GAVE_UP", 1800), ("PROBED", 2280)]
    assert not [t for e, t in d.events if e == "POINT" and (240_000 < t < 360_000 or 1_080_000 < t < 1_560_000)]


def test_a_good_fix_ends_the_longer_waits():
    d = Driven().reading("DRIVING", 0)
    for k in range(100):
        d.fix(k * 10_000, 0, accuracy=5.0 if k == 40 else 100.0)
    assert [(e, t // 1000) for e, t in d.events if e in ("GAVE_UP", "PROBED")] == [("GAVE_UP", 240), ("PROBED", 360), ("GAVE_UP", 640), ("PROBED", 760)]


def test_departure():
    r = Recorder()
    at = lambda t, m, acc: [e["event"] for e in r.position(fix(t, m, acc))]
    assert at(0, 0, 80.0) == ["ANCHORED"]
    assert at(1, 20, 10.0) == ["ANCHORED"]  # a sharper place takes over
    assert at(2, 100, 10.0) == []  # 80 m: far for two in a row only
    assert at(3, 100, 10.0) == ["DEPARTED"]
    assert at(4, 100, 10.0) == ["ANCHORED"]
    assert at(5, 300, 10.0) == ["DEPARTED"]


def test_replay_equals_batch(spark):
    h = History(spark, SF)
    # devices whose tracks never touch: a start and a stop in one instant have no order
    apart = F.min(F.col("started_at") - F.col("was")).alias("apart")
    w = Window.partitionBy("device_id").orderBy("started_at", "track_id")
    free = h.tracks.withColumn("was", F.lag("ended_at").over(w)).groupBy("device_id").agg(apart).where("apart > 0").orderBy("device_id").limit(4)
    ids = [r["device_id"] for r in free.collect()]
    t, p = h.tracks.where(F.col("device_id").isin(ids)), h.points.where(F.col("device_id").isin(ids))
    null = lambda kind: F.lit(None).cast(kind)

    def readings(at, activity, n):
        return t.select("device_id", F.lit("activity").alias("kind"), F.timestamp_millis(at).alias("at"), F.col(at).alias("at_ms"), F.lit(n).cast("long").alias("seq"), null("double").alias("lat"), null("double").alias("lon"), null("double").alias("accuracy"), null("boolean").alias("gnss_ok"), activity.alias("activity"), null("long").alias("event_ms"))

    rows = live.as_input(p).unionByName(readings("started_at", F.col("activity"), -1)).unionByName(readings("ended_at", F.lit("STILL"), 99))
    source, out = tempfile.mkdtemp(prefix="spark-") + "/in", tempfile.mkdtemp(prefix="spark-")
    cuts = [0, 1_705_000_000_000, 1_706_000_000_000, 1 << 60]
    for a, b in zip(cuts, cuts[1:]):  # files are read in the order in which they were written
        rows.where(F.col("at_ms").between(a, b - 1)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    quiet = live.live(stream, late="40 days", resume_ms=0, rule=Live(moving_m=1e12, still_m=-1.0, give_up_s=0), quality=Quality())
    q = quiet.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/check").trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = spark.read.parquet(f"{out}/rows")
    assert got.where("event = 'START'").count() == t.count()
    live_rows = sorted((r["device_id"], r["at_ms"], r["seq"], r["reason"]) for r in got.where("event = 'POINT'").collect())
    judged = points.judged(p).join(p.select("device_id", "track_id", "seq", "ts_ms"), ["device_id", "track_id", "seq"])
    batch = sorted((r["device_id"], r["ts_ms"], r["seq"], r["reason"]) for r in judged.collect())
    key = lambda x: (x[0], x[1], x[2], x[3] or "")
    assert sorted(live_rows, key=key) == sorted(batch, key=key)


def test_pause_ends_by_event_time(spark):
    schema = live.INPUT
    source, out = tempfile.mkdtemp(prefix="spark-") + "/in", tempfile.mkdtemp(prefix="spark-")
    row = lambda d, kind, t, activity: (d, kind, None, t, 0, 38.0, -9.0, 5.0, True, activity, None)
    for k, rows in enumerate([[row(1, "activity", 1_000_000, "WALKING"), row(1, "activity", 1_060_000, "STILL")], [row(2, "activity", 9_000_000, "DRIVING")], [row(2, "activity", 9_500_000, "CYCLING")]]):
        df = spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_millis("at_ms"))
        df.coalesce(1).write.mode("append").parquet(f"{source}/{k}")
    stream = spark.readStream.schema(spark.read.parquet(f"{source}/0").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(source)
    q = live.live(stream, late="1 second").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/check").trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = {(r["device_id"], r["event"], r["at_ms"]) for r in spark.read.parquet(f"{out}/rows").collect()}
    assert (1, "PAUSE", 1_060_000) in got and (1, "FINISH", 1_240_000) in got


def test_refresh_equals_rebuild(spark):
    h = History(spark, SF)
    ends = h.ends.where("device_id < 12").select("device_id", "track_id", "started_at", "ended_at", "start_lat", "start_lon", "end_lat", "end_lon")
    folder = tempfile.mkdtemp(prefix="spark-")
    ends.write.parquet(f"{folder}/ends")
    ends = spark.read.parquet(f"{folder}/ends")
    derive = lambda e: intervals.verdicts(intervals.between_tracks(e))
    upkeep.rebuild(ends, derive, f"{folder}/intervals", parts=8)
    after = ends.where("not (device_id = 3 and track_id % 2 = 0) and device_id != 5")
    changed = spark.createDataFrame([(3,), (5,)], "device_id long")
    upkeep.refresh(spark, changed, after, derive, f"{folder}/intervals", parts=8)
    upkeep.rebuild(after, derive, f"{folder}/fresh", parts=8)
    read = lambda name: sorted((tuple(r) for r in spark.read.parquet(f"{folder}/{name}").select("device_id", "after_track_id", "start", "end", "kind").collect()), key=repr)
    assert read("intervals") == read("fresh")
    changed.write.parquet(f"{folder}/changes")
    stream = spark.readStream.schema(changed.schema).parquet(f"{folder}/changes")
    upkeep.follow(stream, lambda: ends, derive, f"{folder}/intervals", f"{folder}/check", parts=8).awaitTermination(200)
    upkeep.rebuild(ends, derive, f"{folder}/fresh", parts=8)
    assert read("intervals") == read("fresh")


def test_a_running_view_reads_the_parts_that_changed(spark):
    h = History(spark, SF)
    folder = tempfile.mkdtemp(prefix="spark-")
    ends = h.ends.where("device_id < 12").select("device_id", "track_id", "started_at", "ended_at", "start_lat", "start_lon", "end_lat", "end_lon")
    upkeep.dealt(ends, f"{folder}/ends", parts=8)
    dealt = spark.read.parquet(f"{folder}/ends")
    derive = lambda e: intervals.verdicts(intervals.between_tracks(e))
    upkeep.rebuild(dealt.drop("part"), derive, f"{folder}/intervals", parts=8)
    assert upkeep.parts_of(spark, f"{folder}/intervals") == 8
    changed = spark.createDataFrame([(3,)], "device_id long")
    with pytest.raises(ValueError, match="8 parts"):
        upkeep.refresh(spark, changed, dealt, derive, f"{folder}/intervals", parts=16)
    # the filter on parts reaches the scan's folders
    plan = upkeep.of_parts(dealt, [1, 2], 8)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part#" in plan
    seen = []

    def counted(e):
        seen.append({r["device_id"] for r in e.select("device_id").distinct().collect()})
        return derive(e).where("kind != 'GAP'")  # so that it shows which parts were derived anew

    changed.limit(0).write.parquet(f"{folder}/changes")
    stream = spark.readStream.schema(changed.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/changes")
    q = upkeep.follow(stream, lambda: spark.read.parquet(f"{folder}/ends"), counted, f"{folder}/intervals", f"{folder}/check", every="100 milliseconds")
    try:
        for device in (3, 5):
            spark.createDataFrame([(device,)], "device_id long").coalesce(1).write.mode("append").parquet(f"{folder}/changes")
            q.processAllAvailable()
        assert q.isActive
    finally:
        q.stop()
    number = {r["device_id"]: r["part"] for r in dealt.select("device_id", "part").distinct().collect()}
    touched = [{d for d in number if number[d] == number[x]} for x in (3, 5)]
    assert [s for s in seen if s] == touched
    gaps = {r["device_id"] for r in spark.read.parquet(f"{folder}/intervals").where("kind = 'GAP'").select("device_id").distinct().collect()}
    had = {r["device_id"] for r in derive(dealt.drop("part")).where("kind = 'GAP'").select("device_id").distinct().collect()}
    assert gaps == had - touched[0] - touched[1] and had & (touched[0] | touched[1])
