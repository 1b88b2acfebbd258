"""Edits of whole tracks and how they are taken back."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.config import Keep
from waymark.operators import edits, finish, points
from waymark.operators.edits import STATS

M = 1 / 111_195
TRACKS = "device_id long, track_id long, activity string, source string, started_at long, ended_at long, discarded_at long, discard_reason string"
FIXES = "device_id long, track_id long, activity string, seq int, ts_ms long, lat double, lon double, speed double, accuracy double, ignored boolean, ignore_reason string, segment_start boolean"


@pytest.fixture(autouse=True, scope="module")
def small_plans(spark):
    """The tables are tiny and the plans are wide: compiling them would take most of the time."""
    quick = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "1"}
    before = {k: spark.conf.get(k, None) for k in quick}
    for k, v in quick.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def drive(i, stops, activity="DRIVING", at=0, ended=True, device=1):
    """A track of fixes 5 s apart that stands still for minutes, drives, stands still, and so on; stops: minutes of each."""
    fixes, t, metres = [], at, 0.0
    for k, minutes in enumerate(stops):
        for _ in range(int(minutes * 12)):
            fixes.append((t, metres + (len(fixes) % 3)))
            t += 5000
        if k + 1 < len(stops):
            for _ in range(60):
                metres += 50
                fixes.append((t, metres))
                t += 5000
    rows = [(device, i, activity, n, ts, 38 + m * M, -9.0, None, 4.0, False, None, False) for n, (ts, m) in enumerate(fixes)]
    return (device, i, activity, "recorded", fixes[0][0], fixes[-1][0] if ended else None, None, None), rows


def frames(spark, *made):
    return spark.createDataFrame([t for t, _ in made], TRACKS), spark.createDataFrame([r for _, f in made for r in f], FIXES)


def same(a, b):
    """Equal rows, with doubles to a millimetre."""
    plain = lambda df: sorted([tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in sorted(df.columns))) for r in df.collect()], key=repr)
    return sorted(a.columns) == sorted(b.columns) and plain(a) == plain(b)


def stored(spark, *tables):
    """As written and read back; an edit's plan reads its tables several times."""
    return [spark.createDataFrame(t.collect(), t.schema) for t in tables]


def settle(spark, *made):
    return stored(spark, *edits.settled(*frames(spark, *made)))


def counts(df):
    return {r.track_id: r.n for r in df.where("ignore_reason = 'edge_stay'").groupBy("track_id").agg(F.count("*").alias("n")).collect()}


def test_split_and_unsplit(spark):
    t, f = settle(spark, drive(1, (3, 4, 3)), drive(2, (0.2, 0.2), at=10_000_000))
    outer = counts(f)
    assert outer[1] > 20 and 2 not in outer
    cut = 60_000 * 3 + 300_000 + 120_000  # in the middle of the stop between
    cuts = spark.createDataFrame([(1, 1, cut, 101), (1, 2, 10_000_000, 102)], "device_id long, track_id long, cut long, new_id long")
    u, g, journal = stored(spark, *edits.split(t, f, cuts))
    assert [tuple(r) for r in journal.collect()] == [(1, 1, 101)]  # the other cut would leave a half empty
    inner = counts(g)
    assert sum(inner.values()) > outer[1] + 15 and set(inner) == {1, 101}  # a half loses its own part of the stop
    rows = {r.track_id: r for r in u.collect()}
    assert set(rows) == {1, 2, 101} and rows[1].ended_at < cut <= rows[101].started_at
    good = {r.track_id: (r.a, r.b, r.n) for r in g.where("not ignored").groupBy("track_id").agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b"), F.count("*").alias("n")).collect()}
    assert all((r.started_at, r.ended_at, r.good_count) == good[i] for i, r in rows.items())
    v, h = edits.unsplit(u, g, journal)
    assert same(v, t) and same(h, f)


def test_merge_and_unmerge(spark):
    a, b = drive(1, (2, 2)), drive(2, (2, 2), at=600_000)
    t, f = settle(spark, a, b)
    plans = spark.createDataFrame([(1, 1, 2, 50)], "device_id long, track_id long, next_id long, merged_id long")
    u, g, journal = stored(spark, *edits.merged(t, f, plans, 5_000_000))
    rows = {r.track_id: r for r in u.collect()}
    assert {i: (r.discarded_at, r.discard_reason) for i, r in rows.items()} == {1: (5_000_000, "merged"), 2: (5_000_000, "merged"), 50: (None, None)}
    one = sorted((r.seq, r.ts_ms, r.segment_start) for r in g.where("track_id = 50").collect())
    assert [s for s, _, _ in one] == list(range(f.count())) and [t for _, t, _ in one] == sorted(t for _, t, _ in one)
    later = {r.track_id: r.started_at for r in t.collect()}[2]
    assert [t for _, t, s in one if s] == [min(t for _, t, _ in one if t >= later)]
    # the stop at the join is on the way now, the outer ones are not
    kept = [r.ts_ms for r in g.where("track_id = 50 and not ignored").collect()]
    inner = [r.ts_ms for r in f.where("ignore_reason = 'edge_stay' and ts_ms between 420000 and 720000").collect()]
    assert len(inner) >= 20 and set(inner) <= set(kept)
    assert rows[50].distance_m > sum(r.distance_m for r in t.collect()) - 1
    v, h = edits.unmerged(u, g, journal)
    assert same(v, t) and same(h, f)


def with_jumps(spark):
    """A walk that a bus carried: its fixes were taken for jumps."""
    t, rows = drive(1, (0.5, 0.5), "WALKING")
    fast = [(*r[:9], 7 < r[3] < 66, "jump" if 7 < r[3] < 66 else None, False) for r in rows]
    short, one = drive(2, (0.5,), "WALKING", at=9_000_000), drive(3, (0.2,), "WALKING", at=19_000_000)
    return frames(spark, (t, fast), short, (one[0], one[1][:2]))


def test_finish(spark):
    t, f = with_jumps(spark)
    renames = spark.createDataFrame([(1, 1, "UNKNOWN")], "device_id long, track_id long, activity string")
    u, g = stored(spark, *edits.finished(t, f, renames, keep=Keep()))
    rows = {r.track_id: r for r in u.collect()}
    assert set(rows) == {1, 2} and {r.track_id for r in g.collect()} == {1, 2}  # two fixes are purged
    assert rows[1].activity == "UNKNOWN" and rows[1].discard_reason is None and rows[1].distance_m > 2900
    assert g.where("ignore_reason = 'jump'").count() == 0 and g.where("track_id = 1 and activity != 'UNKNOWN'").count() == 0
    assert (rows[2].discard_reason, rows[2].discarded_at) == ("filtered", 9_000_000 + 25_000)
    # without the name the jumps stay jumps, and what is left is no journey
    u, g = edits.finished(t, f, renames.limit(0))
    rows = {r.track_id: r for r in u.collect()}
    assert rows[1].activity == "WALKING" and rows[1].ignored_count >= 58


def test_import_drops_strays_one_by_one(spark):
    t, rows = drive(1, (3, 3), at=1_000_000)
    off = [(1, 1, "DRIVING", -k, 1_000_000 - k * 5000, 38 + (100_000 if k == 2 else 5_000) * M, -9.0, None, 4.0, False, None, False) for k in (1, 2)]
    running = drive(2, (3, 3), at=8_000_000, ended=False)
    trips, fixes = frames(spark, (t, [*off, *rows]), running)
    u, g = stored(spark, *edits.imported(trips, fixes))
    assert sorted(r.seq for r in g.where("ignore_reason = 'jump'").collect()) == [-2, -1]
    stays = counts(g)
    assert stays[1] > 20 and 2 not in stays  # an open track isn't settled yet
    rows = {r.track_id: r for r in u.collect()}
    assert rows[2].ended_at is None and rows[2].started_at == 8_000_000 and rows[2].good_count == len(running[1])
    assert (rows[1].started_at, rows[1].ended_at) == (1_000_000, 1_495_000) and rows[1].good_count + rows[1].ignored_count == fixes.where("track_id = 1").count()


def test_strays_one_by_one_at_random(spark):
    """The rounds' result is that of looking at the first good fix again and again."""
    rng = random.Random(5)
    made = []
    for i in range(40):
        metres, rows = 0.0, []
        for n in range(rng.randint(1, 12)):
            metres += rng.choice([5, 40, {1: 900_000, 2: 30_000, 3: 1_000}.get(n, 60)])
            rows.append((1, i, "DRIVING", n, (n - (rng.random() < 0.1)) * 5000, 38 + metres * M, -9.0, None, 4.0, rng.random() < 0.1, None, False))
        made.append(rows)
    fixes = spark.createDataFrame([r for rows in made for r in rows], FIXES)
    got = {(r.track_id, r.seq) for r in edits.stray_heads(fixes).collect()}
    left = fixes
    want = set()
    for _ in range(edits.STRAYS):
        off = points.leading_stray(points.good(left)).where("stray").select("track_id")
        first = points.good(left).join(off, "track_id").groupBy("track_id").agg(F.min_by("seq", F.struct("ts_ms", "seq")).alias("seq")).collect()
        want |= {tuple(r) for r in first}
        left = spark.createDataFrame([r for rows in made for r in rows if (r[1], r[3]) not in want], FIXES)
    assert got == want and len(want) > 5


def test_dangling_tracks_end_at_their_last_fix(spark):
    t, f = frames(spark, drive(1, (1, 1), ended=False), drive(2, (1, 1), at=9_000_000))
    t = t.unionByName(spark.createDataFrame([(1, 3, "WALKING", "recorded", 77, None, None, None)], TRACKS))
    assert {r.track_id: r.ended_at for r in finish.closed(t, f).collect()} == {1: 415_000, 2: 9_415_000, 3: 77}


def test_restore_counts_only_where_a_flag_moved(spark):
    t, f = settle(spark, drive(1, (3, 3)), drive(2, (3, 3), at=9_000_000))
    t = t.withColumn("distance_m", F.lit(-1.0))  # as a file may say
    f = f.withColumns({"ignored": F.col("ignored") & (F.col("track_id") != 2), "ignore_reason": F.when(F.col("track_id") != 2, F.col("ignore_reason"))})
    u, g = stored(spark, *edits.restored(t, f))
    rows = {r.track_id: r for r in u.collect()}
    assert rows[1].distance_m == -1.0 and rows[2].distance_m > 2900
    assert counts(g)[1] == counts(g)[2] and all(rows[i].ended_at == s + 495_000 for i, s in ((1, 0), (2, 9_000_000)))


def test_a_second_sweep_writes_nothing(spark):
    t, f = settle(spark, drive(1, (3, 3)), drive(2, (3, 3), at=9_000_000), drive(3, (3, 3), at=19_000_000))
    # an older rule had left one track's stops on its path
    old = f.withColumns({"ignored": F.col("ignored") & (F.col("track_id") != 2), "ignore_reason": F.when(F.col("track_id") != 2, F.col("ignore_reason"))})
    was, old = stored(spark, edits.measured(t, old), old)
    u, g = stored(spark, *edits.swept(was, old))
    assert {r.track_id for r in u.collect()} == {2}
    assert {(r.track_id, r.seq) for r in g.collect()} == {(r.track_id, r.seq) for r in f.where("track_id = 2 and ignore_reason = 'edge_stay'").collect()}
    now, fixes = stored(spark, edits.written_over(was, u, ["device_id", "track_id"]), edits.written_over(old, g, ["device_id", "track_id", "seq"]))
    assert same(fixes, f) and same(now.select(*t.columns), t)
    u, g = edits.swept(now, fixes)
    assert u.isEmpty() and g.isEmpty()
    assert set(STATS) <= set(now.columns)


def test_empty(spark):
    t, f = frames(spark, drive(1, (1, 1)))
    t, f = t.limit(0), f.limit(0)
    none = spark.createDataFrame([], "device_id long, track_id long, activity string, cut long, new_id long, next_id long, merged_id long")
    for out in (edits.finished(t, f, none), edits.restored(t, f), edits.split(t, f, none), edits.merged(t, f, none, 1)):
        assert all(x.isEmpty() for x in out)
