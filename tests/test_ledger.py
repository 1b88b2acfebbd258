"""The stored derivation: repairs against full derivations, and what lasts over a rebuild."""

import random

import pytest

from waymark.functions import geo
from waymark.operators import ledger

M = 1 / 111_195
ENDS = "device_id long, track_id long, started_at long, ended_at long, start_lat double, start_lon double, end_lat double, end_lon double"
PLACES = "device_id long, place_id long, lat double, lon double, radius_m double"
SPHERE = {"distance": geo.haversine_m, "one": geo.one_sphere_m}


def track(i, at, until, a, b, device=1):
    """A track from a to b, metres north of a point; None where an end isn't known."""
    place = lambda m: (None, None) if m is None else (38 + m * M, -9.0)
    return (device, i, at, until, *place(a), *place(b))


def frames(spark, tracks, pins=()):
    ends = spark.createDataFrame(tracks, ENDS)
    return ends, ledger.seeds(spark.createDataFrame([(d, p, 38 + m * M, -9.0, float(r)) for d, p, m, r in pins], PLACES))


def rows(d):
    """Comparable rows; a sum may differ in its last digits."""
    c = sorted((r.device_id, r.cluster_id, r.place_id, r.members, round(r.sum_lat, 8), round(r.sum_lon, 8), r.anchor_lat, r.radius_m) for r in d.clusters.collect())
    m = sorted((r.device_id, r.track_id, r.is_start, r.at_ms, r.lat, r.cluster_id) for r in d.members.collect())
    i = sorted((tuple(r) for r in d.intervals.collect()), key=repr)
    return c, m, i


def kept(spark, d):
    """As if read back from storage."""
    plain = lambda t, schema: spark.createDataFrame(t.collect(), t.schema)
    return ledger.Derivation(*(plain(t, None) for t in (d.clusters, d.members, d.intervals)))


def test_by_hand(spark):
    tracks = [track(1, 0, 10, 0, 1000), track(2, 20, 30, 1050, 5000), track(3, 40, 50, 9000, None), track(4, 60, 70, 0, 120), track(5, 65, 80, 300, 400)]
    ends, seeds = frames(spark, tracks, [(1, 7, 0, 100), (1, 8, 50_000, 50)])
    c, m, i = rows(ledger.derive(ends, seeds, **SPHERE))
    assert [(x[1], x[3]) for x in c] == [("p7", 2), ("p8", 0), ("t1e", 2), ("t2e", 1), ("t3s", 1), ("t4e", 1), ("t5s", 2)]
    assert {(x[1], x[2]): x[5] for x in m}[4, True] == "p7"
    got = {x[1]: (x[2], x[3], x[4], x[7], x[8]) for x in i}
    assert got == {1: (2, "STAY", None, "t1e", None), 2: (3, "GAP", "MOVED_UNRECORDED", "t2e", "t3s"), 3: (4, "GAP", "UNKNOWN_ENDPOINT", None, "p7"), 4: (5, "NONE", None, None, None)}


def random_tracks(rng, n, device):
    out, at = [], 0
    for i in range(n):
        at += rng.choice([0, 5, 60, 600])
        until = at + rng.randint(1, 50)
        spot = lambda: None if rng.random() < 0.08 else rng.choice([0, 60, 130, 200, 1000, 1080, 4000, rng.randint(0, 6000)])
        out.append(track(device * 1000 + i, at, until, spot(), spot(), device))
        at = until
    return out


@pytest.mark.parametrize("seed", range(1))
def test_repairs_equal_full_derivations(spark, seed):
    """Tracks are added at the end, and such go, or are rewritten, that founded nothing and stand between kept ones."""
    rng = random.Random(seed)
    tracks = [t for d in range(1, 7) for t in random_tracks(rng, 30, d)]
    pins = [(d, d * 10 + k, m, r) for d in range(1, 7) for k, (m, r) in enumerate([(0, 100), (1000, 60)])]
    early = [t for t in tracks if t[1] % 1000 < 22 or t[0] == 6]
    ends, seeds = frames(spark, early, pins)
    stored = kept(spark, ledger.derive(ends, seeds, **SPHERE))
    founders = {r.founder.track_id for r in stored.clusters.where("founder is not null").collect()}
    free = [t for t in early if t[1] not in founders and t[0] < 6]
    gone = {t[1] for t in rng.sample(free, min(len(free), 8))}
    after = [t for t in tracks if t[1] not in gone]
    changed = [(t[0], t[1]) for t in tracks if t[1] in gone or t not in early]
    assert changed and gone
    changes = spark.createDataFrame(changed, "device_id long, track_id long")
    now = frames(spark, after)[0]
    got = rows(ledger.repair(stored, now, changes, **SPHERE))
    want = rows(ledger.derive(now, seeds, **SPHERE))
    assert got[2] == want[2] and got[1] == want[1]
    assert [x[:4] + x[6:] for x in got[0]] == [x[:4] + x[6:] for x in want[0]]
    assert all(abs(a[k] - b[k]) < 1e-6 for a, b in zip(got[0], want[0]) for k in (4, 5))
    # nothing to do: the same rows
    again = kept(spark, ledger.derive(now, seeds, **SPHERE))
    assert rows(ledger.repair(again, now, changes.limit(0), **SPHERE)) == want


def test_a_founder_that_goes_leaves_its_cluster_where_it_is(spark):
    tracks = [track(1, 0, 10, 0, 3000), track(2, 20, 30, 3100, 9000), track(3, 40, 50, 9000, 3200)]
    ends, seeds = frames(spark, tracks)
    stored = kept(spark, ledger.derive(ends, seeds, **SPHERE))
    one = lambda *ids: spark.createDataFrame([(1, i) for i in ids], "device_id long, track_id long")
    d = ledger.repair(stored, frames(spark, tracks[1:])[0], one(1), **SPHERE)
    c, m, i = rows(d)
    # t1s held nothing else and is gone; t1e goes on with the other start that is near it
    assert {x[1]: x[3] for x in c} == {"t1e": 1, "t2e": 2, "t3e": 1} and {x[1] for x in i} == {2}
    assert {x[5] for x in m if x[1] == 2 and x[2]} == {"t1e"}
    # the track comes back elsewhere, and its end founds one more under a name of its own
    moved = [track(1, 0, 10, 0, 20_000), *tracks[1:]]
    c = rows(ledger.repair(kept(spark, d), frames(spark, moved)[0], one(1), **SPHERE))[0]
    assert {x[1]: x[3] for x in c} == {"t1s": 1, "t1e": 1, "t1e.1": 1, "t2e": 2, "t3e": 1}


def test_a_place_keeps_its_empty_cluster(spark):
    tracks = [track(1, 0, 10, 0, 3000), track(2, 20, 30, 3000, None)]
    ends, seeds = frames(spark, tracks, [(1, 5, 0, 150)])
    stored = kept(spark, ledger.derive(ends, seeds, **SPHERE))
    d = ledger.repair(stored, frames(spark, tracks[1:])[0], spark.createDataFrame([(1, 1)], "device_id long, track_id long"), **SPHERE)
    clusters, shown = ledger.read_model(d)
    assert sorted((r.cluster_id, r.number, r.members, round(r.lat, 6)) for r in clusters.collect()) == [("p5", 0, 0, 38.0), ("t1e", 1, 1, round(38 + 3000 * M, 6))]
    assert shown.count() == 0


def test_reconcile_touches_moved_places_only(spark):
    rng = random.Random(3)
    tracks = [t for d in range(1, 5) for t in random_tracks(rng, 20, d)]
    pins = [(d, d * 10 + k, m, r) for d in range(1, 5) for k, (m, r) in enumerate([(0, 100), (1000, 60)])]
    ends, seeds = frames(spark, tracks, pins)
    stored = kept(spark, ledger.derive(ends, seeds, **SPHERE))
    # device 1: a place goes; 2: one reaches farther; 3: one is new; 4: nothing
    new = [p for p in pins if p[1] != 11]
    new = [(*p[:3], 300) if p[1] == 20 else p for p in new] + [(3, 39, 4000, 80)]
    seeds = frames(spark, [], new)[1]
    assert sorted(tuple(r) for r in ledger.moved_seeds(stored.clusters, seeds).collect()) == [(1, 11, "orphaned"), (2, 20, "moved"), (3, 39, "missing")]
    d = ledger.reconcile(stored, ends, seeds, **SPHERE)
    got, want, before = rows(d), rows(ledger.derive(ends, seeds, **SPHERE)), rows(stored)
    assert got == want
    still = lambda part: [x for x in part if x[0] == 4]
    assert [still(p) for p in got] == [still(p) for p in before]
    # ids last: of places, and of what the same endpoints found
    names = lambda part, device: {(x[1], x[6]) for x in part[0] if x[0] == device}
    assert len(names(got, 3) & names(before, 3)) >= len(names(before, 3)) - 2
    assert rows(ledger.reconcile(stored, ends, frames(spark, [], pins)[1], **SPHERE)) == before
    # a stale device is derived anew
    worse = ledger.Derivation(stored.clusters, stored.members, stored.intervals.where("device_id != 4"))
    stale = spark.createDataFrame([(4,)], "device_id long")
    assert rows(ledger.reconcile(worse, ends, frames(spark, [], pins)[1], stale, **SPHERE)) == before
