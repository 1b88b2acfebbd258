"""The stored derivation of a history: clusters, memberships and what lies between tracks.

A change of some tracks is repaired by what it moves: memberships that leave and
arrive, sums and counts of their clusters shifted by them, and the intervals at the
seams. Clusters are derived anew only where a place's pin or reach has changed, and
what names a cluster lasts: a place's cluster goes by the place, another one by the
endpoint that founded it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.config import Stays
from waymark.functions.geo import Distance, haversine_m, one_ellipsoid_m
from waymark.operators import intervals, places
from waymark.operators.points import TRACK

_FOUNDER = "struct<at:long,track_id:long,is_end:int,again:int>"
CLUSTERS = f"device_id long, cluster_id string, place_id long, seed int, founder {_FOUNDER}, anchor_lat double, anchor_lon double, radius_m double, sum_lat double, sum_lon double, members long"
MEMBERS = "device_id long, track_id long, is_start boolean, at_ms long, lat double, lon double, cluster_id string"
INTERVALS = "device_id long, after_track_id long, next_id long, kind string, reason string, start long, end long, cluster_id string, to_cluster_id string, from_lat double, from_lon double, to_lat double, to_lon double"
ENDS = ("started_at", "ended_at", "start_lat", "start_lon", "end_lat", "end_lon")


@dataclass(frozen=True)
class Derivation:
    """Three tables; intervals holds a row for each pair of neighbouring tracks, of kind NONE where nothing lies between."""

    clusters: DataFrame
    members: DataFrame
    intervals: DataFrame

    def of(self, devices: DataFrame, how: str) -> Derivation:
        """The rows of some devices (left_semi), or of the others (left_anti)."""
        d = devices.select("device_id").distinct()
        return Derivation(*(t.join(d, "device_id", how) for t in (self.clusters, self.members, self.intervals)))

    def union(self, other: Derivation) -> Derivation:
        return Derivation(*(a.unionByName(b) for a, b in zip((self.clusters, self.members, self.intervals), (other.clusters, other.members, other.intervals))))

    def shown(self) -> DataFrame:
        """Stays and gaps."""
        return self.intervals.where("kind != 'NONE'")


def seeds(pins: DataFrame, *order: str) -> DataFrame:
    """Empty clusters at a device's places (device_id, place_id, lat, lon, radius_m), in an order of theirs, else by place_id."""
    n = F.row_number().over(Window.partitionBy("device_id").orderBy(*order, "place_id")) - 1
    none = F.lit(0.0)
    return pins.select("device_id", F.concat(F.lit("p"), F.col("place_id")).alias("cluster_id"), "place_id", n.cast("int").alias("seed"), F.lit(None).cast(_FOUNDER).alias("founder"), F.col("lat").alias("anchor_lat"), F.col("lon").alias("anchor_lon"), F.col("radius_m").cast("double").alias("radius_m"), none.alias("sum_lat"), none.alias("sum_lon"), F.lit(0).cast("long").alias("members"))


def endpoints(ends: DataFrame) -> DataFrame:
    """The known ends of tracks: device_id, track_id, started_at, is_start, at_ms, lat, lon."""
    row = lambda start, side: F.struct(F.lit(start).alias("is_start"), F.col("started_at" if start else "ended_at").alias("at_ms"), F.col(f"{side}_lat").alias("lat"), F.col(f"{side}_lon").alias("lon"))
    e = ends.select(*TRACK, "started_at", F.explode(F.array(row(True, "start"), row(False, "end"))).alias("x"))
    return e.select(*TRACK, "started_at", "x.*").where("lat is not null and lon is not null")


def named(founder: Column) -> Column:
    """The id of a cluster that an endpoint founded."""
    again = F.when(founder["again"] > 0, F.concat(F.lit("."), founder["again"])).otherwise("")
    return F.concat(F.lit("t"), founder["track_id"], F.when(founder["is_end"] == 1, "e").otherwise("s"), again)


def claimed(ends: DataFrame, clusters: DataFrame, rule: Stays, one: Callable, founded: bool = True) -> DataFrame:
    """Endpoints of tracks with the cluster that each joins or founds: MEMBERS, founder and anchor, the last two null where it was there.

    Clusters are tried in their order: places first, then the others as they were founded.
    Where none was founded yet (founded is false), no founder's name is looked for.
    """
    n = F.row_number().over(Window.partitionBy("device_id").orderBy(F.col("seed").asc_nulls_last(), "founder")) - 1
    held = clusters.withColumn("seed_index", n)
    pins = held.select("device_id", "seed_index", F.col("anchor_lat").alias("lat"), F.col("anchor_lon").alias("lon"), "radius_m")
    e = places.greedy_clusters(endpoints(ends), pins, rule, one, along=("started_at", "at_ms", "lat", "lon")).where("device_id is not null and track_id is not null")
    known = held.select("device_id", F.col("seed_index").cast("long").alias("seed"), F.col("cluster_id").alias("_known"))
    e = e.join(known, ["device_id", "seed"], "left")
    first = F.min(F.struct(F.col("started_at").alias("at"), "track_id", (~F.col("is_start")).cast("int").alias("is_end"))).over(Window.partitionBy("device_id", "cluster"))
    e = e.withColumn("_first", F.when(F.col("_known").isNull(), first))
    if founded:
        # an endpoint that founded a cluster before founds another one under another name
        were = clusters.where("founder is not null").groupBy("device_id", F.col("founder.track_id").alias("_t"), F.col("founder.is_end").alias("_e")).agg((F.max("founder.again") + 1).alias("_again"))
        e = e.withColumns({"_t": F.col("_first.track_id"), "_e": F.col("_first.is_end")}).join(were, ["device_id", "_t", "_e"], "left")
    else:
        e = e.withColumn("_again", F.lit(None).cast("int"))
    founder = F.when(F.col("_first").isNotNull(), F.struct("_first.at", "_first.track_id", "_first.is_end", F.coalesce("_again", F.lit(0)).cast("int").alias("again")))
    e = e.withColumn("founder", founder.cast(_FOUNDER))
    cluster = F.coalesce("_known", named(F.col("founder"))).alias("cluster_id")
    return e.select(*TRACK, "is_start", "at_ms", "lat", "lon", cluster, "founder", "anchor_lat", "anchor_lon")


def shifted(clusters: DataFrame, arriving: DataFrame, leaving: DataFrame, rule: Stays) -> DataFrame:
    """Clusters after endpoints have joined and left: sums and counts move by theirs, founded ones are added, empty ones without a place go."""
    row = lambda m, sign, founder: m.select("device_id", "cluster_id", (sign * F.col("lat")).alias("d_lat"), (sign * F.col("lon")).alias("d_lon"), F.lit(sign).alias("d_n"), *founder)
    none = [F.lit(None).cast(_FOUNDER).alias("_founder"), F.lit(None).cast("double").alias("_lat"), F.lit(None).cast("double").alias("_lon")]
    deltas = row(arriving, 1, [F.col("founder").alias("_founder"), F.col("anchor_lat").alias("_lat"), F.col("anchor_lon").alias("_lon")]).unionByName(row(leaving, -1, none))
    new = F.col("_founder").isNotNull()
    deltas = deltas.groupBy("device_id", "cluster_id").agg(F.sum("d_lat").alias("d_lat"), F.sum("d_lon").alias("d_lon"), F.sum("d_n").alias("d_n"), F.max("_founder").alias("_founder"), F.max(F.when(new, F.col("_lat"))).alias("_lat"), F.max(F.when(new, F.col("_lon"))).alias("_lon"))
    c = clusters.join(deltas, ["device_id", "cluster_id"], "full")
    added = lambda c, d: (F.coalesce(c, F.lit(0)) + F.coalesce(d, F.lit(0))).alias(c)
    c = c.select("device_id", "cluster_id", "place_id", "seed", F.coalesce("founder", "_founder").alias("founder"), F.coalesce("anchor_lat", "_lat").alias("anchor_lat"), F.coalesce("anchor_lon", "_lon").alias("anchor_lon"), F.coalesce("radius_m", F.lit(rule.cluster_radius_m)).alias("radius_m"), added("sum_lat", "d_lat"), added("sum_lon", "d_lon"), added("members", "d_n"))
    return c.where("place_id is not null or members > 0")


def between(ends: DataFrame, members: DataFrame, clusters: DataFrame, rule: Stays, distance: Distance) -> DataFrame:
    """INTERVALS of all neighbouring tracks: ends in one cluster, near one another, or nearest to one place, are one place."""
    pins = clusters.where("place_id is not null").select("device_id", F.col("seed").alias("seed_index"), F.col("anchor_lat").alias("lat"), F.col("anchor_lon").alias("lon"), "radius_m")
    m = places.nearest_pin(members.select(*TRACK, "is_start", "lat", "lon", "cluster_id"), pins, [*TRACK, "is_start"], distance)
    # one row a track: the clusters and pins of both its ends
    side = lambda c, start: F.max(F.when(F.col("is_start") == start, F.col(c)))
    at = m.groupBy(*TRACK).agg(*[side(c, start).alias(f"{name}_{kind}") for start, name in ((True, "start"), (False, "end")) for c, kind in (("cluster_id", "cluster"), ("pin", "pin"))])
    v = intervals.verdicts(intervals.between_tracks(ends.select(*TRACK, *ENDS).join(at, list(TRACK), "left")), rule, distance)
    gap = F.col("kind") == "GAP"
    only = lambda c: F.when(gap, F.col(c)).alias(c)
    some = F.when(F.col("kind") != "NONE", F.col("from_cluster"))
    return v.select("device_id", "after_track_id", "next_id", "kind", "reason", "start", "end", some.alias("cluster_id"), F.when(gap, F.col("to_cluster")).alias("to_cluster_id"), *map(only, ("from_lat", "from_lon", "to_lat", "to_lon")))


def derive(ends: DataFrame, seeds: DataFrame, rule: Stays = Stays(), distance: Distance = haversine_m, one: Callable = one_ellipsoid_m) -> Derivation:
    """The derivation of whole histories; ends: device_id, track_id and ENDS, one row a kept track."""
    arriving = claimed(ends, seeds, rule, one, founded=False)
    members = arriving.select(*[c.split()[0] for c in MEMBERS.split(", ")])
    clusters = shifted(seeds, arriving, members.limit(0), rule)
    return Derivation(clusters, members, between(ends, members, clusters, rule, distance))


def repair(stored: Derivation, ends: DataFrame, changed: DataFrame, rule: Stays = Stays(), distance: Distance = haversine_m, one: Callable = one_ellipsoid_m) -> Derivation:
    """The stored derivation after some tracks (device_id, track_id) were added, removed or rewritten; ends: all kept tracks as they are now.

    Their old endpoints leave their clusters and the new ones join or found some, in
    their order; nothing else is clustered again. Intervals are taken anew of the
    pairs that a changed track is in, or was in. It equals a full derivation but where
    a track goes whose end founded a cluster that others have joined: that one stays
    where it is, under its name. Rows of devices without a change are passed on.
    """
    touched = changed.select(*TRACK).distinct()
    rest, mine = stored.of(touched, "left_anti"), stored.of(touched, "left_semi")
    now = ends.join(touched.select("device_id").distinct(), "device_id", "left_semi").select(*TRACK, *ENDS)
    leaving = mine.members.join(touched, list(TRACK), "left_semi")
    arriving = claimed(now.join(touched, list(TRACK), "left_semi"), mine.clusters, rule, one)
    members = mine.members.join(touched, list(TRACK), "left_anti").unionByName(arriving.select(*mine.members.columns))
    clusters = shifted(mine.clusters, arriving, leaving, rule)
    # seams: after each track that is or was next to a changed one, and after these
    order = Window.partitionBy("device_id").orderBy("started_at", "track_id")
    chain = now.select(*TRACK, F.lag("track_id").over(order).alias("_before")).join(touched, list(TRACK), "left_semi")
    seams = touched.unionByName(chain.select("device_id", F.col("_before").alias("track_id")).where("track_id is not null"))
    was = mine.intervals.join(touched.select("device_id", F.col("track_id").alias("next_id")), ["device_id", "next_id"], "left_semi")
    seams = seams.unionByName(was.select("device_id", F.col("after_track_id").alias("track_id"))).distinct().withColumnRenamed("track_id", "after_track_id")
    key = ["device_id", "after_track_id"]
    # only the tracks at a seam and those after them are measured
    follow = now.select(*TRACK, F.lag("track_id").over(order).alias("after_track_id")).join(seams, key, "left_semi").select(*TRACK)
    near = follow.unionByName(seams.select("device_id", F.col("after_track_id").alias("track_id"))).distinct()
    fresh = between(now, members.join(near, list(TRACK), "left_semi"), clusters, rule, distance).join(seams, key, "left_semi")
    return rest.union(Derivation(clusters, members, mine.intervals.join(seams, key, "left_anti").unionByName(fresh)))


def moved_seeds(clusters: DataFrame, seeds: DataFrame) -> DataFrame:
    """Places whose cluster is missing, orphaned or elsewhere: device_id, place_id, state. A new name moves nothing."""
    body = ("seed", "anchor_lat", "anchor_lon", "radius_m")
    old = clusters.where("place_id is not null").select("device_id", "place_id", F.struct(*body).alias("_old"))
    both = old.join(seeds.select("device_id", "place_id", F.struct(*body).alias("_new")), ["device_id", "place_id"], "full")
    state = F.when(F.col("_new").isNull(), "orphaned").when(F.col("_old").isNull(), "missing").when(F.col("_old") != F.col("_new"), "moved")
    return both.withColumn("state", state).where("state is not null").select("device_id", "place_id", "state")


def reconcile(stored: Derivation, ends: DataFrame, seeds: DataFrame, stale: DataFrame | None = None, rule: Stays = Stays(), distance: Distance = haversine_m, one: Callable = one_ellipsoid_m) -> Derivation:
    """The stored derivation brought back to its places: devices whose seeds moved, or that are stale, are derived anew.

    A place's cluster keeps its id, and so does one whose founding endpoint founds it
    again; rows of all other devices are passed on as they are.
    """
    devices = moved_seeds(stored.clusters, seeds).select("device_id")
    devices = (devices if stale is None else devices.unionByName(stale.select("device_id"))).distinct()
    mine = lambda t: t.join(devices, "device_id", "left_semi")
    return stored.of(devices, "left_anti").union(derive(mine(ends), mine(seeds), rule, distance, one))


def read_model(stored: Derivation) -> tuple[DataFrame, DataFrame]:
    """(clusters, intervals) as lists show them: clusters with their centre and number, those of places first in their order; intervals that aren't empty.

    A cluster without members lies at its anchor.
    """
    n = F.row_number().over(Window.partitionBy("device_id").orderBy(F.col("seed").asc_nulls_last(), "founder")) - 1
    mean = lambda s, a: F.when(F.col("members") > 0, F.col(s) / F.col("members")).otherwise(F.col(a))
    c = stored.clusters.select("device_id", "cluster_id", n.alias("number"), "place_id", mean("sum_lat", "anchor_lat").alias("lat"), mean("sum_lon", "anchor_lon").alias("lon"), "radius_m", "members")
    number = c.select("device_id", "cluster_id", F.col("number").alias("cluster"))
    return c, stored.shown().join(number, ["device_id", "cluster_id"], "left")
