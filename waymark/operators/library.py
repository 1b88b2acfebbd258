"""A history's tracks and places as their owner changes them: discarded, restored, retyped, deleted, listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.config import BRIEF, DAY_MS, Dwell, Edge
from waymark.functions.geo import haversine_m
from waymark.operators import dwells, points
from waymark.operators.points import TRACK
from waymark.schemas import ceiling_kmh, group_of

#: Days that a discarded track is kept.
KEEP_DAYS = 14


def discarded(tracks: DataFrame, chosen: DataFrame) -> DataFrame:
    """Tracks with chosen ones (device_id, track_id, at, reason) discarded; an open one ends then."""
    c = chosen.select(*TRACK, F.col("at").alias("_at"), F.col("reason").alias("_why"))
    t = tracks.join(c.hint("merge"), list(TRACK), "left")
    return t.withColumns({"ended_at": F.coalesce("ended_at", "_at"), "discarded_at": F.coalesce("_at", "discarded_at"), "discard_reason": F.when(F.col("_at").isNotNull(), F.col("_why")).otherwise(F.col("discard_reason"))}).drop("_at", "_why")


def restored(tracks: DataFrame, chosen: DataFrame) -> DataFrame:
    """Tracks with chosen ones (device_id, track_id) not discarded any more."""
    t = tracks.join(chosen.select(*TRACK, F.lit(True).alias("_back")).hint("merge"), list(TRACK), "left")
    keep = lambda c: F.when(F.col("_back").isNull(), F.col(c))
    return t.withColumns({"discarded_at": keep("discarded_at"), "discard_reason": keep("discard_reason")}).drop("_back")


def without(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Tracks, or points, without those of chosen tracks."""
    return rows.join(chosen.select(*TRACK).hint("merge"), list(TRACK), "left_anti")


def taken_back(fixes: DataFrame, changes: DataFrame) -> DataFrame:
    """Fixes with _new, the activity that a change (device_id, track_id, activity) gives their track, and without the jumps that it allows."""
    f = fixes.join(changes.select(*TRACK, F.col("activity").alias("_new")).hint("merge"), list(TRACK), "left")
    old, new = F.col("activity"), F.col("_new")
    faster = new.isNotNull() & (ceiling_kmh(new) > ceiling_kmh(old))
    # fixes that no faster activity is given to are passed over
    why = F.when(faster, F.when(F.col("ignored"), F.coalesce("ignore_reason", F.lit("other")))).otherwise("other")
    f = points.with_restored(f.withColumn("reason", why), F.when(faster, ceiling_kmh(new))).withColumn("ignored", F.col("ignored") & ~F.col("back"))
    return f.withColumn("ignore_reason", F.when(F.col("ignored"), F.col("ignore_reason"))).drop("reason", "back")


def retyped(tracks: DataFrame, fixes: DataFrame, changes: DataFrame, edge: Edge = Edge(), dwell: Dwell = BRIEF) -> tuple[DataFrame, DataFrame]:
    """(tracks, fixes) with another activity for some; changes: device_id, track_id, activity.

    fixes have ignored and ignore_reason. Where the new activity allows faster
    steps, jumps that it allows come back; where it is of another group, stops at
    the edges are taken anew.
    """
    c = changes.select(*TRACK, F.col("activity").alias("_new"))
    old, new = F.col("activity"), F.col("_new")
    f = taken_back(fixes, changes).withColumn("_again", new.isNotNull() & (group_of(new) != group_of(old)))
    f = f.withColumn("activity", F.coalesce("_new", "activity")).drop("_new")
    settled = dwells.settled(f.where("_again"), edge, dwell)
    t = tracks.join(c.hint("merge"), list(TRACK), "left").withColumn("activity", F.coalesce("_new", "activity")).drop("_new")
    return t, f.where("not _again").unionByName(settled.select(*f.columns)).drop("_again")


def listed(tracks: DataFrame) -> DataFrame:
    """Adds state: open, kept or discarded."""
    return tracks.withColumn("state", F.when(F.col("discarded_at").isNotNull(), "discarded").when(F.col("ended_at").isNull(), "open").otherwise("kept"))


def newest_first(tracks: DataFrame) -> DataFrame:
    """Adds rank within a device and state, by start, newest first; ties by track_id."""
    w = Window.partitionBy("device_id", "state").orderBy(F.desc("started_at"), F.desc("track_id"))
    return listed(tracks).withColumn("rank", F.row_number().over(w))


def days_left(discarded_at: Column, now_ms: Column) -> Column:
    """Days until a discarded track is purged; not below 0."""
    return F.greatest(F.lit(0), KEEP_DAYS - F.floor((now_ms - discarded_at) / DAY_MS))


def edited(places: DataFrame, edits: DataFrame) -> DataFrame:
    """Places after edits: device_id, place_id and label, lat, lon, radius_m, category; what is null in an edit stays.

    An edit of a place that there isn't adds it.
    """
    key, body = ["device_id", "place_id"], ["label", "lat", "lon", "radius_m", "category"]
    e = edits.select(*key, *[F.col(c).alias(f"_{c}") for c in body])
    p = places.select(*key, *body).join(e, key, "full")
    return p.select(*key, *[F.coalesce(f"_{c}", c).alias(c) for c in body])


def seeds_off(clusters: DataFrame, places: DataFrame) -> DataFrame:
    """Seeds to repair: orphaned ones, whose place is gone, and missing ones, places without a seed.

    clusters: device_id, place_id of each seed cluster; places: device_id, place_id.
    """
    key = ["device_id", "place_id"]
    both = clusters.select(*key, F.lit(True).alias("_c")).distinct().join(places.select(*key, F.lit(True).alias("_p")), key, "full")
    return both.where("_c is null or _p is null").select(*key, F.when(F.col("_p").isNull(), "orphaned").otherwise("missing").alias("state"))


def deltas(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """How visits and time change for each key when stays (key, start, end) are replaced; keys without a change are left out."""
    row = lambda s, sign: s.select(*key, F.lit(sign).alias("visits"), (sign * (F.col("end") - F.col("start"))).alias("spent_ms"))
    d = row(before, -1).unionByName(row(after, 1)).groupBy(*key).agg(F.sum("visits").alias("visits"), F.sum("spent_ms").alias("spent_ms"))
    return d.where("visits != 0 or spent_ms != 0")


def says_same(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of a device's places that say the same: label, position and radius, nulls alike; their ids may differ."""
    other = b.select("device_id", F.col("place_id").alias("same_id"), *[F.col(c).alias(f"_{c}") for c in ("label", "lat", "lon", "radius_m")])
    j = a.join(other, "device_id")
    for c in ("label", "lat", "lon", "radius_m"):
        j = j.where(F.col(c).eqNullSafe(F.col(f"_{c}")))
    return j.select("device_id", "place_id", "same_id")


def reacquired(asked: DataFrame, summaries: DataFrame) -> DataFrame:
    """place_id of what was shown before: the summary with its key, else the one of its pin, else the previous one.

    asked: device_id, ask_id, key, pin, previous; summaries: device_id, key, pin, place_id.
    """
    s = summaries.groupBy("device_id", "key").agg(F.min("place_id").alias("_k"))
    t = summaries.groupBy("device_id", "pin").agg(F.min("place_id").alias("_p"))
    a = asked.join(s, ["device_id", "key"], "left").join(t, ["device_id", "pin"], "left")
    return a.select("device_id", "ask_id", F.coalesce("_k", "_p", "previous").alias("place_id"))


def proximity_search(places: DataFrame, matches: Column, lat: float | None, lon: float | None) -> DataFrame:
    """Places that match, with rank: by distance from a point where there is one, else by place_id."""
    far = haversine_m(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")) if lat is not None else F.lit(0.0)
    w = Window.partitionBy("device_id").orderBy("_far", "place_id")
    return places.where(matches).withColumn("_far", far).withColumn("rank", F.row_number().over(w)).drop("_far")
