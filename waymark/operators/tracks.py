"""Tracks: statistics, bounds, verdicts, neighbours, overlaps, merging and splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from waymark.config import Keep, Stays
from waymark.functions.geo import Distance, haversine_m
from waymark.operators.points import ORDER, TRACK, good, in_order


def by_start() -> WindowSpec:
    return Window.partitionBy("device_id").orderBy("started_at", "track_id")


def stats(points: DataFrame, distance: Distance = haversine_m) -> DataFrame:
    """Counts, length over good fixes (legs over breaks count), first and last good place, extent."""
    # one pass over all fixes: a good one's seam is from the last good one before it
    is_good, at = ~F.col("ignored"), F.struct(*ORDER)
    of = lambda c: F.when(is_good, F.col(c))
    before = F.last(F.when(is_good, F.struct("lat", "lon")), True).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    seam = distance(before["lat"], before["lon"], F.col("lat"), F.col("lon"))
    corners = distance(F.min(of("lat")), F.min(of("lon")), F.max(of("lat")), F.max(of("lon")))
    out = points.withColumn("seam_m", F.when(is_good, F.coalesce(seam, F.lit(0.0)))).groupBy(*TRACK).agg(
        F.count_if("ignored").alias("ignored_count"),
        F.count_if(is_good).alias("good_count"),
        F.sum("seam_m").alias("distance_m"),
        F.min_by("lat", F.when(is_good, at)).alias("start_lat"),
        F.min_by("lon", F.when(is_good, at)).alias("start_lon"),
        F.max_by("lat", F.when(is_good, at)).alias("end_lat"),
        F.max_by("lon", F.when(is_good, at)).alias("end_lon"),
        F.min(of("ts_ms")).alias("first_ms"),
        F.max(of("ts_ms")).alias("last_ms"),
        corners.alias("extent_m"),
    )
    zero = {"good_count": 0, "distance_m": 0.0, "extent_m": 0.0}
    return out.fillna(zero).withColumn("extent_m", F.when(F.col("good_count") < 2, 0.0).otherwise(F.col("extent_m")))


def bounds(tracks: DataFrame, points: DataFrame) -> DataFrame:
    """Tracks with the times of the first and last good fix, else their own."""
    b = good(points).groupBy(*TRACK).agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b"))
    return tracks.join(b.hint("merge"), list(TRACK), "left").select(*TRACK, F.coalesce("a", "started_at").alias("from_ms"), F.coalesce("b", "ended_at").alias("to_ms"))


def verdict(rows: DataFrame, rule: Keep = Keep()) -> Column:
    """purge, discard or keep; rows have counts, seconds, distance_m and extent_m. The order matters."""
    return (
        F.when(F.col("good_count") + F.col("ignored_count") <= 2, "PURGE")
        .when(F.col("good_count") < 2, "DISCARD")
        .when(F.col("seconds") < rule.min_seconds, "DISCARD")
        .when(F.col("distance_m") < rule.min_length_m, "DISCARD")
        .when(F.lit(rule.min_extent_m > 0) & (F.col("extent_m") < rule.min_extent_m), "DISCARD")
        .otherwise("KEEP")
    )


def neighbours(tracks: DataFrame) -> DataFrame:
    """The kept tracks before and after each one."""
    return tracks.select(*TRACK, F.lag("track_id").over(by_start()).alias("before"), F.lead("track_id").over(by_start()).alias("after"))


def spanning(candidates: DataFrame, points: DataFrame) -> DataFrame:
    """Candidates (device_id, cand_id, from_ms, to_ms) with tracks: how many have a fix at both instants; ignored ones count."""
    at = points.select("device_id", "track_id", "ts_ms").distinct()
    start = candidates.join(at.withColumnRenamed("ts_ms", "from_ms").hint("merge"), ["device_id", "from_ms"]).select("device_id", "cand_id", "track_id", "to_ms")
    both = start.join(at.withColumnRenamed("ts_ms", "to_ms").hint("merge"), ["device_id", "track_id", "to_ms"], "left_semi")
    n = both.groupBy("device_id", "cand_id").agg(F.count_distinct("track_id").alias("tracks"))
    return candidates.join(n.hint("merge"), ["device_id", "cand_id"], "left").select("device_id", "cand_id", F.coalesce("tracks", F.lit(0)).alias("tracks"))


def overlapping(candidates: DataFrame, points: DataFrame, bucket_ms: int = 3_600_000) -> DataFrame:
    """Candidates with overlaps: how many tracks' good fixes span some time strictly inside.

    A range join by buckets of time: both sides go to the buckets that they touch,
    and a pair counts in the bucket where the later one starts.
    """
    spans = good(points).groupBy(*TRACK).agg(F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"))
    bucket = lambda c: F.floor(F.col(c) / bucket_ms)
    a = candidates.withColumn("bucket", F.explode(F.sequence(bucket("from_ms"), bucket("to_ms"))))
    b = spans.withColumn("bucket", F.explode(F.sequence(bucket("lo"), bucket("hi"))))
    hit = a.join(b.hint("merge"), ["device_id", "bucket"]).where("lo < to_ms and hi > from_ms").where(F.col("bucket") == F.floor(F.greatest("lo", "from_ms") / bucket_ms))
    n = hit.groupBy("device_id", "cand_id").agg(F.count("*").alias("overlaps"))
    return candidates.join(n.hint("merge"), ["device_id", "cand_id"], "left").select("device_id", "cand_id", F.coalesce("overlaps", F.lit(0)).alias("overlaps"))


def merge_plans(tracks: DataFrame, rule: Stays = Stays()) -> DataFrame:
    """Neighbouring tracks that can be one: a short closed interval between, same activity and source."""
    nxt = lambda c: F.lead(c).over(by_start())
    t = tracks.select(*TRACK, "activity", "source", "ended_at", nxt("track_id").alias("next_id"), nxt("started_at").alias("next_start"), nxt("activity").alias("next_activity"), nxt("source").alias("next_source"))
    gap = F.col("next_start") - F.col("ended_at")
    ok = gap.between(0, rule.merge_ms) & (F.col("activity") == F.col("next_activity")) & F.col("source").eqNullSafe(F.col("next_source"))
    return t.where(ok).select(*TRACK, "next_id", gap.alias("gap_ms"))


def merged(points: DataFrame, plans: DataFrame) -> DataFrame:
    """Points with the later track's fixes moved to the earlier one, and a break where they join."""
    move = plans.select("device_id", F.col("next_id").alias("track_id"), F.col("track_id").alias("into"))
    first = F.row_number().over(Window.partitionBy(*TRACK).orderBy(*ORDER)) == 1
    p = points.join(move.hint("merge"), list(TRACK), "left").withColumn("segment_start", F.col("segment_start") | (F.col("into").isNotNull() & first))
    return p.withColumn("track_id", F.coalesce("into", "track_id")).drop("into")


def split_plans(points: DataFrame, cut_ms: DataFrame) -> DataFrame:
    """cut_ms: device_id, track_id, cut. Both halves' good fixes, and whether both have two at least."""
    g = good(points).join(cut_ms.hint("merge"), list(TRACK))
    n = g.groupBy(*TRACK).agg(F.count_if(F.col("ts_ms") < F.col("cut")).alias("before_n"), F.count_if(F.col("ts_ms") >= F.col("cut")).alias("after_n"))
    return n.withColumn("legal", (F.col("before_n") >= 2) & (F.col("after_n") >= 2))


def origin(points: DataFrame) -> DataFrame:
    """recorded if any fix has an accuracy, else imported."""
    return points.groupBy(*TRACK).agg(F.when(F.bool_or(F.col("accuracy").isNotNull()), "recorded").otherwise("imported").alias("origin"))


def purged(tracks: DataFrame, points: DataFrame, cutoff_ms: int) -> tuple[DataFrame, DataFrame]:
    """Both tables without the tracks that were discarded before an instant."""
    gone = F.coalesce(F.col("discarded_at") < cutoff_ms, F.lit(False))
    return tracks.where(~gone), points.join(tracks.where(gone).select(*TRACK), list(TRACK), "left_anti")
