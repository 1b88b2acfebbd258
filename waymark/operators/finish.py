"""What happens to a recording when it ends, is imported, is cut, or its rules change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.config import BRIEF, Dwell, Edge, Keep
from waymark.functions.geo import Distance, haversine_m
from waymark.operators import dwells, points, tracks
from waymark.operators.points import TRACK

#: Kept on a track that was made with rules of an older version; such tracks are finished again.
RULE_VERSION = 1


def finished(trips: DataFrame, fixes: DataFrame, edge: Edge = Edge(), dwell: Dwell = BRIEF, keep: Keep = Keep(), distance: Distance = haversine_m) -> tuple[DataFrame, DataFrame]:
    """(tracks, fixes): stops at the edges are ignored, then bounds, statistics and the verdict are taken of what is left."""
    settled = dwells.settled(fixes, edge, dwell)
    t = trips.drop("from_ms", "to_ms").join(tracks.bounds(trips, settled).hint("merge"), list(TRACK)).join(tracks.stats(settled, distance).hint("merge"), list(TRACK))
    t = t.withColumn("seconds", (F.col("to_ms") - F.col("from_ms")) / F.lit(1000.0))
    return t.withColumn("verdict", tracks.verdict(t, keep)).withColumn("rule_version", F.lit(RULE_VERSION)), settled


def split(fixes: DataFrame, cuts: DataFrame) -> DataFrame:
    """Fixes with those from a track's cut on moved to a new track; cuts: device_id, track_id, cut, new_id.

    A cut that leaves a half with fewer than two good fixes is no cut.
    """
    legal = tracks.split_plans(fixes, cuts.select(*TRACK, "cut")).where("legal").select(*TRACK)
    c = cuts.join(legal, list(TRACK), "left_semi").select(*TRACK, "cut", "new_id")
    f = fixes.join(c, list(TRACK), "left")
    return f.withColumn("track_id", F.when(F.col("ts_ms") >= F.col("cut"), F.col("new_id")).otherwise(F.col("track_id"))).drop("cut", "new_id")


def closed(trips: DataFrame, fixes: DataFrame) -> DataFrame:
    """Open tracks ended at their last fix, or where they started."""
    last = fixes.groupBy(*TRACK).agg(F.max("ts_ms").alias("_last"))
    t = trips.join(last, list(TRACK), "left")
    return t.withColumn("ended_at", F.coalesce("ended_at", "_last", "started_at")).drop("_last")


def manual(drafts: DataFrame, fixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tracks, fixes) of drafts that overlap no recorded time: two fixes each, at both ends.

    drafts: device_id, cand_id, activity, from_ms, to_ms, from_lat, from_lon, to_lat, to_lon.
    """
    free = tracks.overlapping(drafts.select("device_id", "cand_id", "from_ms", "to_ms"), fixes).where("overlaps = 0")
    d = drafts.where("to_ms > from_ms").join(free.select("device_id", "cand_id"), ["device_id", "cand_id"], "left_semi")
    t = d.select("device_id", F.col("cand_id").alias("track_id"), "activity", F.lit("manual").alias("source"), F.col("from_ms").alias("started_at"), F.col("to_ms").alias("ended_at"))
    end = lambda n, side: F.struct(F.lit(n).alias("seq"), F.col(f"{side}_ms").alias("ts_ms"), F.col(f"{side}_lat").alias("lat"), F.col(f"{side}_lon").alias("lon"))
    p = d.select("device_id", F.col("cand_id").alias("track_id"), "activity", F.explode(F.array(end(0, "from"), end(1, "to"))).alias("x")).select("device_id", "track_id", "activity", "x.*")
    return t, p.withColumn("ignored", F.lit(False)).withColumn("segment_start", F.lit(False))


def replayed(fixes: DataFrame, gap_ms: int = 60_000, times: int = 30) -> DataFrame:
    """Good fixes with play_ms: when each is shown if gaps are cut to a minute and time runs faster."""
    w = points.in_order()
    step = F.least(F.lit(gap_ms), F.col("ts_ms") - F.lag("ts_ms").over(w))
    p = points.good(fixes).withColumn("_step", F.coalesce(step, F.lit(0)))
    return p.withColumn("play_ms", F.floor(F.sum("_step").over(w) / times)).drop("_step")
