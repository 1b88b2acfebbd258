"""Stays and gaps between neighbouring tracks, and their slices on the local calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.config import DAY_MS, Stays
from waymark.functions.geo import Distance, haversine_m
from waymark.operators.tracks import by_start


def between_tracks(ends: DataFrame) -> DataFrame:
    """One row per track and its successor: where one ended and the other began.

    ends: device_id, track_id, started_at, ended_at, start_lat, start_lon, end_lat,
    end_lon, and optionally start_pin, end_pin, start_cluster, end_cluster.
    """
    nxt = lambda c, name: F.lead(c).over(by_start()).alias(name)
    more = [c for c in ("pin", "cluster") if f"end_{c}" in ends.columns]
    cols = [F.col(f"end_{c}").alias(f"from_{c}") for c in more] + [nxt(f"start_{c}", f"to_{c}") for c in more]
    pairs = ends.select("device_id", F.col("track_id").alias("after_track_id"), nxt("track_id", "next_id"), F.col("ended_at").alias("start"), nxt("started_at", "end"), F.col("end_lat").alias("from_lat"), F.col("end_lon").alias("from_lon"), nxt("start_lat", "to_lat"), nxt("start_lon", "to_lon"), *cols)
    return pairs.where("next_id is not null")


def verdicts(pairs: DataFrame, rule: Stays = Stays(), distance: Distance = haversine_m) -> DataFrame:
    """Adds kind (STAY, GAP or NONE) and reason to pairs.

    The same place is the same cluster, or within the agreement radius, or the same
    pin. Nothing lies between tracks that overlap, nor in no time unless they agree.
    """
    known = F.col("from_lat").isNotNull() & F.col("to_lat").isNotNull()
    same = distance(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon")) <= rule.agreement_m
    for c in ("cluster", "pin"):
        if f"from_{c}" in pairs.columns:
            same = same | F.coalesce(F.col(f"from_{c}") == F.col(f"to_{c}"), F.lit(False))
    agree = known & F.coalesce(same, F.lit(False))
    none = (F.col("end") < F.col("start")) | (~agree & (F.col("end") == F.col("start")))
    kind = F.when(none, "NONE").when(agree, "STAY").otherwise("GAP")
    reason = F.when(F.col("kind") == "GAP", F.when(known, "MOVED_UNRECORDED").otherwise("UNKNOWN_ENDPOINT"))
    return pairs.withColumn("kind", kind).withColumn("reason", reason)


def tail(ends: DataFrame, status: DataFrame, now_ms: int) -> DataFrame:
    """The stay that goes on after the last track of each device.

    status: device_id, disarmed_since, active_start (both nullable). While a track
    is being recorded the stay ends where that began; without one it is open, or
    ends when recording was switched off.
    """
    last = ends.groupBy("device_id").agg(F.max_by(F.struct("track_id", "ended_at", "end_lat", "end_lon"), F.struct("ended_at", "track_id")).alias("t"))
    t = last.select("device_id", "t.*").where("end_lat is not null").join(status, "device_id", "left")
    rec = F.col("active_start").isNotNull()
    end = F.when(rec, F.col("active_start")).otherwise(F.greatest("disarmed_since", F.when(F.col("disarmed_since").isNotNull(), F.col("ended_at"))))
    shown = F.when(rec, F.col("active_start") > F.col("ended_at")).otherwise(F.col("ended_at") <= now_ms)
    return t.where(shown).select("device_id", F.col("track_id").alias("after_track_id"), F.col("ended_at").alias("start"), end.alias("end"))


def local_date(ms: Column, zone: Column | None = None) -> Column:
    """The civil date of an instant, in a zone or in UTC."""
    ts = F.timestamp_millis(ms)
    return F.to_date(ts if zone is None else F.from_utc_timestamp(ts, zone))


def midnight_ms(date: Column, zone: Column | None = None) -> Column:
    """The instant at which a civil date starts in a zone, or in UTC."""
    ts = date.cast("timestamp")
    return F.unix_millis(ts if zone is None else F.to_utc_timestamp(ts, zone))


def per_day(stays: DataFrame, now_ms: Column, zone: str | None = None) -> DataFrame:
    """Stays cut at the midnights of their zone: a row per local day, with holds_start and holds_end.

    An open end stays open on the last day. The session's time zone has to be UTC.
    """
    z = F.col(zone) if zone else None
    to = F.coalesce(F.col("end"), now_ms)
    # a stay that ends at midnight doesn't reach the next day
    last = F.when(to > F.col("start"), to - 1).otherwise(to)
    days = F.sequence(local_date(F.col("start"), z), F.greatest(local_date(last, z), local_date(F.col("start"), z)))
    s = stays.withColumn("day", F.explode(days))
    opens, closes = midnight_ms(F.col("day"), z), midnight_ms(F.date_add("day", 1), z)
    is_last = closes >= to
    s = s.withColumn("slice_start", F.greatest("start", opens)).withColumn("slice_end", F.when(is_last, F.col("end")).otherwise(closes))
    return s.withColumn("holds_start", F.col("slice_start") == F.col("start")).withColumn("holds_end", is_last)


def gap_halves(gaps: DataFrame, zone: str | None = None) -> DataFrame:
    """Gaps cut once, at the midnight that opens the day they ended; none if they began after it."""
    cut = midnight_ms(local_date(F.col("end"), F.col(zone) if zone else None), F.col(zone) if zone else None)
    whole = F.struct(F.col("start").alias("slice_start"), F.col("end").alias("slice_end"), F.lit(True).alias("holds_start"), F.lit(True).alias("holds_end"))
    first = F.struct(F.col("start").alias("slice_start"), cut.alias("slice_end"), F.lit(True).alias("holds_start"), F.lit(False).alias("holds_end"))
    second = F.struct(cut.alias("slice_start"), F.col("end").alias("slice_end"), F.lit(False).alias("holds_start"), F.lit(True).alias("holds_end"))
    parts = F.when(cut <= F.col("start"), F.array(whole)).otherwise(F.array(first, second))
    return gaps.withColumn("part", F.explode(parts)).select(*gaps.columns, "part.*")


def timeline(tracks: DataFrame, slices: DataFrame) -> DataFrame:
    """Tracks and slices as rows: device_id, kind, ref_id, at, until, rank, filed_at.

    Newest first, at one instant an open interval, then the track, then a closed
    one. A gap's arrival half is filed where it ends, all else where it starts.
    """
    t = tracks.select("device_id", F.lit("TRACK").alias("kind"), F.col("track_id").alias("ref_id"), F.col("started_at").alias("at"), F.col("ended_at").alias("until"), F.lit(1).alias("rank"), F.col("started_at").alias("filed_at"))
    arrival = (F.col("kind") == "GAP") & F.col("holds_end") & ~F.col("holds_start")
    s = slices.select("device_id", "kind", F.col("after_track_id").alias("ref_id"), F.col("slice_start").alias("at"), F.col("slice_end").alias("until"), F.when(F.col("slice_end").isNull(), 0).otherwise(2).alias("rank"), F.when(arrival, F.col("slice_end")).otherwise(F.col("slice_start")).alias("filed_at"))
    return t.unionByName(s)


def day_groups(rows: DataFrame) -> DataFrame:
    """Runs of one filing date, newest first; a date that comes back is another group."""
    w = Window.partitionBy("device_id").orderBy(F.desc("at"), "rank", "ref_id", "filed_at")
    d = rows.withColumn("day", local_date(F.col("filed_at")))
    new = F.coalesce(F.col("day") != F.lag("day").over(w), F.lit(True)).cast("int")
    d = d.withColumn("group_no", F.sum(new).over(w))
    return d.groupBy("device_id", "group_no", "day").agg(F.count("*").alias("items"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def overlap_ms(a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(b1, b2) - F.greatest(a1, a2))


def overlap_join(left: DataFrame, right: DataFrame, bucket_ms: int = DAY_MS) -> DataFrame:
    """Pairs of a device's intervals [a, b) of left and [c, d) of right that share time.

    Both sides go to the buckets of time that they touch, so that the join is by
    equal keys; a pair is taken in the bucket where its overlap starts.
    """
    bucket = lambda c: F.floor(F.col(c) / bucket_ms)
    x = left.withColumn("_bucket", F.explode(F.sequence(bucket("a"), F.greatest(bucket("a"), bucket("b")))))
    y = right.withColumn("_bucket", F.explode(F.sequence(bucket("c"), F.greatest(bucket("c"), bucket("d")))))
    j = x.join(y.hint("merge"), ["device_id", "_bucket"]).where("a < d and c < b").where(F.col("_bucket") == F.floor(F.greatest("a", "c") / bucket_ms))
    return j.drop("_bucket")
