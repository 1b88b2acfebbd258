"""What the last fixes say of motion, and what follows from it: window functions, no Python.

The live processor in ``waymark.streaming`` keeps the same windows as state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.config import Live
from waymark.functions.arrays import fold_rows
from waymark.functions.geo import Distance, haversine_m
from waymark.operators.points import TRACK, in_order

MOVING, STOPPED, UNKNOWN = "MOVING", "STOPPED", "UNKNOWN"
#: Carrier evidence: credit of one pair of samples at most, and what proves a carrier.
CREDIT_MS, STILL_PROVES_MS, MOVING_PROVES_MS = 35_000, 60_000, 120_000
ARRIVAL_MS = 240_000


def verdicts(points: DataFrame, span_ms: int | None = None, rule: Live = Live(), distance: Distance = haversine_m) -> DataFrame:
    """Adds motion and motion_mps to points: by the fixes up to each one, as old as twice the span at most.

    Moving if the means of the earlier and the later half are far apart, stopped if
    all fixes are near the oldest; neither with few fixes or too short a span.
    """
    span = span_ms or int(rule.span_s * 1000)
    age = max(60_000, 2 * span)
    near = Window.partitionBy(*TRACK).orderBy("ts_ms").rangeBetween(-age, 0)
    p = points.withColumn("_w", F.collect_list(F.struct("ts_ms", "seq", "lat", "lon")).over(near))
    # fixes of the same instant count in order: those after this one don't yet
    p = p.withColumn("_w", F.array_sort(F.filter("_w", lambda x: (x["ts_ms"] < F.col("ts_ms")) | (x["seq"] <= F.col("seq")))))
    n, half = F.size("_w"), F.floor(F.size("_w") / 2).cast("int")

    def mean(name: str, late: bool) -> Column:
        part = F.slice("_w", half + 1, n - half) if late else F.slice("_w", F.lit(1), half)
        total = F.aggregate(part, F.lit(0.0), lambda a, x: a + x[name])
        return total / F.when(F.size(part) > 0, F.size(part))

    moved = distance(mean("lat", False), mean("lon", False), mean("lat", True), mean("lon", True))
    seconds = (F.floor(mean("ts_ms", True)) - F.floor(mean("ts_ms", False))) / F.lit(1000.0)
    first = F.get("_w", 0)
    close = F.forall("_w", lambda x: distance(first["lat"], first["lon"], x["lat"], x["lon"]) <= rule.still_m)
    enough = (n >= rule.min_fixes) & (F.get("_w", n - 1)["ts_ms"] - first["ts_ms"] >= span)
    p = p.withColumn("_m", F.when(enough, moved)).withColumn("_s", seconds)
    far = F.col("_m") >= rule.moving_m
    motion = F.when(F.col("_m").isNull(), UNKNOWN).when(far & (F.col("_s") > 0), MOVING).when(~far & close, STOPPED).otherwise(UNKNOWN)
    return p.withColumn("motion", motion).withColumn("motion_mps", F.when(F.col("motion") == MOVING, F.col("_m") / F.col("_s"))).drop("_w", "_m", "_s")


def carrier_evidence(samples: DataFrame, ceiling_mps: Column) -> DataFrame:
    """Per track how long the ground moved while the body was still, or faster than its activity can.

    samples: points with motion, motion_mps and still_parked. Two samples in a row
    that agree are credited with the time between them, up to a bound.
    """
    w = in_order()
    moving = F.col("motion") == MOVING
    s = samples.withColumn("_still", moving & F.col("still_parked")).withColumn("_fast", moving & (F.col("motion_mps") > ceiling_mps))
    credit = F.least(F.col("ts_ms") - F.lag("ts_ms").over(w), F.lit(CREDIT_MS))
    for name in ("_still", "_fast"):
        s = s.withColumn(f"{name}_ms", F.when(F.coalesce(F.col(name) & F.lag(name).over(w), F.lit(False)), credit).otherwise(0))
    e = s.groupBy(*TRACK).agg(F.sum("_still_ms").alias("still_ms"), F.sum("_fast_ms").alias("moving_ms"))
    return e.withColumn("proven", (F.col("still_ms") >= STILL_PROVES_MS) | (F.col("moving_ms") >= MOVING_PROVES_MS))


def arrivals(points: DataFrame, resume_ms: int = 180_000) -> DataFrame:
    """Standstills that last: since_ms is when each began, at_ms the fix that settled it.

    A stop opens with the first stopped fix, unknown ones keep it open, a moving one
    ends it; after it has fired, the next stopped fix opens another.
    """
    wait = max(resume_ms, ARRIVAL_MS)
    w = in_order()
    p = points.withColumn("_run", F.sum((F.col("motion") == MOVING).cast("int")).over(w))
    fix = F.struct("ts_ms", "seq", (F.col("motion") == STOPPED).alias("stop"))
    runs = p.where(F.col("motion") != MOVING).groupBy(*TRACK, "_run").agg(F.array_sort(F.collect_list(fix)).alias("fixes"))
    start = F.struct(F.lit(None).cast("bigint").alias("since"))

    def step(acc: Column, x: Column) -> tuple[Column, Column]:
        since = F.coalesce(acc["since"], F.when(x["stop"], x["ts_ms"]))
        fires = F.coalesce(x["ts_ms"] - since >= wait, F.lit(False))
        return F.struct(F.when(~fires, since).alias("since")), F.when(fires, F.struct(since.alias("since_ms"), x["ts_ms"].alias("at_ms")))

    rows = fold_rows("fixes", start, step, "struct<since_ms:bigint,at_ms:bigint>")
    return runs.select(*TRACK, F.explode(rows).alias("x")).select(*TRACK, "x.*")


#: How old the last satellite fix may be, least confidence of a snapshot, oldest reading that is live.
GNSS_MS, LEAST_CONFIDENCE = 5_000, 50


def gnss_backed(last_gnss_ms: Column, fix_ms: Column) -> Column:
    """Whether satellites stand behind a fix: the last satellite fix is recent, or none was ever heard of (0)."""
    return (last_gnss_ms == 0) | (fix_ms - last_gnss_ms <= GNSS_MS)


def with_gnss(points: DataFrame) -> DataFrame:
    """Adds gnss to points: by the last fix with satellites up to each one of its track."""
    last = F.max(F.when(F.col("satellites") >= 1, F.col("ts_ms"))).over(in_order())
    return points.withColumn("gnss", gnss_backed(F.coalesce(last, F.lit(0)), F.col("ts_ms")))


def interpreted(activity: Column, enters: Column) -> Column:
    """What a transition says: entering an activity is that activity, leaving one that moves is STILL, else nothing."""
    return F.when(enters, activity).when(~activity.isin("STILL", "UNKNOWN"), "STILL")


def confirmed(activity: Column, confidence: Column, had_transition: Column) -> Column:
    """Whether a snapshot of the activity counts: known, sure enough, and before the first transition."""
    return ~had_transition & (confidence >= LEAST_CONFIDENCE) & (activity != "UNKNOWN")


def proves_deaf(event_ms: Column, reading_ms: Column, last_ms: Column, armed_ms: Column, now_ms: Column, stale_ms: int = 300_000, advance_ms: int = 0) -> Column:
    """Whether a reading shows that earlier ones didn't get through: it is late, and newer than the last one and than arming."""
    return event_ms.isNotNull() & (reading_ms > last_ms + advance_ms) & (reading_ms > armed_ms) & (now_ms - reading_ms > stale_ms)


def card_state(armed: Column, tracking: Column, recording: Column, paused: Column, suspended: Column, points: Column, has_track: Column, set_up: Column) -> Column:
    """What the recorder's card shows."""
    state = (
        F.when(~armed, "STATS_ONLY")
        .when(recording & has_track & (points >= 2), "LIVE_MAP")
        .when(recording & suspended, "NO_GPS_SIGNAL")
        .when(recording, "WAITING_FOR_GPS")
        .when(tracking & paused, "PAUSED")
        .when(tracking, "WAITING_FOR_MOVEMENT")
        .otherwise("STARTING")
    )
    return F.when(set_up | (state == "LIVE_MAP"), state).otherwise("SETUP")
