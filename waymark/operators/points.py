"""Rules over the ordered fixes of a track: distances, speeds, breaks, smoothing, bands, and unreliable fixes.

Points come in order of (ts_ms, seq) within (device_id, track_id).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from waymark.config import Quality
from waymark.functions.arrays import fold_rows, let
from waymark.functions.geo import Distance, haversine_m
from waymark.schemas import ceiling_kmh

TRACK = ("device_id", "track_id")
ORDER = ("ts_ms", "seq")


def in_order() -> WindowSpec:
    return Window.partitionBy(*TRACK).orderBy(*ORDER)


def good(points: DataFrame) -> DataFrame:
    return points.where(~F.col("ignored"))


def with_seams(points: DataFrame, distance: Distance = haversine_m) -> DataFrame:
    """Adds seam_m, the metres from the previous row (0 for the first), and dt_ms, the time since."""
    d = distance(F.lag("lat").over(in_order()), F.lag("lon").over(in_order()), F.col("lat"), F.col("lon"))
    return points.withColumn("seam_m", F.coalesce(d, F.lit(0.0))).withColumn("dt_ms", F.col("ts_ms") - F.lag("ts_ms").over(in_order()))


def with_speeds(points: DataFrame) -> DataFrame:
    """Adds speed_kmh: as reported, else that of the seam, else the last one known, 0 for the first."""
    p = points if "seam_m" in points.columns else with_seams(points)
    own = F.when(F.col("speed") >= 0, F.col("speed") * 3.6).when(F.col("dt_ms") > 0, F.col("seam_m") / (F.col("dt_ms") / F.lit(1000.0)) * 3.6)
    return p.withColumn("speed_kmh", F.coalesce(F.last(own, True).over(in_order()), F.lit(0.0)))


def with_breaks(points: DataFrame) -> DataFrame:
    """All points with break: one on an ignored fix moves on to the next good fix."""
    ahead = Window.partitionBy(*TRACK).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    island = F.coalesce(F.count_if(~F.col("ignored")).over(ahead), F.lit(0))
    p = points.withColumn("island", island)
    broken = F.bool_or("segment_start").over(Window.partitionBy(*TRACK, "island"))
    return p.withColumn("break", ~F.col("ignored") & broken).drop("island")


def carried_breaks(points: DataFrame) -> DataFrame:
    """Good points with break."""
    return good(with_breaks(points))


def stretches(points: DataFrame) -> DataFrame:
    """Adds stretch to points with break: a new number at each break but the first row's."""
    p = points.withColumn("_n", F.row_number().over(in_order()))
    cut = F.when(F.col("break") & (F.col("_n") > 1), 1).otherwise(0)
    return p.withColumn("stretch", F.sum(cut).over(in_order())).drop("_n")


def smoothed(points: DataFrame, value: str, half_ms: int = 7_500) -> DataFrame:
    """Adds smooth: the mean of values within half_ms before and after, in runs without breaks or nulls."""
    is_null = F.col(value).isNull()
    start = F.coalesce(is_null != F.lag(is_null).over(in_order()), F.lit(True)) | F.col("segment_start")
    p = points.withColumn("_run", F.sum(start.cast("int")).over(in_order()))
    near = Window.partitionBy(*TRACK, "_run").orderBy("ts_ms").rangeBetween(-half_ms, half_ms)
    return p.withColumn("smooth", F.avg(value).over(near)).drop("_run")


def band(value: Column, red: float, blue: float, steps: int = 32) -> Column:
    """The colour step of a value between two anchors; null has none."""
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - red) / (blue - red)))
    return F.floor(part * steps + 0.5).cast("int")


def color_runs(points: DataFrame) -> DataFrame:
    """Runs of one colour, of points with band and break: first and last row (1-based), ends included.

    A run starts at a break, or on the last point before its colour starts; it has
    two points at least.
    """
    p = points.withColumn("n", F.row_number().over(in_order())).withColumn("was", F.lag("band").over(in_order()))
    cut = F.col("break") | (F.col("n") == 1)
    new = cut | ~F.col("band").eqNullSafe(F.col("was"))
    p = p.withColumn("_cut", cut).withColumn("run", F.sum(new.cast("int")).over(in_order()))
    runs = p.groupBy(*TRACK, "run").agg(F.min("n").alias("a"), F.max("n").alias("last_row"), F.first("band").alias("band"), F.bool_or("_cut").alias("_cut"))
    runs = runs.withColumn("first_row", F.when(F.col("_cut"), F.col("a")).otherwise(F.col("a") - 1))
    return runs.where("last_row > first_row and band is not null").select(*TRACK, "band", "first_row", "last_row")


def leading_stray(points: DataFrame, rule: Quality = Quality()) -> DataFrame:
    """Tracks with stray: the first fix is off if its seam is fast, and much longer than the next ones."""
    p = with_seams(points).withColumn("n", F.row_number().over(in_order())).where("n <= 5")
    kmh = F.when(F.col("dt_ms") > 0, F.col("seam_m") / (F.col("dt_ms") / F.lit(1000.0)) * 3.6)
    at = lambda k: F.max(F.when(F.col("n") == k, kmh))
    later = F.max(F.when(F.col("n") > 2, kmh))
    g = p.groupBy(*TRACK).agg(F.count("*").alias("rows"), at(2).alias("first_kmh"), later.alias("later_kmh"))
    stray = (F.col("rows") >= 3) & (F.col("first_kmh") >= rule.stray_kmh) & (F.col("first_kmh") >= rule.stray_times * F.col("later_kmh"))
    return g.select(*TRACK, F.coalesce(stray, F.lit(False)).alias("stray"))


def gate_reason(gnss: Column, accuracy: Column, rule: Quality = Quality()) -> Column:
    """Why a fix is unreliable by itself: no_gnss comes before accuracy; null if it isn't."""
    return F.when(~gnss, "no_gnss").when(accuracy >= rule.max_accuracy_m, "accuracy")


def step_kmh(metres: Column, dt_ms: Column, rule: Quality = Quality()) -> Column:
    """A step's speed; without time between, endless beyond a few metres, else 0."""
    no_time = F.when(metres > rule.standing_jump_m, F.lit(float("inf"))).otherwise(F.lit(0.0))
    return F.when(dt_ms > 0, metres / (dt_ms / F.lit(1000.0)) * 3.6).otherwise(no_time)


def raised_ceiling(activity: Column, moving_mps: Column, rule: Quality = Quality()) -> Column:
    """The fastest step that an activity allows; motion that was measured raises it."""
    own = ceiling_kmh(activity)
    return F.greatest(own, F.coalesce(F.least(moving_mps * 3.6 * rule.raised_by, F.lit(rule.raised_most_kmh)), own))


def told(points: DataFrame, fields: list[Column], start: Column, step: Callable[[Column, Column], Column], row: str) -> DataFrame:
    """points with told, what a fold over a track's fixes says of each: made where a track's fixes are, so that nothing is joined back to them.

    A step sees ts_ms, seq and fields, and gives a struct of state and row for each fix, no row null.
    """
    fix = F.struct("ts_ms", "seq", *fields, F.struct(*[c for c in points.columns if c not in TRACK]).alias("all"))
    t = points.groupBy(*TRACK).agg(F.array_sort(F.collect_list(fix)).alias("fixes"))
    t = t.select(*TRACK, "fixes", fold_rows("fixes", start, step, row).alias("told"))
    t = t.select(*TRACK, F.explode(F.arrays_zip("fixes", "told")).alias("x"))
    return t.select(*TRACK, "x.fixes.all.*", "x.told")


def _base() -> Column:
    """No fix yet that a step is measured from."""
    return F.struct(F.lit(None).cast("bigint").alias("ts"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))


def _then(base: Column, fix: Column, where: Column, row: Column) -> Column:
    """What a step gives: the base, or the fix where it is the next one, and the step's row."""
    keep = lambda new, old: F.when(where, new).otherwise(old)
    after = F.struct(keep(fix["ts_ms"], base["ts"]).alias("ts"), keep(fix["lat"], base["lat"]).alias("lat"), keep(fix["lon"], base["lon"]).alias("lon"))
    return F.struct(after.alias("state"), row.alias("row"))


def with_reasons(points: DataFrame, distance: Distance = haversine_m, rule: Quality = Quality()) -> DataFrame:
    """points with reason (no_gnss, accuracy, jump or null).

    A jump is a step from the last good fix that is faster than the activity
    allows, so each verdict depends on those before it: a fold over a track's
    ordered fixes, in the JVM, in blocks, so that it is linear in a track's fixes. A
    track is bounded by one recording.
    """
    own = gate_reason(F.col("satellites") >= 1, F.col("accuracy"), rule)

    def step(acc: Column, x: Column) -> Column:
        kmh = step_kmh(distance(acc["lat"], acc["lon"], x["lat"], x["lon"]), x["ts_ms"] - acc["ts"], rule)
        reason = F.coalesce(x["own"], F.when(acc["ts"].isNotNull() & (kmh > x["most"]), "jump"))
        return let(reason, lambda why: _then(acc, x, why.isNull(), F.struct(why.alias("reason"))))

    t = told(points, [F.col("lat"), F.col("lon"), ceiling_kmh(F.col("activity")).alias("most"), own.alias("own")], _base(), step, "struct<reason:string>")
    return t.withColumn("reason", F.col("told.reason")).drop("told")


def judged(points: DataFrame, distance: Distance = haversine_m, rule: Quality = Quality()) -> DataFrame:
    """One row per fix with its reason: device_id, track_id, seq, reason."""
    p = points.select(*TRACK, "activity", *ORDER, "lat", "lon", "satellites", "accuracy")
    return with_reasons(p, distance, rule).select(*TRACK, "seq", "reason")


def with_restored(judged_points: DataFrame, ceiling: float | Column, distance: Distance = haversine_m) -> DataFrame:
    """points with reason, and with back: whether a higher ceiling (km/h, a number or of each point) takes a jump back.

    Each that comes back becomes the base of the next step. Other ignored fixes are
    passed over; where the ceiling is null none comes back.
    """
    most = ceiling if isinstance(ceiling, Column) else F.lit(float(ceiling))

    def step(acc: Column, x: Column) -> Column:
        base = x["reason"].isNull() | (x["reason"] == "edge_stay")
        fits = acc["ts"].isNull() | (step_kmh(distance(acc["lat"], acc["lon"], x["lat"], x["lon"]), x["ts_ms"] - acc["ts"]) <= x["most"])
        back = F.coalesce((x["reason"] == "jump") & x["most"].isNotNull() & fits, F.lit(False))
        return let(back, lambda back: _then(acc, x, base | back, F.struct(back.alias("back"))))

    t = told(judged_points, [F.col("lat"), F.col("lon"), F.col("reason"), most.alias("most")], _base(), step, "struct<back:boolean>")
    return t.withColumn("back", F.col("told.back")).drop("told")


def restored_jumps(judged_points: DataFrame, ceiling: float | Column, distance: Distance = haversine_m) -> DataFrame:
    """device_id, track_id, seq of the jumps that a higher ceiling takes back."""
    return with_restored(judged_points, ceiling, distance).where("back").select(*TRACK, "seq")


def mean_of_best(cn0: Column, top: int = 4) -> Column:
    """Mean of the strongest positive signals; null without one."""
    best = F.slice(F.sort_array(F.filter(cn0, lambda x: x > 0), False), 1, top)
    return F.when(F.size(best) > 0, F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(best))


def cadence_ms(ts: Column) -> Column:
    """The lower quartile of gaps between fixes, as the element at a quarter; 1 at least."""
    gaps = F.transform(F.sequence(F.lit(1), F.size(ts) - 1), lambda i: F.get(ts, i) - F.get(ts, i - 1))
    ordered = F.array_sort(gaps)
    return F.when(F.size(ts) < 2, F.lit(1)).otherwise(F.greatest(F.lit(1), F.get(ordered, F.floor(F.size(ordered) / 4).cast("int"))))
