"""A track as columns: one row a track, an array a measure, and its line at several resolutions.

What draws a track reads the arrays of its geometry and its lines, what colours it
those of its measures; Parquet reads only the columns that are asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.dwells import line_places
from waymark.operators.points import TRACK, with_breaks

# The byte of each reason for which a fix is ignored; 0 is none.
REASONS = {"accuracy": 1, "jump": 2, "no_gnss": 3, "edge_stay": 4}
#: Tolerances of a track's lines in degrees, finest first.
LEVELS = (1e-4, 1e-3)
#: Measures that become arrays beside the geometry, where points have them.
MEASURES = ("alt", "speed", "accuracy", "satellites", "cn0")


def reason_byte(ignored: Column, reason: Column) -> Column:
    """The byte of a reason; ignored fixes whose reason is null or not known have that of accuracy."""
    code = F.lit(REASONS["accuracy"])
    for name, value in REASONS.items():
        code = F.when(reason == name, F.lit(value)).otherwise(code)
    return F.when(ignored, code).otherwise(F.lit(0)).cast("tinyint")


def packed(points: DataFrame, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """device_id, track_id, fixes, time, seq, lat, lon, measures, breaks, reasons, bbox, lines: a row a track.

    points: device_id, track_id, seq, ts_ms, lat, lon, activity, speed, ignored,
    segment_start and, if there, ignore_reason and MEASURES; other columns are left
    out. Arrays are in order of (ts_ms, seq) and hold ignored fixes too; a break on an
    ignored fix moves to the next good one. bbox is that of good fixes, null without
    any. lines has, for each level, the lines of the stretches of two good fixes or
    more, each as positions in the arrays; levels without a line are empty. A track
    without fixes has no row; one recording is held whole by its task.
    """
    reason = F.col("ignore_reason") if "ignore_reason" in points.columns else F.lit(None).cast("string")
    measures = [m for m in MEASURES if m in points.columns]
    p = with_breaks(points).withColumn("_reason", reason_byte(F.col("ignored"), reason))
    fix = F.struct("ts_ms", "seq", "lat", "lon", *measures, F.col("break"), F.col("_reason").alias("reason"))
    rows = p.groupBy(*TRACK).agg(F.array_sort(F.collect_list(fix)).alias("f"))
    good = F.filter("f", lambda x: x["reason"] == 0)
    edge = lambda f, c: f(F.transform(good, lambda x: x[c]))
    box = F.struct(edge(F.array_min, "lat").alias("south"), edge(F.array_min, "lon").alias("west"), edge(F.array_max, "lat").alias("north"), edge(F.array_max, "lon").alias("east"))
    rows = rows.select(*TRACK, F.size("f").alias("fixes"), F.col("f.ts_ms").alias("time"), F.col("f.seq").alias("seq"), *[F.col(f"f.{c}").alias(c) for c in ("lat", "lon", *measures)], F.col("f.break").alias("breaks"), F.col("f.reason").alias("reasons"), F.when(F.size(good) > 0, box).alias("bbox"))
    return rows.withColumn("lines", lines(levels)("lat", "lon", "breaks", "reasons"))


def lines(levels: tuple[float, ...]):
    """A function of a track's arrays that gives its lines; beside them no more of the track goes to Python, and no row moves."""

    @F.arrow_udf("array<array<array<int>>>")
    def of_tracks(lat: pa.Array, lon: pa.Array, breaks: pa.Array, reasons: pa.Array) -> pa.Array:
        ends = np.cumsum(lat.value_lengths().to_numpy(zero_copy_only=False)).tolist()
        y, x, cut, why = (c.flatten().to_numpy(zero_copy_only=False).tolist() for c in (lat, lon, breaks, reasons))
        at, out = 0, []
        for end in ends:
            good = [i for i in range(at, end) if not why[i]]
            # a stretch starts at each break but the first good fix's
            cuts = [0, *(k for k in range(1, len(good)) if cut[good[k]]), len(good)]
            parts = [good[a:b] for a, b in zip(cuts, cuts[1:]) if b - a > 1]
            places = [([y[i] for i in p], [x[i] for i in p]) for p in parts]
            out.append([[[p[k] - at for k in line_places(*yx, t)] for p, yx in zip(parts, places)] for t in levels])
            at = end
        return pa.array(out, pa.list_(pa.list_(pa.list_(pa.int32()))))

    return of_tracks


def unpacked(columns: DataFrame) -> DataFrame:
    """The fixes of packed tracks: device_id, track_id, seq, ts_ms, lat, lon, measures, ignored, ignore_reason, break."""
    measures = [m for m in MEASURES if m in columns.columns]
    each = F.arrays_zip("time", "seq", "lat", "lon", *measures, "breaks", "reasons")
    x = columns.select(*TRACK, F.inline(each))
    name = F.lit(None).cast("string")
    for reason, code in REASONS.items():
        name = F.when(F.col("reasons") == code, reason).otherwise(name)
    return x.select(*TRACK, "seq", F.col("time").alias("ts_ms"), "lat", "lon", *measures, (F.col("reasons") > 0).alias("ignored"), name.alias("ignore_reason"), F.col("breaks").alias("break"))
