"""Colour ramps of a track's line: which values a metric has, between which anchors, and in which band.

Anchors are round numbers of the units that are shown, so they differ a little
between systems of units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.points import TRACK, band, with_speeds
from waymark.schemas import lookup

# Speeds at the red and the blue end of an activity's ramp, in km/h and in mph.
SPEEDS = {
    "WALKING": ((2.0, 8.0), (1.0, 5.0)),
    "RUNNING": ((6.0, 16.0), (4.0, 10.0)),
    "CYCLING": ((10.0, 34.0), (6.0, 22.0)),
    "DRIVING": ((30.0, 150.0), (20.0, 90.0)),
    "TAXI": ((30.0, 150.0), (20.0, 90.0)),
    "TRANSIT": ((20.0, 220.0), (10.0, 140.0)),
    "FERRY": ((10.0, 50.0), (5.0, 35.0)),
    "FLIGHT": ((200.0, 1000.0), (150.0, 650.0)),
    "STILL": ((2.0, 8.0), (1.0, 5.0)),
    "UNKNOWN": ((30.0, 150.0), (20.0, 90.0)),
}
# The ends of other ramps, in metric and in imperial units; those of elevation are a track's own.
OTHERS = {"accuracy": ((50.0, 0.0), (150.0, 0.0)), "satellites": ((0.0, 12.0), (0.0, 12.0)), "cn0": ((15.0, 45.0), (15.0, 45.0))}
METRICS = ("speed", "elevation", *OTHERS)
#: A track's elevations span this much at least.
FLAT = 1.0
MILE_KM, METRE_FT = 1.609344, 3.28084


def shown_value(metric: str, imperial: bool = False) -> Column:
    """A fix's value of a metric in the units that are shown; speeds need with_speeds. Null where it wasn't measured."""
    column = {"speed": "speed_kmh", "elevation": "alt"}.get(metric, metric)
    value = F.col(column).cast("double")
    if not imperial:
        return value
    return value / F.lit(MILE_KM) if metric == "speed" else value * F.lit(METRE_FT) if metric in ("elevation", "accuracy") else value


def anchors(metric: str, value: Column, imperial: bool = False) -> tuple[Column, Column]:
    """The values at the red and the blue end: by activity for speeds, by what a track's fixes have for elevations."""
    k = int(imperial)
    if metric == "speed":
        return tuple(lookup(F.col("activity"), {a: ends[k][i] for a, ends in SPEEDS.items()}, SPEEDS["UNKNOWN"][k][i]) for i in (0, 1))
    if metric == "elevation":
        track = Window.partitionBy(*TRACK)
        low = F.min(value).over(track)
        return low, low + F.greatest(F.max(value).over(track) - low, F.lit(FLAT))
    red, blue = OTHERS[metric][k]
    return F.lit(red), F.lit(blue)


def ramped(points: DataFrame, metric: str, imperial: bool = False) -> DataFrame:
    """Adds value, red, blue and band (0 to 32) of a metric to points.

    points: device_id, track_id, seq, ts_ms, lat, lon, activity, speed and the
    metric's own column (alt, accuracy, satellites, cn0). An activity that is null or
    not known counts as UNKNOWN. Fixes without a value have no band; a track that has
    no elevation has neither anchors nor bands.
    """
    if metric not in METRICS:
        raise ValueError(f"{metric} is none of {', '.join(METRICS)}")
    p = with_speeds(points) if metric == "speed" and "speed_kmh" not in points.columns else points
    p = p.withColumn("value", shown_value(metric, imperial))
    red, blue = anchors(metric, F.col("value"), imperial)
    p = p.withColumns({"red": red, "blue": blue})
    return p.withColumn("band", F.when(F.col("value").isNotNull(), band(F.col("value"), F.col("red"), F.col("blue"))))


def legends(ramps: DataFrame) -> DataFrame:
    """device_id, track_id, left, middle, right: the whole numbers under each track's ramp; all null for one without values."""
    any_value = F.max(F.col("value").isNotNull()).alias("_any")
    r = ramps.groupBy(*TRACK).agg(any_value, F.max("red").alias("red"), F.max("blue").alias("blue"))
    number = lambda c: F.when(F.col("_any"), F.floor(c + 0.5).cast("long"))
    return r.select(*TRACK, number(F.col("red")).alias("left"), number((F.col("red") + F.col("blue")) / 2).alias("middle"), number(F.col("blue")).alias("right"))
