"""The clocks that rows of a timeline are read on: those of the places where things happened.

The session's time zone has to be UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.intervals import gap_halves, local_date, per_day

SLICE = ("device_id", "kind", "after_track_id", "slice_start", "slice_end", "holds_start", "holds_end", "zone", "end_zone")


def with_zones(rows: DataFrame, place_zones: DataFrame, start: str, end: str, fallback: str = "UTC") -> DataFrame:
    """Adds zone and end_zone to rows: those of the places that two columns name, else the fallback.

    place_zones: device_id, place, zone; one row a place. A place may be a pin or a
    cluster. Places that are null, not listed or without a zone get the fallback.
    """
    of = lambda column, name: place_zones.select("device_id", F.col("place").alias(column), F.col("zone").alias(name))
    names = (("_start_place", start, "_zone"), ("_end_place", end, "_end_zone"))
    out = rows
    for column, place, name in names:
        out = out.withColumn(column, F.col(place)).join(of(column, name).hint("merge"), ["device_id", column], "left")
    out = out.withColumns({"zone": F.coalesce("_zone", F.lit(fallback)), "end_zone": F.coalesce("_end_zone", F.lit(fallback))})
    return out.select(*rows.columns, "zone", "end_zone")


def interval_zones(intervals: DataFrame, place_zones: DataFrame, fallback: str = "UTC") -> DataFrame:
    """Stays and gaps with zone and end_zone: a stay has one place's clock twice, a gap that of each of its sides.

    intervals: device_id, kind, from_place, to_place and other columns. A stay where
    only one side knows its place takes that one.
    """
    stay = F.col("kind") == "STAY"
    one = F.coalesce("from_place", "to_place")
    i = intervals.withColumns({"_from": F.when(stay, one).otherwise(F.col("from_place")), "_to": F.when(stay, one).otherwise(F.col("to_place"))})
    return with_zones(i, place_zones, "_from", "_to", fallback).drop("_from", "_to")


def sliced(zoned: DataFrame, now_ms: Column) -> DataFrame:
    """Slices of stays and gaps on their own clocks: SLICE columns.

    zoned: device_id, kind, after_track_id, start, end, zone, end_zone. A stay is cut
    at each midnight of its zone; an open one lasts until now_ms and stays open on the
    last day. A gap is cut once, at the midnight of its arrival's zone that opens the
    day it ended; each half has the clock of the end it speaks for, and null for the
    other.
    """
    cut = SLICE[:-2]
    stays = per_day(zoned.where("kind = 'STAY'"), now_ms, "zone").select(*cut, "zone", F.col("zone").alias("end_zone"))
    halves = gap_halves(zoned.where("kind = 'GAP'"), "end_zone")
    halves = halves.select(*cut, F.when(F.col("holds_start"), F.col("zone")).alias("zone"), F.when(F.col("holds_end"), F.col("end_zone")).alias("end_zone"))
    return stays.unionByName(halves)


def filed_day(slices: DataFrame) -> DataFrame:
    """Adds day: the civil date that a slice is filed under, on the clock of the end it speaks for.

    A gap's arrival half goes to the day it ends, all else to the day it starts.
    """
    arrival = (F.col("kind") == "GAP") & F.col("holds_end") & ~F.col("holds_start")
    at = F.when(arrival, F.col("slice_end")).otherwise(F.col("slice_start"))
    return slices.withColumn("day", local_date(at, F.coalesce(F.when(arrival, F.col("end_zone")).otherwise(F.col("zone")), F.lit("UTC"))))
