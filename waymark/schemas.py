"""Table schemas and closed vocabularies.

Every table starts with device_id: history is ordered within a device, and a
device is the unit that work is partitioned by.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = (
    "device_id long, track_id long, point_id long, ts_ms long, lat double, lon double, alt double, accuracy float, speed float, bearing float, "
    "vertical_accuracy float, speed_accuracy float, bearing_accuracy float, satellites int, cn0 float, ignored boolean, ignore_reason string, segment_start boolean"
)
TRACKS = "device_id long, track_id long, activity string, started_at long, ended_at long, source string, discarded_at long, discard_reason string"
PLACES = "device_id long, place_id long, label string, lat double, lon double, created_at long, radius_m double, category string"
INTERVALS = "device_id long, after_track_id long, kind string, start long, end long, cluster_id long, reason string, from_lat double, from_lon double, to_lat double, to_lon double"

# Activities, their groups, and the fastest step each one allows, in km/h.
ACTIVITIES = {
    "WALKING": ("FOOT", 12.0),
    "RUNNING": ("FOOT", 30.0),
    "CYCLING": ("BIKE", 70.0),
    "DRIVING": ("VEHICLE", 220.0),
    "TAXI": ("VEHICLE", 220.0),
    "TRANSIT": ("VEHICLE", 350.0),
    "FERRY": ("VEHICLE", 120.0),
    "FLIGHT": ("AIR", 1300.0),
    "STILL": ("STILL", 12.0),
    "UNKNOWN": ("UNKNOWN", 220.0),
}

# Categories of places in their order, and the group of each.
CATEGORIES = {
    "friends_family": "home_people",
    "home": "home_people",
    "groceries": "errands",
    "food": "errands",
    "shopping": "errands",
    "services": "errands",
    "health": "errands",
    "kids_school": "routine",
    "sports": "routine",
    "work": "routine",
    "outdoors": "away",
    "sightseeing": "away",
    "travel": "away",
    "entertainment": "away",
    "parking": "transient",
    "transit": "transient",
    "gas_station": "transient",
    "service_area": "transient",
}
# Categories that don't count in totals of time, and those that are no visits.
NOT_IN_TOTALS = ("home", "parking", "transit", "gas_station", "service_area")
NOT_VISITED = ("transit", "gas_station", "service_area")


def lookup(key: Column, values: dict, default) -> Column:
    """A literal map's value, or the default; evaluated in the JVM."""
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def group_of(activity: Column) -> Column:
    return lookup(activity, {k: g for k, (g, _) in ACTIVITIES.items()}, "UNKNOWN")


def ceiling_kmh(activity: Column) -> Column:
    return lookup(activity, {k: c for k, (_, c) in ACTIVITIES.items()}, 220.0)


def in_totals(category: Column) -> Column:
    return category.isNotNull() & ~category.isin(*NOT_IN_TOTALS)
