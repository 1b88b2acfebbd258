"""Names: folding, matching, keys, and codes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def fold_text(names: pd.Series) -> pd.Series:
    """Trimmed, lower case, without accents."""
    bare = lambda s: "".join(c for c in unicodedata.normalize("NFD", s.strip().lower()) if unicodedata.category(c) != "Mn")
    return names.map(bare, na_action="ignore")


def holds(name: Column, needle: Column) -> Column:
    """Whether a folded name holds a folded needle; a blank one is in nothing."""
    n = fold_text(needle)
    return (n != "") & fold_text(name).contains(n)


def place_key(place_id: Column, lat: Column, lon: Column) -> Column:
    """place:<id> of a named place, else cluster:<lat>,<lon> with 5 decimals."""
    return F.when(place_id.isNotNull(), F.concat(F.lit("place:"), place_id.cast("string"))).otherwise(F.format_string("cluster:%.5f,%.5f", lat, lon))


def title(names: Column) -> Column:
    """Up to three names joined by dots, else the first two and the number of others."""
    dot = " · "
    rest = F.concat(F.lit(" +"), (F.size(names) - 2).cast("string"))
    return F.when(F.size(names) <= 3, F.array_join(names, dot)).otherwise(F.concat(F.array_join(F.slice(names, 1, 2), dot), rest))


def activity_of_gpx(kind: Column) -> Column:
    """An activity out of a GPX track's type: its own name, or what the type speaks of, else driving."""
    k = F.upper(F.coalesce(kind, F.lit("")))
    own = k.isin("WALKING", "RUNNING", "CYCLING", "DRIVING", "TAXI", "TRANSIT", "FERRY", "FLIGHT", "STILL", "UNKNOWN")
    return (
        F.when(own, k)
        .when(k.contains("WALK") | k.contains("HIK"), "WALKING")
        .when(k.contains("RUN") | k.contains("JOG"), "RUNNING")
        .when(k.contains("CYCL") | k.contains("BIK"), "CYCLING")
        .when(k.contains("FERR") | k.contains("BOAT"), "FERRY")
        .otherwise("DRIVING")
    )


def activity_of_detection(code: Column) -> Column:
    """An activity out of a detector's constant."""
    return (
        F.when(code == "IN_VEHICLE", "DRIVING")
        .when(code == "ON_BICYCLE", "CYCLING")
        .when(code == "RUNNING", "RUNNING")
        .when(code.isin("WALKING", "ON_FOOT"), "WALKING")
        .when(code == "STILL", "STILL")
        .otherwise("UNKNOWN")
    )


def duration(ms: Column) -> Column:
    """Minutes and hours up to a day, then days and hours, then months and days, then years and months."""
    m = F.floor(ms / 60_000)
    two = lambda a, x, b, y: F.concat_ws(" ", F.concat(a.cast("string"), F.lit(x)), F.when(b > 0, F.concat(b.cast("string"), F.lit(y))))
    h, d = F.floor(m / 60), F.floor(m / 1440)
    return (
        F.when(m < 60, F.concat(m.cast("string"), F.lit(" min")))
        .when(d < 1, two(h, " h", m % 60, " min"))
        .when(d < 30, two(d, " d", h % 24, " h"))
        .when(d < 365, two(F.floor(d / 30), " mo", d % 30, " d"))
        .otherwise(two(F.floor(d / 365), " y", F.floor(d % 365 / 30), " mo"))
    )


def length(metres: Column, imperial: bool = False) -> Column:
    """Metres or kilometres, feet or miles."""
    unit, small, large, per = (F.lit(3.28084), " ft", " mi", 5280.0) if imperial else (F.lit(1.0), " m", " km", 1000.0)
    x = metres * unit
    return F.when(x < per / (10 if imperial else 1), F.concat(F.floor(x + 0.5).cast("string"), F.lit(small))).otherwise(F.concat(F.format_string("%.1f", x / per), F.lit(large)))


def stay_bounds(holds_start: Column, holds_end: Column, start: Column, end: Column) -> Column:
    """How a day's slice of a stay is worded: all_day, since, until, from, at or between."""
    return (
        F.when(~holds_start & ~holds_end, "all_day")
        .when(~holds_end, F.when(end.isNull(), "since").otherwise("from"))
        .when(end.isNull(), "since")
        .when(~holds_start, "until")
        .when(start == end, "at")
        .otherwise("between")
    )
