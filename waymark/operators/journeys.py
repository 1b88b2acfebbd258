"""Journeys: nights away from home, the runs they form, and what a journey covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from waymark.config import DAY_MS, Journeys
from waymark.functions.geo import haversine_m
from waymark.operators.intervals import overlap_join
from waymark.operators.points import good

HOME, AWAY, UNKNOWN = "HOME", "AWAY", "UNKNOWN"


def solar_offset_ms(lon: Column) -> Column:
    """How far solar time at a longitude is ahead of UTC: half up to a second, 18 hours at most."""
    s = F.floor(lon / 15 * 3600 + 0.5)
    return (F.greatest(F.lit(-64_800), F.least(F.lit(64_800), s)) * 1000).cast("long")


def nights(spans: DataFrame, rule: Journeys = Journeys()) -> DataFrame:
    """spans: device_id, first_at, last_at, offset_ms. One row per night hour in them: night (day number), at."""
    day = lambda c: F.floor((F.col(c) + F.col("offset_ms")) / DAY_MS)
    n = spans.withColumn("night", F.explode(F.sequence(day("first_at"), day("last_at"))))
    n = n.withColumn("at", (F.col("night") * DAY_MS + rule.night_hour * 3_600_000 - F.col("offset_ms")).cast("long"))
    return n.where("at between first_at and last_at").select("device_id", "night", "at")


def night_places(nights: DataFrame, intervals: DataFrame, tracks: DataFrame, points: DataFrame, home: DataFrame) -> DataFrame:
    """Adds place: HOME, AWAY or UNKNOWN.

    intervals: device_id, kind, start, end (null if open), from_home, to_home; home:
    device_id, lat, lon, radius_m. A stay counts by its own place, a gap if both
    sides agree; a night on the move is where the track's good fixes around it say.
    """
    side = F.when(F.col("from_home"), HOME).otherwise(AWAY)
    value = F.when(F.col("kind") == "STAY", side).when(F.col("from_home") == F.col("to_home"), side).otherwise(UNKNOWN)
    i = intervals.where("kind in ('STAY', 'GAP')").select("device_id", F.col("start").alias("a"), F.coalesce("end", F.lit(1 << 60)).alias("b"), "kind", value.alias("value"))
    # an interval without an end is joined by itself: it has no last bucket
    n = nights.select("device_id", "night", F.col("at").alias("c"), (F.col("at") + 1).alias("d"))
    closed = overlap_join(i.where(F.col("b") < 1 << 59), n)
    ended = i.where(F.col("b") >= 1 << 59).join(n.hint("merge"), "device_id").where("a <= c")
    still = closed.select("device_id", "night", "value").unionByName(ended.select("device_id", "night", "value"))
    still = still.groupBy("device_id", "night").agg(F.min("value").alias("value"))
    moving = overlap_join(tracks.select("device_id", "track_id", F.col("started_at").alias("a"), (F.col("ended_at") + 1).alias("b")), n)
    p = good(points).select("device_id", "track_id", "ts_ms", "seq", "lat", "lon")
    m = moving.select("device_id", "track_id", "night", F.col("c").alias("at")).join(p.hint("merge"), ["device_id", "track_id"])
    fix = F.struct("ts_ms", "seq", "lat", "lon")
    m = m.groupBy("device_id", "track_id", "night", "at").agg(F.max(F.when(F.col("ts_ms") <= F.col("at"), fix)).alias("x"), F.min(F.when(F.col("ts_ms") >= F.col("at"), fix)).alias("y"))
    m = m.where("x is not null and y is not null")
    part = F.when(F.col("y.ts_ms") > F.col("x.ts_ms"), (F.col("at") - F.col("x.ts_ms")) / (F.col("y.ts_ms") - F.col("x.ts_ms"))).otherwise(F.lit(0.0))
    lat, lon = (F.col(f"x.{c}") + (F.col(f"y.{c}") - F.col(f"x.{c}")) * part for c in ("lat", "lon"))
    m = m.select("device_id", "night", lat.alias("lat"), lon.alias("lon")).join(home.select("device_id", F.col("lat").alias("h_lat"), F.col("lon").alias("h_lon"), "radius_m").hint("merge"), "device_id")
    m = m.groupBy("device_id", "night").agg(F.min(F.when(haversine_m(F.col("lat"), F.col("lon"), F.col("h_lat"), F.col("h_lon")) <= F.col("radius_m"), HOME).otherwise(AWAY)).alias("moving"))
    out = nights.join(still.hint("merge"), ["device_id", "night"], "left").join(m.hint("merge"), ["device_id", "night"], "left")
    return out.select("device_id", "night", "at", F.coalesce("value", "moving", F.lit(UNKNOWN)).alias("place"))


def runs(night_places: DataFrame) -> DataFrame:
    """Journeys: between nights at home, from the first night away to the last; unknown ones are bridged."""
    w = Window.partitionBy("device_id").orderBy("night").rowsBetween(Window.unboundedPreceding, 0)
    n = night_places.withColumn("block", F.count_if(F.col("place") == HOME).over(w)).where(F.col("place") == AWAY)
    j = n.groupBy("device_id", "block").agg(F.min("night").alias("first_night"), F.max("night").alias("last_night"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("away_nights"))
    return j.withColumn("nights", F.col("last_night") - F.col("first_night") + 1).drop("block")


def days_covered(journeys: DataFrame) -> DataFrame:
    """One row per day: from the day before the first night's date to the last night's date, in UTC."""
    first = F.floor((F.col("first_at") - DAY_MS) / DAY_MS)
    return journeys.select("device_id", "first_night", F.explode(F.sequence(first, F.floor(F.col("last_at") / DAY_MS))).alias("day"))


def windows(journeys: DataFrame, home_stays: DataFrame, now_ms: int) -> DataFrame:
    """Adds a and b: when the device left home before a journey and came back after it.

    home_stays: device_id, start, end. The last one ended before the first night and
    the first one started after the last; the window stays within a day of both nights.
    """
    # neighbours in time: stays' ends before a journey's first night, their starts after its last
    past = Window.partitionBy("device_id").orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("device_id").orderBy(F.desc("at"), "rank").rowsBetween(Window.unboundedPreceding, 0)

    def nearest(of: str, stay: str, window: WindowSpec, name: str) -> DataFrame:
        asked = journeys.select("device_id", F.col(of).alias("at"), F.lit(1).alias("rank"), F.lit(None).cast("long").alias("found"), "first_night")
        known = home_stays.select("device_id", F.col(stay).alias("at"), F.lit(0).alias("rank"), F.col(stay).alias("found"), F.lit(None).cast(journeys.schema["first_night"].dataType).alias("first_night"))
        rows = asked.unionByName(known.where("at is not null")).withColumn("found", F.last("found", True).over(window))
        return rows.where("first_night is not null").select("device_id", "first_night", F.col("found").alias(name))

    left = nearest("first_at", "end", past, "left_home")
    back = nearest("last_at", "start", ahead, "reached_home")
    j = journeys.join(left.hint("merge"), ["device_id", "first_night"]).join(back.hint("merge"), ["device_id", "first_night"])
    day = lambda c, n: (F.floor(F.col(c) / DAY_MS) + n) * DAY_MS
    a = F.greatest("left_home", day("first_at", -1))
    b = F.least(F.coalesce("reached_home", F.lit(now_ms)), day("last_at", 1))
    return j.withColumn("a", a).withColumn("b", b)


def time_by_place(windows: DataFrame, stays: DataFrame) -> DataFrame:
    """Per journey and place, the time that stays spend in its window; stays: device_id, place, start, end."""
    s = stays.select("device_id", "place", F.col("start").alias("a"), F.col("end").alias("b"))
    w = windows.select("device_id", "first_night", F.col("a").alias("c"), F.col("b").alias("d"))
    both = overlap_join(s, w).withColumn("ms", F.least("b", "d") - F.greatest("a", "c"))
    return both.groupBy("device_id", "first_night", "place").agg(F.sum("ms").alias("ms"), F.count("*").alias("stays"))


def journey_slice(windows: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (device_id, kind, ref_id, at, until) in a journey's window: stays are cut to it, others whole; none of no time."""
    r = rows.select("device_id", "kind", "ref_id", F.col("at").alias("a"), F.col("until").alias("b"))
    w = windows.select("device_id", "first_night", F.col("a").alias("c"), F.col("b").alias("d"))
    j = overlap_join(r, w)
    stay = F.col("kind") == "STAY"
    cut = j.select("device_id", "first_night", "kind", "ref_id", F.when(stay, F.greatest("a", "c")).otherwise(F.col("a")).alias("at"), F.when(stay, F.least("b", "d")).otherwise(F.col("b")).alias("until"))
    return cut.where("until > at")


def names(times: DataFrame, rule: Journeys = Journeys()) -> DataFrame:
    """Per journey the names to show: those of two hours or more, longest first, else the longest one.

    times: device_id, first_night, name, ms.
    """
    w = Window.partitionBy("device_id", "first_night").orderBy(F.desc("ms"), "name")
    n = times.withColumn("n", F.row_number().over(w)).where((F.col("ms") >= rule.name_floor_ms) | (F.col("n") == 1))
    return n.groupBy("device_id", "first_night").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]).alias("names"))


def spent(windows: DataFrame, stays: DataFrame, moves: DataFrame) -> DataFrame:
    """Per journey the time at each name and in each city: device_id, first_night, kind (name or city), key, ms.

    stays: device_id, start, end, name, city, visited; moves (tracks): device_id,
    start, end, and name and city of both ends as start_name, end_name, start_city,
    end_city. A place that is no visit counts for neither; a move counts where both
    its ends have the same name, and the same city.
    """
    w = windows.select("device_id", "first_night", F.col("a").alias("c"), F.col("b").alias("d"))
    kinds = lambda name, city: F.explode(F.array(F.struct(F.lit("name").alias("kind"), name.alias("key")), F.struct(F.lit("city").alias("kind"), city.alias("key"))))
    both = lambda c: F.when(F.col(f"start_{c}") == F.col(f"end_{c}"), F.col(f"start_{c}"))
    at = stays.where("visited").select("device_id", F.col("start").alias("a"), F.col("end").alias("b"), kinds(F.col("name"), F.col("city")).alias("x"))
    on = moves.select("device_id", F.col("start").alias("a"), F.col("end").alias("b"), kinds(both("name"), both("city")).alias("x"))
    rows = at.unionByName(on).select("device_id", "a", "b", "x.*").where("key is not null")
    j = overlap_join(rows, w).withColumn("ms", F.least("b", "d") - F.greatest("a", "c"))
    return j.groupBy("device_id", "first_night", "kind", "key").agg(F.sum("ms").alias("ms"))


def by_year(journeys: DataFrame) -> DataFrame:
    """Journeys and nights per year of the first covered day."""
    year = F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor((F.col("first_at") - DAY_MS) / DAY_MS).cast("int")))
    return journeys.groupBy("device_id", year.alias("year")).agg(F.count("*").alias("journeys"), F.sum("nights").alias("nights"))


def nights_by_place(nights: DataFrame, stays: DataFrame) -> DataFrame:
    """How many night hours fall into closed stays at each place; stays: device_id, place, start, end."""
    s = stays.where("end is not null").select("device_id", "place", F.col("start").alias("a"), F.col("end").alias("b"))
    n = nights.select("device_id", F.col("at").alias("c"), (F.col("at") + 1).alias("d"))
    return overlap_join(s, n).groupBy("device_id", "place").agg(F.count("*").alias("nights"))


def home_of(nights_by_place: DataFrame) -> DataFrame:
    """The place with most nights, the first one on ties."""
    return nights_by_place.groupBy("device_id").agg(F.max_by("place", F.struct("nights", -F.col("place"))).alias("place"))
