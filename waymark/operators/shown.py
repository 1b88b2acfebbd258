"""What lists and maps show of a history: filters, labels, sections and drawn lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.config import Stays
from waymark.functions.geo import arc
from waymark.operators import dwells, points
from waymark.operators.intervals import overlap_join
from waymark.operators.points import TRACK

#: Visits that a place needs so as not to be rare.
RARE = 3


def on_map(places: DataFrame, show_rare: bool) -> DataFrame:
    """Places (label, visits) that a map shows: named or visited, and often enough unless rare ones are shown."""
    return places.where((F.col("label").isNotNull() | (F.col("visits") > 0)) & (F.lit(show_rare) | (F.col("visits") >= RARE)))


def without_bare_seams(stays: DataFrame, offers: DataFrame) -> DataFrame:
    """Stays but those of no time without an offer to merge; offers: device_id, track_id of the track before."""
    o = offers.select("device_id", F.col("track_id").alias("after_track_id"), F.lit(True).alias("_offer"))
    return stays.join(o, ["device_id", "after_track_id"], "left").where("end is null or end != start or _offer").drop("_offer")


def reportable(ms: Column, rule: Stays = Stays()) -> Column:
    """A duration that is long enough to be told, else null."""
    return F.when(ms >= rule.reportable_ms, ms)


def brief_stops(stays: DataFrame, offers: DataFrame, key: list[str]) -> DataFrame:
    """Places without a name (key, label, after_track_id) with exactly one stay, which has an offer to merge."""
    o = offers.select("device_id", F.col("track_id").alias("after_track_id"))
    only = stays.groupBy(*key).agg(F.count("*").alias("_n"), F.max("label").alias("_label"), F.max("after_track_id").alias("after_track_id"))
    return only.where("_n = 1 and _label is null").join(o, ["device_id", "after_track_id"], "left_semi").select(*key)


def gap_sides(halves: DataFrame) -> DataFrame:
    """Adds from_shown and to_shown to halves of gaps: the origin where a gap starts, the destination where it ends."""
    return halves.withColumns({"from_shown": F.col("holds_start"), "to_shown": F.col("holds_end")})


def midnights(start: Column, end: Column, zone: Column | None = None) -> Column:
    """Midnights between two instants, in a zone or in UTC."""
    day = lambda c: F.to_date(F.from_utc_timestamp(F.timestamp_millis(c), zone) if zone is not None else F.timestamp_millis(c))
    return F.date_diff(day(end), day(start))


def month_reach(months: DataFrame, now_month: Column, selected: Column, *key: str) -> DataFrame:
    """first, last and shown month (as numbers) of those that there are, up to now; back and forward: whether a step is possible."""
    m = months.groupBy(*key).agg(F.min("month").alias("first"), F.greatest(F.max("month"), now_month).alias("last"))
    m = m.withColumn("shown", F.least("last", F.greatest("first", selected)))
    return m.withColumns({"back": F.col("shown") > F.col("first"), "forward": F.col("shown") < F.col("last")})


def zone_shift_minutes(ms: Column, zone: Column, other: Column) -> Column:
    """By how many minutes a zone's clock is ahead of another's at an instant."""
    at = F.timestamp_millis(ms)
    local = lambda z: F.unix_micros(F.from_utc_timestamp(at, z))
    return F.floor((local(zone) - local(other)) / 60_000_000).cast("int")


def derivation_instant(tracks: DataFrame, exported_at: Column, *key: str) -> DataFrame:
    """The instant that open intervals last until: when a history was exported, else its last end."""
    return tracks.groupBy(*key).agg(F.coalesce(F.max(exported_at), F.max("ended_at")).alias("instant"))


def color_modes(fixes: DataFrame, tracks: DataFrame) -> DataFrame:
    """device_id, track_id, modes: by what a track can be coloured, in order: what its good fixes carry.

    Imported tracks have no quality of a recorder's fixes, those made by hand no speed.
    """
    carried = fixes.where(~F.col("ignored")).groupBy(*TRACK).agg(*[F.bool_or(F.col(c).isNotNull()).alias(c) for c in ("alt", "accuracy", "satellites", "cn0") if c in fixes.columns])
    t = tracks.select(*TRACK, "source").join(carried, list(TRACK), "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in carried.columns else F.lit(False)
    recorded = F.col("source") == "recorded"
    each = [("speed", F.col("source") != "manual"), ("elevation", has("alt")), ("accuracy", recorded & has("accuracy")), ("satellites", recorded & has("satellites")), ("cn0", recorded & has("cn0"))]
    return t.select(*TRACK, F.array_compact(F.array(*[F.when(ok, F.lit(name)) for name, ok in each])).alias("modes"))


def import_counts(candidates: DataFrame) -> DataFrame:
    """imported, duplicate and overlapping of candidates (duplicate, overlaps), and failed: those with fewer than two timed fixes."""
    ok = F.col("fixes") >= 2
    n = lambda c, name: F.count_if(c).alias(name)
    return candidates.groupBy("device_id").agg(n(ok & ~F.col("duplicate") & ~F.col("overlaps"), "imported"), n(ok & F.col("duplicate"), "duplicate"), n(ok & ~F.col("duplicate") & F.col("overlaps"), "overlapping"), n(~ok, "failed"))


def city_sections(spent: DataFrame, *key: str) -> DataFrame:
    """Countries by the time spent in their cities, and each one's cities by theirs: country_rank, city_rank.

    spent: key, country, city, ms. Ties are by name.
    """
    s = spent.withColumn("_sum", F.sum("ms").over(Window.partitionBy(*key, "country")))
    by_country = Window.partitionBy(*key).orderBy(F.desc("_sum"), "country")
    by_city = Window.partitionBy(*key, "country").orderBy(F.desc("ms"), "city")
    return s.withColumns({"country_rank": F.dense_rank().over(by_country), "city_rank": F.row_number().over(by_city)}).drop("_sum")


def trip_drafts(gaps: DataFrame) -> DataFrame:
    """Drafts of trips by hand for gaps with both ends known: ends, times and the labels of the places there."""
    g = gaps.where("kind = 'GAP' and from_lat is not null and to_lat is not null")
    return g.select("device_id", "after_track_id", F.col("start").alias("from_ms"), F.col("end").alias("to_ms"), "from_lat", "from_lon", "to_lat", "to_lon", "from_label", "to_label")


def manual_arcs(fixes: DataFrame) -> DataFrame:
    """Lines of tracks made by hand, as great circles from each fix to the next: track_id, n, lat, lon; joints come once."""
    w = points.in_order()
    p = points.good(fixes).select(*TRACK, "ts_ms", "seq", "lat", "lon", F.lag("lat").over(w).alias("_y"), F.lag("lon").over(w).alias("_x"))
    line = F.when(F.col("_y").isNull(), F.array(F.struct("lat", "lon"))).otherwise(F.slice(arc(F.col("_y"), F.col("_x"), F.col("lat"), F.col("lon")), F.lit(2), F.lit(1000)))
    p = p.select(*TRACK, "ts_ms", "seq", F.posexplode(line).alias("k", "x"))
    n = F.row_number().over(Window.partitionBy(*TRACK).orderBy("ts_ms", "seq", "k"))
    return p.select(*TRACK, n.alias("n"), "x.lat", "x.lon")


def journey_lines(windows: DataFrame, tracks: DataFrame, fixes: DataFrame, tolerance: float = 2e-5) -> DataFrame:
    """device_id, first_night, track_id, stretch, seq: fixes of the thinned lines of a journey's tracks, by stretch."""
    w = windows.select("device_id", "first_night", F.col("a").alias("c"), F.col("b").alias("d"))
    t = overlap_join(tracks.select(*TRACK, F.col("started_at").alias("a"), F.col("ended_at").alias("b")), w).select(*TRACK, "first_night")
    f = points.stretches(points.carried_breaks(fixes.join(t.select(*TRACK).distinct().hint("merge"), list(TRACK), "left_semi")))
    # each stretch is a line of its own
    kept = dwells.simplified(f, tolerance, (*TRACK, "stretch"))
    return t.join(kept.hint("merge"), list(TRACK)).select("device_id", "first_night", "track_id", "stretch", "seq")


def draw_split(fixes: DataFrame) -> DataFrame:
    """Adds part: path, rejected, or overrun (fixes ignored beyond the first or last good one), and run, which numbers each part's runs."""
    whole = Window.partitionBy(*TRACK)
    bounds = {name: f(F.when(~F.col("ignored"), F.col("ts_ms"))).over(whole) for name, f in (("_first", F.min), ("_last", F.max))}
    beyond = F.coalesce((F.col("ts_ms") < F.col("_first")) | (F.col("ts_ms") > F.col("_last")), F.lit(False))
    p = fixes.withColumns(bounds).withColumn("part", F.when(~F.col("ignored"), "path").when(beyond, "overrun").otherwise("rejected"))
    new = ~F.col("part").eqNullSafe(F.lag("part").over(points.in_order()))
    return p.withColumn("run", F.sum(new.cast("int")).over(points.in_order())).drop("_first", "_last")

