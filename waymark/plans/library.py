"""Registered queries over what an owner changes in a history, and over what lists and maps show of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo, text
from waymark.operators import cities, intervals, library, motion, places, shown, totals, tracks
from waymark.plans.catalog import MERGE, NOW_MS, place_names
from waymark.plans.ctes import BY_FIX, DAY, TRACK, haversine
from waymark.plans.history import History
from waymark.plans.registry import KEY, long, query, r
from waymark.schemas import NOT_IN_TOTALS

#: Tracks shorter than this are discarded here when they end.
SHORT_M = 500


def with_discards(h: History) -> DataFrame:
    t = h.tracks.withColumn("discarded_at", F.lit(None).cast("long")).withColumn("discard_reason", F.lit(None).cast("string"))
    short = h.ends.where(F.col("distance_m") < SHORT_M).select(*KEY, F.col("ended_at").alias("at"), F.lit("short").alias("reason"))
    return library.discarded(t, short)


@query(
    f"""select {TRACK}, state, row_number() over (partition by device_id, state order by started_at desc, track_id desc) as rank, case when state = 'discarded' then 'short' end as discard_reason,
      case when state = 'discarded' then greatest(0, 14 - floor(({NOW_MS} - ended_at) / {DAY}::double)::bigint) end as days_left from (select *, case when distance_m < {SHORT_M} then 'discarded' else 'kept' end as state from ends)"""
)
def track_lists(h: History) -> DataFrame:
    """Kept and discarded tracks, newest first, and how long the latter are still there."""
    t = library.newest_first(with_discards(h))
    left = F.when(F.col("state") == "discarded", library.days_left(F.col("discarded_at"), F.lit(NOW_MS)))
    return t.select(*KEY, "state", long("rank"), "discard_reason", left.cast("long").alias("days_left"))


@query(f"select device_id, case when distance_m < {SHORT_M} and source != 'imported' then 'discarded' else 'kept' end as state, count(*) as tracks from ends group by all")
def restored_tracks(h: History) -> DataFrame:
    """Short tracks are discarded, and imported ones of them restored."""
    t = library.restored(with_discards(h), h.tracks.where("source = 'imported'"))
    return library.listed(t).groupBy("device_id", "state").agg(F.count("*").alias("tracks"))


@query("select device_id, case activity when 'WALKING' then 'FERRY' else activity end as activity, count(*) as tracks from trk group by all")
def retyped_tracks(h: History) -> DataFrame:
    """Walks that were crossings."""
    change = h.tracks.where("activity = 'WALKING'").select(*KEY, F.lit("FERRY").alias("activity"))
    t, _ = library.retyped(h.tracks, h.points.withColumn("ignore_reason", F.lit(None).cast("string")), change)
    return t.groupBy("device_id", "activity").agg(F.count("*").alias("tracks"))


@query("select device_id, count(*) as fixes from pts join (select track_id as id from trk where source != 'imported') on id = track_id group by all")
def deleted_tracks(h: History) -> DataFrame:
    """Fixes that are left when imported tracks are deleted."""
    return library.without(h.points, h.tracks.where("source = 'imported'")).groupBy("device_id").agg(F.count("*").alias("fixes"))


EDITED = "(select device_id, place_id, case label when 'Work' then 'Office' else label end as label, lat, lon, case label when 'Work' then 99e0 else radius_m end as radius_m, category from pins union all select distinct device_id, device_id * 10 + 9, 'Cafe', 38.5e0, -9e0, 50e0, 'food' from pins)"


def edited_pins(h: History) -> DataFrame:
    none = F.lit(None).cast("double")
    work = h.pins.where("label = 'Work'").select("device_id", "place_id", F.lit("Office").alias("label"), none.alias("lat"), none.alias("lon"), F.lit(99.0).alias("radius_m"), F.lit(None).cast("string").alias("category"))
    new = h.pins.select("device_id", (F.col("device_id") * 10 + 9).alias("place_id"), F.lit("Cafe").alias("label"), F.lit(38.5).alias("lat"), F.lit(-9.0).alias("lon"), F.lit(50.0).alias("radius_m"), F.lit("food").alias("category")).distinct()
    return library.edited(h.pins, work.unionByName(new))


@query(f"select device_id, place_id, label, round(lat, 6) as lat, round(lon, 6) as lon, radius_m, category from {EDITED}")
def edited_places(h: History) -> DataFrame:
    return edited_pins(h).select("device_id", "place_id", "label", r("lat", 6), r("lon", 6), "radius_m", "category")


@query(f"select a.device_id, a.place_id, b.place_id as same_id from {EDITED} a join pins b on a.device_id = b.device_id and a.label is not distinct from b.label and a.lat = b.lat and a.lon = b.lon and a.radius_m = b.radius_m")
def same_places(h: History) -> DataFrame:
    """Places that say the same before and after the edits."""
    return library.says_same(edited_pins(h), h.pins)


@query(
    f"""select coalesce(c.device_id, p.device_id) as device_id, coalesce(c.place_id, p.place_id) as place_id, case when p.place_id is null then 'orphaned' else 'missing' end as state
    from (select distinct b.device_id, p.place_id from best b join pins p on p.device_id = b.device_id and p.seed_index = b.b.pin where p.label != 'Home') c full join (select device_id, place_id from {EDITED} where label != 'Gym') p on c.device_id = p.device_id and c.place_id = p.place_id
    where c.place_id is null or p.place_id is null"""
)
def seed_repairs(h: History) -> DataFrame:
    """Clusters were derived before the edits, and Gym was deleted since; Home's cluster was lost."""
    of = h.pins.where("label != 'Home'").select("device_id", F.col("seed_index").alias("pin"), "place_id")
    return library.seeds_off(h.end_pins.join(of, ["device_id", "pin"]), edited_pins(h).where("label != 'Gym'"))


@query(
    """select device_id, pin, sum(visits)::bigint as visits, sum(ms)::bigint as spent_ms from (select device_id, pin, -1 as visits, "start" - "end" as ms from pstay union all select device_id, case pin when 2 then 1 else pin end, 1, "end" - "start" from pstay)
    group by all having sum(visits) != 0 or sum(ms) != 0"""
)
def ledger_deltas(h: History) -> DataFrame:
    """What changes when all stays at the third place turn out to have been at the second."""
    s = h.pin_stays.select("device_id", "pin", "start", "end")
    return library.deltas(s, s.withColumn("pin", F.when(F.col("pin") == 2, 1).otherwise(F.col("pin"))), ["device_id", "pin"])


@query(
    f"""select p.device_id, p.place_id as ask_id, coalesce(k.place_id, q.place_id, -1) as place_id from pins p left join (select * from {EDITED} where label != 'Gym') k on k.device_id = p.device_id and k.label = p.label
      left join (select * from pins where label != 'Gym') q on q.device_id = p.device_id and q.seed_index = p.seed_index"""
)
def reacquired_places(h: History) -> DataFrame:
    """Which place is shown after the edits, for one that was before: by label, else by pin."""
    new = edited_pins(h).where("label != 'Gym'").join(h.pins.select("device_id", "place_id", F.col("seed_index").alias("pin")), ["device_id", "place_id"], "left")
    asked = h.pins.select("device_id", F.col("place_id").alias("ask_id"), F.col("label").alias("key"), F.col("seed_index").alias("pin"), F.lit(-1).cast("long").alias("previous"))
    return library.reacquired(asked, new.select("device_id", F.col("label").alias("key"), "pin", "place_id"))


@query(f"select device_id, place_id, row_number() over (partition by device_id order by {haversine('38.05e0', '-8.97e0', 'lat', 'lon')}, place_id) as rank from pins where contains(lower(label), 'o')")
def saved_search(h: History) -> DataFrame:
    """Saved places whose name holds an o, nearest to a map's centre first."""
    p = library.proximity_search(h.pins, text.holds(F.col("label"), F.lit("Ó")), 38.05, -8.97)
    return p.select("device_id", "place_id", long("rank"))


@query("""select device_id, place_id, visits from (select p.device_id, p.place_id, count(s.after_track_id) as visits from pins p left join pstay s on s.device_id = p.device_id and s.place_id = p.place_id and s."end" != s."start" group by all) where visits >= 3""")
def map_places(h: History) -> DataFrame:
    s = places.summaries(h.pin_stays.select("device_id", "pin", "start", "end"), h.pins, NOW_MS)
    return shown.on_map(s, False).select("device_id", "place_id", "visits")


@query(f"""select device_id, after_track_id from ivl i left join (select device_id as d, track_id as t from {MERGE} where gap_ms between 0 and 300000 and alike) m on m.d = i.device_id and m.t = i.after_track_id where kind = 'STAY' and ("end" != "start" or t is not null)""")
def stays_listed(h: History) -> DataFrame:
    return shown.without_bare_seams(h.stays, tracks.merge_plans(h.tracks)).select("device_id", "after_track_id")


@query("""select device_id, after_track_id, case when "end" - "start" >= 60000 then "end" - "start" end as ms, "end" // 86400000 - "start" // 86400000 as midnights from ivl where kind = 'STAY'""")
def stay_lengths(h: History) -> DataFrame:
    """How long stays lasted, where that is told, and the midnights that they crossed."""
    return h.stays.select("device_id", "after_track_id", shown.reportable(F.col("end") - F.col("start")).alias("ms"), shown.midnights(F.col("start"), F.col("end")).cast("long").alias("midnights"))


@query(
    f"""select device_id, y, x from (select device_id, floor(from_lat * 5000)::bigint as y, floor(from_lon * 5000)::bigint as x, count(*) as n, max(after_track_id) as after_track_id from ivl where kind = 'STAY' group by all) s
    where n = 1 and exists (select 1 from {MERGE} m where m.device_id = s.device_id and m.track_id = s.after_track_id and gap_ms between 0 and 300000 and alike)"""
)
def brief_stops(h: History) -> DataFrame:
    """Cells of a grid with one stay, between tracks that can be one."""
    at = lambda c: F.floor(F.col(c) * 5000)
    s = h.stays.select("device_id", at("from_lat").alias("y"), at("from_lon").alias("x"), F.lit(None).cast("string").alias("label"), "after_track_id")
    return shown.brief_stops(s, tracks.merge_plans(h.tracks), ["device_id", "y", "x"])


@query("select device_id, after_track_id, slice_start, holds_start as from_shown, holds_end as to_shown from halves where kind = 'GAP'")
def gap_sides(h: History) -> DataFrame:
    g = shown.gap_sides(intervals.gap_halves(h.intervals.where("kind = 'GAP'")))
    return g.select("device_id", "after_track_id", "slice_start", "from_shown", "to_shown")


@query(
    """select device_id, first, last, shown, shown > first as back, shown < last as forward from (select *, least(last, greatest(first, 24288)) as shown from (
      select device_id, min(m) as first, greatest(max(m), 24289) as last from (select device_id, year(make_timestamp(started_at * 1000)) * 12 + month(make_timestamp(started_at * 1000)) - 1 as m from trk) group by all))"""
)
def month_reach(h: History) -> DataFrame:
    m = h.tracks.select("device_id", totals.month_of(F.col("started_at")).cast("long").alias("month"))
    return shown.month_reach(m, F.lit(24289).cast("long"), F.lit(24288).cast("long"), "device_id")


@query("select device_id, max(ended_at) as instant from trk group by all")
def derivation_instants(h: History) -> DataFrame:
    return shown.derivation_instant(h.tracks, F.lit(None).cast("long"), "device_id")


@query(
    f"""select {TRACK}, list_concat(['speed'], case when source = 'recorded' and a then ['accuracy'] else [] end, case when source = 'recorded' and s then ['satellites'] else [] end) as modes
    from trk left join (select device_id as d, track_id as t, bool_or(accuracy is not null) as a, bool_or(satellites is not null) as s from pts where not ignored group by all) on d = device_id and t = track_id"""
)
def color_modes(h: History) -> DataFrame:
    return shown.color_modes(h.points, h.tracks)


IMPORTS = "case when good_count < 9 then 1 else good_count end"


@query(
    f"""select device_id, count(*) filter (where f >= 2 and not d and not o) as imported, count(*) filter (where f >= 2 and d) as duplicate, count(*) filter (where f >= 2 and not d and o) as overlapping, count(*) filter (where f < 2) as failed
    from (select device_id, {IMPORTS} as f, source = 'imported' as d, activity = 'RUNNING' as o from ends) group by all"""
)
def import_counts(h: History) -> DataFrame:
    """Accounts of an import in which imported tracks are there already, runs overlap, and tracks with bad fixes have one left."""
    f = F.when(F.col("good_count") < 9, 1).otherwise(F.col("good_count"))
    return shown.import_counts(h.ends.select("device_id", f.alias("fixes"), (F.col("source") == "imported").alias("duplicate"), (F.col("activity") == "RUNNING").alias("overlaps")))


@query(
    """select device_id, country, city, ms, dense_rank() over (partition by device_id order by total desc, country) as country_rank, row_number() over (partition by device_id, country order by ms desc, city) as city_rank
    from (select *, sum(ms) over (partition by device_id, country) as total from (select s.device_id, c.country, c.city, sum(s."end" - s."start")::bigint as ms from pstay s join pcity c on c.place_id = s.place_id group by all))"""
)
def city_sections(h: History) -> DataFrame:
    """Where each device's time at places was spent, by country and city."""
    c = cities.named(h.pins, h.atlas, geo.sphere_m).select("device_id", F.col("seed_index").alias("pin"), "city", "country")
    s = h.pin_stays.select("device_id", "pin", "start", "end").join(c.hint("merge"), ["device_id", "pin"])
    t = s.groupBy("device_id", "country", "city").agg(F.sum(F.col("end") - F.col("start")).alias("ms"))
    return shown.city_sections(t, "device_id").withColumn("country_rank", long("country_rank")).withColumn("city_rank", long("city_rank"))


@query(
    """select i.device_id, i.after_track_id, "start" as from_ms, "end" as to_ms, a.label as from_label, b.label as to_label from pivl i left join pins a on a.device_id = i.device_id and a.seed_index = i.from_pin left join pins b on b.device_id = i.device_id and b.seed_index = i.to_pin
    where kind = 'GAP' and from_lat is not null and to_lat is not null"""
)
def trip_drafts(h: History) -> DataFrame:
    label = lambda side: h.pins.select("device_id", F.col("seed_index").alias(f"{side}_pin"), F.col("label").alias(f"{side}_label"))
    g = h.pin_intervals.join(label("from"), ["device_id", "from_pin"], "left").join(label("to"), ["device_id", "to_pin"], "left")
    return shown.trip_drafts(g).select("device_id", "after_track_id", "from_ms", "to_ms", "from_label", "to_label")


@query(f"select {TRACK}, row_number() over ({BY_FIX}) as n, round(lat, 6) as lat, round(lon, 6) as lon from pts where not ignored")
def track_arcs(h: History) -> DataFrame:
    """Each track drawn as if made by hand; steps of less than a thousandth of a radian are straight."""
    return shown.manual_arcs(h.points).select(*KEY, long("n"), r("lat", 6), r("lon", 6))


@query()
def journey_lines(h: History) -> DataFrame:
    return shown.journey_lines(h.windows, h.tracks, h.points, 1e-4)


@query(
    f"""select {TRACK}, seq::bigint as seq, part, (sum(case when part is distinct from was then 1 else 0 end) over ({BY_FIX}))::bigint as run from (select *, lag(part) over ({BY_FIX}) as was from (
      select *, case when not ignored then 'path' when ts_ms < a or ts_ms > b then 'overrun' else 'rejected' end as part from (select *, min(case when not ignored then ts_ms end) over (partition by {TRACK}) as a, max(case when not ignored then ts_ms end) over (partition by {TRACK}) as b from pts)))"""
)
def draw_parts(h: History) -> DataFrame:
    return shown.draw_split(h.points).select(*KEY, long("seq"), "part", long("run"))


@query(
    f"""select w.device_id, w.first_night, 'activity' as kind, t.activity as key, count(*) as n, sum(t.ended_at - t.started_at)::bigint as ms, round(sum(t.distance_m), 3) as metres from win w join ends t on t.device_id = w.device_id and t.started_at < w.b and w.a < t.ended_at group by all
    union all select w.device_id, w.first_night, 'category', s.category, count(*), sum(least(s."end", w.b) - greatest(s."start", w.a))::bigint, null from win w join pstay s on s.device_id = w.device_id and s."start" < w.b and w.a < s."end" where s.category not in ({", ".join(f"'{c}'" for c in NOT_IN_TOTALS)}) group by all"""
)
def journey_totals(h: History) -> DataFrame:
    """Per journey what its tracks and stays sum up to, by activity and by category; stays are cut to the window."""
    w = h.windows.select("device_id", "first_night", F.col("a").alias("c"), F.col("b").alias("d"))
    t = h.ends.select("device_id", F.col("started_at").alias("a"), F.col("ended_at").alias("b"), F.col("activity").alias("key"), "distance_m")
    s = h.pin_stays.where(~F.col("category").isin(*NOT_IN_TOTALS)).select("device_id", F.col("start").alias("a"), F.col("end").alias("b"), F.col("category").alias("key"))
    key = ["device_id", "first_night"]
    moved = intervals.overlap_join(t, w).groupBy(*key, F.lit("activity").alias("kind"), "key").agg(F.count("*").alias("n"), F.sum(F.col("b") - F.col("a")).alias("ms"), F.round(F.sum("distance_m"), 3).alias("metres"))
    stayed = intervals.overlap_join(s, w).groupBy(*key, F.lit("category").alias("kind"), "key").agg(F.count("*").alias("n"), F.sum(F.least("b", "d") - F.greatest("a", "c")).alias("ms"), F.lit(None).cast("double").alias("metres"))
    return moved.unionByName(stayed)


@query(
    f"""select j.device_id, j.year, j.journeys, j.nights, coalesce(c.cities, 0) as cities, coalesce(c.countries, 0) as countries from (select device_id, year(make_timestamp((first_at - {DAY}) * 1000)) as year, count(*) as journeys, sum(nights)::bigint as nights from jrn group by all) j
    left join (select w.device_id, year(make_timestamp((w.first_at - {DAY}) * 1000)) as year, count(distinct n.city) as cities, count(distinct n.country) as countries from win w join pstay s on s.device_id = w.device_id and s."start" < w.b and w.a < s."end" join pname n on n.device_id = s.device_id and n.pin = s.pin group by all) c
      on c.device_id = j.device_id and c.year = j.year"""
)
def year_sections(h: History) -> DataFrame:
    """Journeys by the year of their first day: how many, their nights, the distinct cities and countries of their stays."""
    year = F.year(F.timestamp_millis(F.col("first_at") - DAY)).cast("long").alias("year")
    j = h.journeys.groupBy("device_id", year).agg(F.count("*").alias("journeys"), F.sum("nights").alias("nights"))
    s = h.pin_stays.select("device_id", "pin", F.col("start").alias("a"), F.col("end").alias("b")).join(place_names(h).hint("merge"), ["device_id", "pin"])
    w = h.windows.select("device_id", year, F.col("a").alias("c"), F.col("b").alias("d"))
    c = intervals.overlap_join(s, w).groupBy("device_id", "year").agg(F.count_distinct("city").alias("cities"), F.count_distinct("country").alias("countries"))
    zero = lambda k: F.coalesce(k, F.lit(0)).alias(k)
    return j.join(c.hint("merge"), ["device_id", "year"], "left").select("device_id", "year", "journeys", "nights", zero("cities"), zero("countries"))


@query(f"select {TRACK}, seq::bigint as seq, coalesce(last, 0) = 0 or ts_ms - coalesce(last, 0) <= 5000 as gnss from (select *, max(case when satellites >= 1 then ts_ms end) over ({BY_FIX}) as last from pts)")
def gnss_backing(h: History) -> DataFrame:
    return motion.with_gnss(h.points).select(*KEY, long("seq"), "gnss")


@query(
    f"""select {TRACK}, seq::bigint as seq, case when not segment_start then activity when activity not in ('STILL', 'UNKNOWN') then 'STILL' end as said, not ignored and accuracy >= 50 and activity != 'UNKNOWN' as counts,
      coalesce(speed is not null and ts_ms > lag(ts_ms) over ({BY_FIX}) and ts_ms > started and until - ts_ms > 300000, false) as deaf,
      case when segment_start and not (seq >= 2 and not ignored and satellites > 0) then 'SETUP' when ignored then 'STATS_ONLY' when satellites > 0 and seq >= 2 then 'LIVE_MAP' when satellites > 0 and accuracy >= 50 then 'NO_GPS_SIGNAL' when satellites > 0 then 'WAITING_FOR_GPS' when satellites = 0 and accuracy >= 50 then 'PAUSED' else 'WAITING_FOR_MOVEMENT' end as card
    from (select *, min(ts_ms) over (partition by {TRACK}) as started, max(ts_ms) over (partition by {TRACK}) as until from pts)"""
)
def recorder_rules(h: History) -> DataFrame:
    """Rules of a live recorder, each asked with a recording's columns."""
    w, whole = Window.partitionBy(*KEY).orderBy("ts_ms", "seq"), Window.partitionBy(*KEY)
    ts, sat, poor = F.col("ts_ms"), F.col("satellites") > 0, F.col("accuracy") >= 50
    deaf = motion.proves_deaf(F.col("speed"), ts, F.lag("ts_ms").over(w), F.min("ts_ms").over(whole), F.max("ts_ms").over(whole))
    card = motion.card_state(~F.col("ignored"), F.lit(True), sat, ~sat & poor, poor, F.col("seq"), F.lit(True), ~F.col("segment_start"))
    said = motion.interpreted(F.col("activity"), ~F.col("segment_start"))
    counts = motion.confirmed(F.col("activity"), F.col("accuracy"), F.col("ignored"))
    return h.points.select(*KEY, long("seq"), said.alias("said"), counts.alias("counts"), F.coalesce(deaf, F.lit(False)).alias("deaf"), card.alias("card"))
