"""Registered queries over how a history is drawn and read: clocks of places, colour ramps, tracks as columns, packed atlases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import cities, places, ramps, zones
from waymark.plans.ctes import TRACK, haversine
from waymark.plans.history import NOW_MS, History
from waymark.plans.registry import KEY, long, query, r
from waymark.sources import columnar, packed_atlas
from waymark.sources.shared import kept

# --- clocks


def pin_zones(h: History) -> DataFrame:
    c = cities.named(h.pins, h.atlas, geo.sphere_m)
    return c.select("device_id", F.col("seed_index").alias("place"), "zone")


def zoned_intervals(h: History) -> DataFrame:
    i = h.pin_intervals.where("kind != 'NONE'").withColumns({"from_place": F.col("from_pin"), "to_place": F.col("to_pin")})
    return zones.interval_zones(i, pin_zones(h))


PZ = "(select device_id, pin, case when country = 'XC' then 'Europe/Madrid' else 'Europe/Lisbon' end as zone from pname)"
ZONED = f"""(select i.*, coalesce(x.zone, 'UTC') as zone, coalesce(y.zone, 'UTC') as end_zone
  from (select *, case when kind = 'STAY' then coalesce(from_pin, to_pin) else from_pin end as a, case when kind = 'STAY' then coalesce(from_pin, to_pin) else to_pin end as b from pivl where kind != 'NONE') i
  left join {PZ} x on x.device_id = i.device_id and x.pin = i.a left join {PZ} y on y.device_id = i.device_id and y.pin = i.b)"""


@query(
    f"""select 'TRACK' as kind, t.device_id, t.track_id as ref_id, coalesce(x.zone, 'UTC') as zone, coalesce(y.zone, 'UTC') as end_zone
    from pinned t left join {PZ} x on x.device_id = t.device_id and x.pin = t.start_pin left join {PZ} y on y.device_id = t.device_id and y.pin = t.end_pin
    union all select kind, device_id, after_track_id, zone, end_zone from {ZONED}"""
)
def row_zones(h: History) -> DataFrame:
    """The clocks that tracks, stays and gaps are read on: those of the places at their ends."""
    t = zones.with_zones(h.pinned, pin_zones(h), "start_pin", "end_pin")
    t = t.select(F.lit("TRACK").alias("kind"), "device_id", F.col("track_id").alias("ref_id"), "zone", "end_zone")
    return t.unionByName(zoned_intervals(h).select("kind", "device_id", F.col("after_track_id").alias("ref_id"), "zone", "end_zone"))


def wall(ms: str, zone: str) -> str:
    """The local date and time of an instant, in DuckDB."""
    return f"timezone({zone}, timezone('UTC', make_timestamp({ms} * 1000)))"


def instant(local: str, zone: str) -> str:
    return f"epoch_ms(timezone({zone}, ({local})::timestamp))"


FILED = f"case when kind = 'GAP' and holds_end and not holds_start then {wall('slice_end', 'end_zone')} else {wall('slice_start', 'zone')} end"
OPENS = instant(f"({wall('z.end', 'z.end_zone')})::date", "z.end_zone").replace("z.end *", 'z."end" *')
STAY_DAYS = f"""(select device_id, kind, after_track_id, greatest("start", opens) as slice_start, case when closes >= "end" then "end" else closes end as slice_end, opens <= "start" as holds_start, closes >= "end" as holds_end, zone, zone as end_zone
  from (select *, {instant('day', 'zone')} as opens, {instant("day + interval 1 day", 'zone')} as closes
    from (select *, unnest(generate_series(({wall('"start"', 'zone')})::date, greatest(({wall('"start"', 'zone')})::date, ({wall('(case when "end" > "start" then "end" - 1 else "end" end)', 'zone')})::date), interval 1 day)) as day
      from {ZONED} where kind = 'STAY')))"""
HALVES = f"""(select *, cut <= "start" as whole from (select z.*, {OPENS} as cut from {ZONED} z where kind = 'GAP'))"""
SLICES = f"""(select * from {STAY_DAYS}
  union all select device_id, kind, after_track_id, "start", case when whole then "end" else cut end, true, whole, zone, case when whole then end_zone end from {HALVES}
  union all select device_id, kind, after_track_id, cut, "end", false, true, null, end_zone from {HALVES} where not whole)"""


@query(f"""select device_id, kind, after_track_id, slice_start, slice_end, holds_start, holds_end, zone, end_zone, epoch_ms(({FILED})::date::timestamp) // 86400000 as day from {SLICES}""")
def zoned_slices(h: History) -> DataFrame:
    """Stays by the days of their own zone, gaps cut at their arrival's midnight, and the day that each slice is filed under."""
    s = zones.filed_day(zones.sliced(zoned_intervals(h), F.lit(NOW_MS)))
    return s.select(*zones.SLICE, F.unix_date("day").cast("long").alias("day"))


# --- ramps

RAMP = "floor(greatest(0e0, least(1e0, ({v} - {red}) / ({blue} - {red}))) * 32 + 0.5e0)::bigint"


def ends_sql(k: int, i: int) -> str:
    """An anchor by activity, as SQL."""
    return "(case activity " + " ".join(f"when '{a}' then {e[k][i]}e0" for a, e in ramps.SPEEDS.items()) + f" else {ramps.SPEEDS['UNKNOWN'][k][i]}e0 end)"


BANDS = {
    "speed_band": RAMP.format(v="speed_kmh", red=ends_sql(0, 0), blue=ends_sql(0, 1)),
    "mph_band": RAMP.format(v="(speed_kmh / 1.609344e0)", red=ends_sql(1, 0), blue=ends_sql(1, 1)),
    "accuracy_band": RAMP.format(v="accuracy", red="50e0", blue="0e0"),
    "feet_band": RAMP.format(v="(accuracy * 3.28084e0)", red="150e0", blue="0e0"),
    "satellites_band": RAMP.format(v="satellites::double", red="0e0", blue="12e0"),
}


@query(f"select {TRACK}, seq::bigint as seq, " + ", ".join(f"{b} as {name}" for name, b in BANDS.items()) + " from spd")
def ramp_bands(h: History) -> DataFrame:
    """The colour of each fix by its metrics, between anchors of its activity and units."""
    p = ramps.with_speeds(h.points)
    for name, metric, imperial in (("speed_band", "speed", False), ("mph_band", "speed", True), ("accuracy_band", "accuracy", False), ("feet_band", "accuracy", True), ("satellites_band", "satellites", False)):
        p = ramps.ramped(p, metric, imperial).withColumn(name, F.col("band").cast("long")).drop("value", "red", "blue", "band")
    return p.select(*KEY, long("seq"), *BANDS)


@query(f"select {TRACK}, floor(max({ends_sql(1, 0)}) + 0.5e0)::bigint as left, floor(max(({ends_sql(1, 0)} + {ends_sql(1, 1)}) / 2) + 0.5e0)::bigint as middle, floor(max({ends_sql(1, 1)}) + 0.5e0)::bigint as right from spd group by all")
def ramp_legends(h: History) -> DataFrame:
    """The numbers under each track's ramp of speeds, in miles an hour."""
    return ramps.legends(ramps.ramped(h.points, "speed", True))


# --- tracks as columns

WHY = "case when p.ignored then case when (p.track_id + p.seq) % 2 = 0 then 'jump' else 'edge_stay' end end"


def packed_tracks(h: History) -> DataFrame:
    why = F.when(F.col("ignored"), F.when((F.col("track_id") + F.col("seq")) % 2 == 0, "jump").otherwise("edge_stay"))
    return kept(columnar.packed(h.points.withColumn("ignore_reason", why)), "columns")


@query(
    f"""select p.device_id, p.track_id, p.seq::bigint as seq, p.ts_ms, round(p.lat, 9) as lat, round(p.lon, 9) as lon, round(p.speed, 6) as speed, p.accuracy, p.ignored, {WHY} as ignore_reason, coalesce(b.brk, false) as break_here
    from pts p left join brk b on b.device_id = p.device_id and b.track_id = p.track_id and b.seq = p.seq"""
)
def columnar_fixes(h: History) -> DataFrame:
    """Fixes out of tracks that were written as columns and read back."""
    p = columnar.unpacked(packed_tracks(h))
    return p.select(*KEY, long("seq"), "ts_ms", r("lat", 9), r("lon", 9), r("speed", 6), "accuracy", "ignored", "ignore_reason", F.col("break").alias("break_here"))


@query(
    f"""select p.device_id, p.track_id, count(*) as fixes, count(*) filter (where not p.ignored) as good, coalesce(sum(case when b.brk then 1 else 0 end), 0)::bigint as breaks, round(min(case when not p.ignored then p.lat end), 9) as south,
    round(min(case when not p.ignored then p.lon end), 9) as west, round(max(case when not p.ignored then p.lat end), 9) as north, round(max(case when not p.ignored then p.lon end), 9) as east
    from pts p left join brk b on b.device_id = p.device_id and b.track_id = p.track_id and b.seq = p.seq group by all"""
)
def columnar_tracks(h: History) -> DataFrame:
    """What the columns of a track say of it: its fixes, the good ones, the breaks and where it lies."""
    c = packed_tracks(h)
    n = lambda arr, f: F.size(F.filter(arr, f)).cast("long")
    return c.select(*KEY, long("fixes"), n("reasons", lambda x: x == 0).alias("good"), n("breaks", lambda x: x).alias("breaks"), *[F.round(F.col(f"bbox.{s}"), 9).alias(s) for s in ("south", "west", "north", "east")])


@query()
def columnar_lines(h: History) -> DataFrame:
    """A row a line of a track: its level, its number among the track's lines, and the positions of its fixes."""
    c = packed_tracks(h).select(*KEY, F.posexplode("lines").alias("level", "of_level"))
    c = c.select(*KEY, long("level"), F.posexplode("of_level").alias("line_no", "line"))
    return c.select(*KEY, "level", long("line_no"), F.array_join(F.transform("line", lambda x: x.cast("string")), ",").alias("line"))


# --- atlases


@query("select round(lat, 6) as lat, round(lon, 6) as lon, population_k::bigint as population_k, country, case when country = 'XC' then 'Europe/Madrid' else 'Europe/Lisbon' end as zone, name from atl")
def packed_cities(h: History) -> DataFrame:
    """An atlas packed into files and read out of them again."""
    a = packed_atlas.parsed(kept(packed_atlas.packed(h.atlas, 4), "atlas"))
    return a.select(r("lat", 6), r("lon", 6), long("population_k"), "country", "zone", "name")


# --- places


@query(f"select p.device_id, p.place_id, count(n.track_id) as captured from pins p left join near n on n.device_id = p.device_id and n.pin = p.seed_index group by all")
def captured_ends(h: History) -> DataFrame:
    """How many ends of tracks each place's radius holds, whichever place they count for."""
    return places.captured(h.endpoints, h.pins).select("device_id", "place_id", "captured")


IN_PIN = "exists (select 1 from pins p where p.device_id = g.device_id and {d} <= p.radius_m)"


@query(
    f"""select device_id, after_track_id, side, label, round(lat, 6) as lat, round(lon, 6) as lon from (
      select *, {haversine('from_lat', 'from_lon', 'to_lat', 'to_lon')} <= {places.NEW_RADIUS_M} as beside from (
        select g.*, {IN_PIN.format(d=haversine('g.from_lat', 'g.from_lon', 'p.lat', 'p.lon'))} as from_held, {IN_PIN.format(d=haversine('g.to_lat', 'g.to_lon', 'p.lat', 'p.lon'))} as to_held
        from ivl g where kind = 'GAP' and from_lat is not null and to_lat is not null))
      , lateral (select 'from' as side, 'Left' as label, from_lat as lat, from_lon as lon, not from_held and after_track_id % 5 != 0 as new union all select 'to', 'Reached', to_lat, to_lon, not to_held and not (beside and not from_held and after_track_id % 5 != 0)) s
    where new"""
)
def end_places(h: History) -> DataFrame:
    """Places that trips entered by hand for gaps would add at their ends; one in five leaves its start unnamed."""
    g = h.intervals.where("kind = 'GAP' and from_lat is not null and to_lat is not null")
    label = F.when(F.col("after_track_id") % 5 == 0, "  ").otherwise(" Left ")
    d = g.select("device_id", "after_track_id", "from_lat", "from_lon", "to_lat", "to_lon", label.alias("from_label"), F.lit("Reached").alias("to_label"))
    return places.end_places(d, h.pins, ["device_id", "after_track_id"]).select("device_id", "after_track_id", "side", "label", r("lat", 6), r("lon", 6))
