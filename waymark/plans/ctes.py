"""The same history in DuckDB's SQL, as common table expressions that queries name."""

from __future__ import annotations

import re

from waymark.plans.history import NOW_MS

DAY = 86_400_000
TRACK = "device_id, track_id"
BY_FIX = f"partition by {TRACK} order by ts_ms, seq"
BY_START = "partition by device_id order by started_at, track_id"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"(12742017.6e0 * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2e0), 2e0) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2e0), 2e0))))"


def verdict(agree: str) -> str:
    none = f'("end" < "start" or (not {agree} and "end" = "start"))'
    known = "(from_lat is not null and to_lat is not null)"
    kind = f"case when {none} then 'NONE' when {agree} then 'STAY' else 'GAP' end"
    return f"select *, {kind} as kind, case when {none} or {agree} then null when {known} then 'MOVED_UNRECORDED' else 'UNKNOWN_ENDPOINT' end as reason"


def between(source: str, more: str = "") -> str:
    return f"""select * from (select device_id, track_id as after_track_id, lead(track_id) over w as next_id, ended_at as "start", lead(started_at) over w as "end",
        end_lat as from_lat, end_lon as from_lon, lead(start_lat) over w as to_lat, lead(start_lon) over w as to_lon{more}
      from {source} window w as ({BY_START})) where next_id is not null"""


NEAR = f"coalesce({haversine('from_lat', 'from_lon', 'to_lat', 'to_lon')} <= 100, false)"
SAME_PIN = "coalesce(from_pin = to_pin, false)"

CTES = {
    "evt": """select *, lag(track_id) over w as prev_id, lag(us) over w as prev_us
      from (select event_id as track_id, user_id as device_id, event_type, epoch_us(ts) as us from events) window w as (partition by device_id order by us, track_id)""",
    "trk": """select device_id, track_id,
        case event_type when 'view' then 'WALKING' when 'click' then 'RUNNING' when 'purchase' then 'DRIVING' when 'signup' then 'CYCLING' else 'UNKNOWN' end as activity,
        case when track_id % 7 = 0 then 'imported' else 'recorded' end as source,
        case when track_id % 9 = 0 then (track_id + 3) % 6 else coalesce(prev_id, track_id) % 6 end as from_place, track_id % 6 as to_place,
        (case when prev_us is null then us - 600000000 else greatest(prev_us + 1, us - 600000000 - (track_id % 20) * 60000000) end) // 1000 as started_at, us // 1000 as ended_at
      from evt""",
    "fix": "select t.*, unnest(range(0, 10)) as seq from trk t",
    "pts": """select device_id, track_id, activity, seq, started_at + ((ended_at - started_at) * seq) // 9 as ts_ms,
        38e0 + device_id * 0.01e0 + (from_place * (9 - seq) + to_place * seq) / 9e0 * 0.004e0 + ((track_id * 7 + seq * 3) % 11 - 5) * 0.00005e0 as lat,
        -9e0 + device_id * 0.01e0 + (from_place * from_place * (9 - seq) + to_place * to_place * seq) / 9e0 * 0.002e0 + ((track_id * 5 + seq) % 13 - 6) * 0.00005e0 as lon,
        (track_id + seq) % 17 = 0 as ignored, ((track_id * 3 + seq * 11) % 70 + 1)::double as accuracy,
        case when (track_id + seq) % 3 != 0 then ((track_id + seq * 5) % 40)::double / 3.6e0 end as speed, (track_id + seq) % 13 = 5 as segment_start, ((track_id + seq) % 6)::int as satellites
      from fix""",
    "seam": f"""select *, coalesce({haversine('lag(lat) over w', 'lag(lon) over w', 'lat', 'lon')}, 0e0) as seam_m, ts_ms - lag(ts_ms) over w as dt_ms from pts window w as ({BY_FIX})""",
    "gseam": f"""select *, coalesce({haversine('lag(lat) over w', 'lag(lon) over w', 'lat', 'lon')}, 0e0) as seam_m from pts where not ignored window w as ({BY_FIX})""",
    "spd": f"""select *, coalesce(last_value(own ignore nulls) over ({BY_FIX}), 0e0) as speed_kmh
      from (select *, case when speed >= 0 then speed * 3.6e0 when dt_ms > 0 then seam_m / (dt_ms / 1000e0) * 3.6e0 end as own from seam)""",
    "gst": f"""select {TRACK}, count(*) as good_count, sum(seam_m) as distance_m, min(ts_ms) as first_ms, max(ts_ms) as last_ms,
        arg_min(lat, ts_ms * 16 + seq) as start_lat, arg_min(lon, ts_ms * 16 + seq) as start_lon, arg_max(lat, ts_ms * 16 + seq) as end_lat, arg_max(lon, ts_ms * 16 + seq) as end_lon,
        case when count(*) < 2 then 0e0 else {haversine('min(lat)', 'min(lon)', 'max(lat)', 'max(lon)')} end as extent_m
      from gseam group by all""",
    "st": f"""select n.device_id, n.track_id, ignored_count, coalesce(good_count, 0) as good_count, coalesce(distance_m, 0e0) as distance_m, first_ms, last_ms, start_lat, start_lon, end_lat, end_lon, coalesce(extent_m, 0e0) as extent_m
      from (select {TRACK}, count(*) filter (where ignored) as ignored_count from pts group by all) n left join gst on n.device_id = gst.device_id and n.track_id = gst.track_id""",
    "ends": f"select t.*, st.* exclude ({TRACK}) from trk t join st using ({TRACK})",
    "pins": """select device_id, device_id * 10 + i as place_id, i as seed_index, ['Home', 'Work', 'Gym', 'Shop'][i + 1] as label, ['home', 'work', 'sports', 'shopping'][i + 1] as category,
        38e0 + device_id * 0.01e0 + i * 0.004e0 as lat, -9e0 + device_id * 0.01e0 + i * i * 0.002e0 as lon, 150e0 + i * 50e0 as radius_m
      from (select distinct device_id, unnest(range(0, 4)) as i from trk)""",
    "atl": """select *, case when k % 13 = 0 then 'XB' when lon < -8e0 then 'XA' else 'XC' end as country
      from (select k, 37.9e0 + (k * 37 % 400) * 0.01e0 as lat, -9.2e0 + (k * 53 % 400) * 0.008e0 as lon, case when k % 9 = 0 then 0 else k * k % 89 end as population_k, case when k % 3 = 0 then 'New ' else '' end || n_name || ' ' || k as name from (select n_name, n_nationkey * 16 + unnest(range(0, 16)) as k from nation))""",
    "reach": f"select *, min(d) over (partition by place_id) as d0, row_number() over (partition by place_id order by d) as n from (select p.device_id, p.place_id, a.name, a.country, a.population_k, {haversine('p.lat', 'p.lon', 'a.lat', 'a.lon')} as d from pins p cross join atl a)",
    "voted": "select place_id, country from (select *, row_number() over (partition by place_id order by votes desc, first) as k from (select place_id, country, count(*) as votes, min(n) as first from reach where n <= 5 and d <= d0 + 25000 group by all)) where k = 1",
    "own": "select r.* from reach r join voted v on v.place_id = r.place_id and v.country = r.country where d <= d0 + 25000",
    "local": "select * from (select *, row_number() over (partition by place_id order by d) as k from own) where k = 1",
    "pcity": """select o.device_id, o.place_id, case when o.population_k = 0 then o.name else coalesce(b.name, o.name) end as city, o.country, case when o.population_k = 0 then o.d else coalesce(b.d, o.d) end as city_m from local o
      left join (select * from (select r.place_id, r.name, r.d, row_number() over (partition by r.place_id order by r.population_k desc, r.d) as k from own r join local l on l.place_id = r.place_id
        where r.d <= l.d + 5000 and r.population_k > l.population_k and r.population_k >= 3 * l.population_k) where k = 1) b on b.place_id = o.place_id""",
    "pname": """select p.device_id, p.seed_index as pin, p.place_id, case when p.category = 'home' then p.label else c.city end as name, c.city || ', ' || c.country as city, c.country from pins p join pcity c on c.place_id = p.place_id""",
    "endp": """select device_id, track_id, true as is_start, started_at as at_ms, start_lat as lat, start_lon as lon from ends where start_lat is not null
      union all select device_id, track_id, false, ended_at, end_lat, end_lon from ends where end_lat is not null""",
    "epn": "select e.*, row_number() over (partition by e.device_id order by t.started_at, e.track_id, not e.is_start) as n from endp e join trk t on t.device_id = e.device_id and t.track_id = e.track_id",
    "near": f"""select e.*, p.seed_index as pin, {haversine('e.lat', 'e.lon', 'p.lat', 'p.lon')} as metres, p.radius_m from endp e join pins p on e.device_id = p.device_id
      where {haversine('e.lat', 'e.lon', 'p.lat', 'p.lon')} <= p.radius_m""",
    "best": f"select {TRACK}, is_start, min(struct_pack(metres := metres, pin := pin)) as b from near group by all",
    "pinned": f"""select e.*, s.b.pin as start_pin, f.b.pin as end_pin from ends e left join best s on e.device_id = s.device_id and e.track_id = s.track_id and s.is_start
      left join best f on e.device_id = f.device_id and e.track_id = f.track_id and not f.is_start""",
    "pairs": between("ends"),
    "ivl": verdict(NEAR) + " from pairs",
    "ppairs": between("pinned", ", end_pin as from_pin, lead(start_pin) over w as to_pin"),
    "pivl": verdict(f"({NEAR} or {SAME_PIN})") + " from ppairs",
    "pstay": """select i.*, p.seed_index as pin, p.place_id, p.label, p.category from pivl i join pins p on i.device_id = p.device_id and coalesce(i.from_pin, i.to_pin) = p.seed_index where kind = 'STAY'""",
    "span": f"""select t.device_id, first_at, last_at, (greatest(-64800, least(64800, floor(p.lon / 15 * 3600 + 0.5e0))) * 1000)::bigint as offset_ms
      from (select device_id, min(started_at) as first_at, max(ended_at) as last_at from trk group by all) t join pins p on p.device_id = t.device_id and p.seed_index = 0""",
    "night": f"""select device_id, night, at_ms from (select device_id, first_at, last_at, night, night * {DAY} + 10800000 - offset_ms as at_ms
        from (select *, unnest(range(floor((first_at + offset_ms) / {DAY})::bigint, floor((last_at + offset_ms) / {DAY})::bigint + 1)) as night from span)) where at_ms between first_at and last_at""",
    "still": """select n.device_id, n.night, min(case when i.kind = 'STAY' or coalesce(i.from_pin = 0, false) = coalesce(i.to_pin = 0, false) then case when coalesce(i.from_pin = 0, false) then 'HOME' else 'AWAY' end else 'UNKNOWN' end) as value
      from night n join pivl i on i.device_id = n.device_id and i.kind in ('STAY', 'GAP') and i."start" <= n.at_ms and n.at_ms < i."end" group by all""",
    "around": f"""select n.device_id, n.night, n.at_ms, t.track_id, max(case when p.ts_ms <= n.at_ms then struct_pack(ts_ms := p.ts_ms, seq := p.seq, lat := p.lat, lon := p.lon) end) as x,
        min(case when p.ts_ms >= n.at_ms then struct_pack(ts_ms := p.ts_ms, seq := p.seq, lat := p.lat, lon := p.lon) end) as y
      from night n join trk t on t.device_id = n.device_id and n.at_ms between t.started_at and t.ended_at join pts p on p.device_id = t.device_id and p.track_id = t.track_id and not p.ignored group by n.device_id, n.night, n.at_ms, t.track_id""",
    "onway": """select device_id, night, x.lat + (y.lat - x.lat) * part as lat, x.lon + (y.lon - x.lon) * part as lon
      from (select *, case when y.ts_ms > x.ts_ms then (at_ms - x.ts_ms) / (y.ts_ms - x.ts_ms)::double else 0e0 end as part from around where x is not null and y is not null)""",
    "moving": f"select o.device_id, o.night, min(case when {haversine('o.lat', 'o.lon', 'p.lat', 'p.lon')} <= p.radius_m then 'HOME' else 'AWAY' end) as value from onway o join pins p on p.device_id = o.device_id and p.seed_index = 0 group by all",
    "nplace": """select n.device_id, n.night, n.at_ms, coalesce(s.value, m.value, 'UNKNOWN') as place from night n
      left join still s on s.device_id = n.device_id and s.night = n.night left join moving m on m.device_id = n.device_id and m.night = n.night""",
    "jrn": """select device_id, min(night) as first_night, max(night) as last_night, min(at_ms) as first_at, max(at_ms) as last_at, count(*) as away_nights, max(night) - min(night) + 1 as nights
      from (select *, count(*) filter (where place = 'HOME') over (partition by device_id order by night rows unbounded preceding) as block from nplace) where place = 'AWAY' group by device_id, block""",
    "win": f"""select device_id, first_night, last_night, first_at, last_at, nights, greatest(coalesce(left_home, -9223372036854775808), (first_at // {DAY} - 1) * {DAY}) as a, least(coalesce(reached_home, {NOW_MS}), (last_at // {DAY} + 1) * {DAY}) as b
      from (select j.*, max(case when s."end" <= j.first_at then s."end" end) as left_home, min(case when s."start" >= j.last_at then s."start" end) as reached_home
        from jrn j left join pstay s on s.device_id = j.device_id and s.pin = 0 group by all)""",
    "days": f"""select device_id, kind, after_track_id, greatest("start", day * {DAY}) as slice_start, least("end", (day + 1) * {DAY}) as slice_end, day * {DAY} <= "start" as holds_start, (day + 1) * {DAY} >= "end" as holds_end, day
      from (select *, unnest(range("start" // {DAY}, greatest("start" // {DAY}, (case when "end" > "start" then "end" - 1 else "end" end) // {DAY}) + 1)) as day from ivl where kind = 'STAY')""",
    "halves": f"""select device_id, kind, after_track_id, "start" as slice_start, case when "end" // {DAY} * {DAY} <= "start" then "end" else "end" // {DAY} * {DAY} end as slice_end, true as holds_start, "end" // {DAY} * {DAY} <= "start" as holds_end from ivl where kind = 'GAP'
      union all select device_id, kind, after_track_id, "end" // {DAY} * {DAY}, "end", false, true from ivl where kind = 'GAP' and "end" // {DAY} * {DAY} > "start" """,
    "tline": """select device_id, 'TRACK' as kind, track_id as ref_id, started_at as at_ms, ended_at as until, 1 as rank, started_at as filed_at from trk
      union all select device_id, kind, after_track_id, slice_start, slice_end, 2, slice_start from days
      union all select device_id, kind, after_track_id, slice_start, slice_end, 2, case when holds_end and not holds_start then slice_end else slice_start end from halves""",
    "isl": f"select *, count(*) filter (where not ignored) over ({BY_FIX} rows between unbounded preceding and 1 preceding) as island from pts",
    "brk": f"select * from (select *, bool_or(segment_start) over (partition by {TRACK}, island) as brk from isl) where not ignored",
}


def sql(text: str) -> str:
    """A query with the expressions that it names in front, in their order."""
    used: set[str] = set()

    def visit(body: str) -> None:
        for name in re.findall(r"\b(?:from|join)\s+(\w+)", body):
            if name in CTES and name not in used:
                visit(CTES[name])
                used.add(name)

    visit(text)
    heads = ",\n".join(f"{name} as ({CTES[name]})" for name in CTES if name in used)
    return f"with {heads}\n{text}" if heads else text
