"""Registered queries over edits of whole tracks; they show the fixes that an edit leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.config import Dwell, Keep
from waymark.operators import edits, points, tracks
from waymark.plans.catalog import BACKS, CEILING, jumps_sql, recursive
from waymark.plans.ctes import BY_START, TRACK
from waymark.plans.history import History
from waymark.plans.registry import KEY, SQL, long, query

#: SQL doesn't walk for stops, so here none is long enough to be one; the operators' tests have them.
NO_STOP = Dwell(min_s=1e9)
ALL = Keep(0.0, 0.0, 0.0)
NEW = 2_000_000_000_000


def tables(h: History) -> tuple[DataFrame, DataFrame]:
    none = lambda kind: F.lit(None).cast(kind)
    return h.tracks.withColumns({"discarded_at": none("long"), "discard_reason": none("string")}), h.points.withColumn("ignore_reason", none("string"))


@query()
def finished_fixes(h: History) -> DataFrame:
    """Fixes of finished tracks, every fourth walk of which something carried: the jumps that this allows are back."""
    t, _ = tables(h)
    f = points.with_reasons(h.points).withColumn("ignored", F.col("reason").isNotNull()).withColumnRenamed("reason", "ignore_reason")
    carried = h.tracks.where("activity = 'WALKING' and track_id % 4 = 0").select(*KEY, F.lit("UNKNOWN").alias("activity"))
    _, g = edits.finished(t, f, carried, dwell=NO_STOP, keep=ALL)
    return g.select(*KEY, long("seq"), "activity", "ignore_reason")


SQL["finished_fixes"] = recursive(
    f"""select w.device_id, w.track_id, w.seq::bigint as seq, case when c.carried then 'UNKNOWN' else p.activity end as activity, case when c.carried and b.came then null else w.reason end as ignore_reason
    from walk w join pts p on p.device_id = w.device_id and p.track_id = w.track_id and p.seq = w.seq join backs b on b.device_id = w.device_id and b.track_id = w.track_id and b.seq = w.seq
      join (select {TRACK}, activity = 'WALKING' and track_id % 4 = 0 as carried from trk) c on c.device_id = w.device_id and c.track_id = w.track_id""",
    jumps_sql(CEILING) + BACKS, "pts", "trk",
)

MERGES = f"""select * from (select {TRACK}, ended_at, activity, source, lead(track_id) over w as next_id, lead(started_at) over w as cut, lead(activity) over w as next_activity, lead(source) over w as next_source from trk window w as ({BY_START}))
    where cut - ended_at between 0 and 300000 and activity = next_activity and source is not distinct from next_source"""


@query(
    f"""select device_id, track_id, seq - 1 as seq, ts_ms, ignored, segment_start or n = coalesce(min(case when ts_ms >= cut then n end) over (partition by device_id, track_id), 0) as segment_start from (
      select p.device_id, m.track_id + {NEW} as track_id, p.ts_ms, p.ignored, p.segment_start, m.cut, row_number() over w as n, row_number() over w as seq
      from ({MERGES}) m join pts p on p.device_id = m.device_id and p.track_id in (m.track_id, m.next_id) window w as (partition by m.device_id, m.track_id order by p.ts_ms, p.ts_ms >= m.cut, p.seq))"""
)
def merged_fixes(h: History) -> DataFrame:
    """Fixes of the tracks that merges make: numbered anew, with a break where the later one begins."""
    plans = tracks.merge_plans(h.tracks).withColumn("merged_id", F.col("track_id") + NEW)
    _, f, _ = edits.merged(*tables(h), plans, 1, dwell=NO_STOP)
    return f.where(F.col("track_id") >= NEW).select(*KEY, long("seq"), "ts_ms", "ignored", "segment_start")


HALVES = f"""select p.*, case when p.ts_ms >= c.cut then p.track_id + {NEW} else p.track_id end as part from pts p
    join (select p.device_id, p.track_id, any_value(t.cut) as cut from pts p join (select {TRACK}, started_at + (ended_at - started_at) // 2 as cut from trk) t on t.device_id = p.device_id and t.track_id = p.track_id
      where not ignored group by all having count(*) filter (where ts_ms < cut) >= 2 and count(*) filter (where ts_ms >= cut) >= 2) c on c.device_id = p.device_id and c.track_id = p.track_id"""


@query(f"select device_id, part as track_id, min(ts_ms) filter (where not ignored) as started_at, max(ts_ms) filter (where not ignored) as ended_at, count(*) filter (where not ignored) as good_count, count(*) filter (where ignored) as ignored_count from ({HALVES}) group by all")
def split_halves(h: History) -> DataFrame:
    """Bounds and counts of the halves of tracks that are cut in the middle of their time."""
    t, f = tables(h)
    cuts = h.tracks.select(*KEY, F.expr("started_at + (ended_at - started_at) div 2").alias("cut"), (F.col("track_id") + NEW).alias("new_id"))
    u, _, journal = edits.split(t, f, cuts, dwell=NO_STOP)
    mine = journal.select("device_id", F.explode(F.array("track_id", "new_id")).alias("track_id"))
    return u.join(mine.hint("merge"), KEY, "left_semi").select(*KEY, "started_at", "ended_at", "good_count", "ignored_count")
