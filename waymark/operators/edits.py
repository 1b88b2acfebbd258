"""Changes of whole tracks: finished, imported, restored, merged, split and swept, and taken back.

Each takes and gives tracks and their fixes. Whatever changes a track's fixes leaves
it settled: what lies beyond a stop at an edge is ignored, and its bounds and
statistics are those of what is left. Edits that can be taken back give a journal.
An edit's plan reads its tables several times, so write what it gives before the next.

tracks: device_id, track_id, activity, source, started_at, ended_at, discarded_at,
discard_reason and any others; fixes: device_id, track_id, activity, seq, ts_ms, lat,
lon, speed, ignored, ignore_reason, segment_start and any others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.config import BRIEF, Dwell, Edge, Keep, Quality
from waymark.functions.geo import Distance, haversine_m
from waymark.operators import dwells, library, points, tracks
from waymark.operators.points import TRACK

#: What is measured of a track's good fixes.
STATS = ("ignored_count", "good_count", "distance_m", "start_lat", "start_lon", "end_lat", "end_lon", "first_ms", "last_ms", "extent_m")
#: First fixes of an imported track that can be off, at most, and fixes that each is judged by.
STRAYS, AHEAD = 5, 5
#: Measures that differ by less are the same.
SAME = 1e-6


def measured(trips: DataFrame, fixes: DataFrame, distance: Distance = haversine_m) -> DataFrame:
    """Tracks with bounds and STATS of their good fixes; an open one stays open, one without fixes keeps its bounds."""
    t = trips.drop(*STATS).join(tracks.stats(fixes, distance).select(*TRACK, *STATS).hint("merge"), list(TRACK), "left")
    t = t.fillna({"ignored_count": 0, "good_count": 0, "distance_m": 0.0, "extent_m": 0.0})
    # as tracks.bounds, which would go through the fixes once more
    return t.withColumns({"started_at": F.coalesce("first_ms", "started_at"), "ended_at": F.when(F.col("ended_at").isNotNull(), F.coalesce("last_ms", "ended_at"))})


def settled(trips: DataFrame, fixes: DataFrame, edge: Edge = Edge(), dwell: Dwell = BRIEF, distance: Distance = haversine_m) -> tuple[DataFrame, DataFrame]:
    """(tracks, fixes) with stops at the edges ignored, and measured."""
    f = dwells.settled(fixes, edge, dwell).select(*fixes.columns)
    return measured(trips, f, distance), f


def finished(trips: DataFrame, fixes: DataFrame, renames: DataFrame, edge: Edge = Edge(), dwell: Dwell = BRIEF, keep: Keep = Keep(), distance: Distance = haversine_m) -> tuple[DataFrame, DataFrame]:
    """(tracks, fixes) of tracks that have ended: renamed, jumps taken back, settled, then kept, discarded or purged.

    renames: device_id, track_id, activity, of tracks that something carried. A jump
    that the new activity allows comes back before the edges are looked at, and the
    verdict is on what is left. What is purged is in neither table; what is discarded
    was so when it ended.
    """
    f = library.taken_back(fixes, renames).withColumn("activity", F.coalesce("_new", "activity")).select(*fixes.columns)
    t = trips.join(renames.select(*TRACK, F.col("activity").alias("_new")).hint("merge"), list(TRACK), "left").withColumn("activity", F.coalesce("_new", "activity")).drop("_new").withColumn("_at", F.col("ended_at"))
    t, f = settled(t, f, edge, dwell, distance)
    t = t.withColumn("seconds", (F.col("ended_at") - F.col("started_at")) / F.lit(1000.0))
    t = t.withColumn("verdict", tracks.verdict(t, keep)).where("verdict != 'PURGE'")
    out = F.col("verdict") == "DISCARD"
    t = t.withColumns({"discarded_at": F.when(out, F.col("_at")).otherwise(F.col("discarded_at")), "discard_reason": F.when(out, "filtered").otherwise(F.col("discard_reason"))})
    return t.drop("_at", "seconds", "verdict"), f.join(t.select(*TRACK).hint("merge"), list(TRACK), "left_semi")


def stray_heads(fixes: DataFrame, rounds: int = STRAYS, rule: Quality = Quality(), distance: Distance = haversine_m) -> DataFrame:
    """(device_id, track_id, seq) of first good fixes that are off: the first one goes while it is, a few times at most.

    The first of what is left is off if its seam is fast, and much longer than the
    next three. A seam stays what it is when a fix before it goes, so all rounds read
    the same seams.
    """
    p = points.with_seams(points.good(fixes), distance).withColumn("_n", F.row_number().over(points.in_order())).where(F.col("_n") <= rounds + AHEAD - 1)
    kmh = F.when(F.col("dt_ms") > 0, F.col("seam_m") / (F.col("dt_ms") / F.lit(1000.0)) * 3.6)
    most = lambda a, b: F.max(F.when(F.col("_n").between(a, b), kmh))
    g = p.groupBy(*TRACK).agg(F.count("*").alias("_rows"), *[f(*x).alias(f"_{name}{r}") for r in range(1, rounds + 1) for name, f, x in (("first", most, (r + 1, r + 1)), ("later", most, (r + 2, r + AHEAD - 1)))])
    off = F.lit(rounds)
    for r in range(rounds, 0, -1):
        first, later = F.col(f"_first{r}"), F.col(f"_later{r}")
        stray = (F.col("_rows") >= r + 2) & (first >= rule.stray_kmh) & (first >= rule.stray_times * later)
        off = F.when(F.coalesce(stray, F.lit(False)), off).otherwise(r - 1)
    return p.join(g.select(*TRACK, off.alias("_off")), list(TRACK)).where("_n <= _off").select(*TRACK, "seq")


def imported(trips: DataFrame, fixes: DataFrame, edge: Edge = Edge(), dwell: Dwell = BRIEF, distance: Distance = haversine_m) -> tuple[DataFrame, DataFrame]:
    """(tracks, fixes) as they come in: first fixes that are off are ignored as jumps, then closed tracks are settled and open ones measured."""
    off = stray_heads(fixes).withColumn("_off", F.lit(True))
    f = fixes.join(off, [*TRACK, "seq"], "left")
    f = f.withColumns({"ignored": F.col("ignored") | F.col("_off").isNotNull(), "ignore_reason": F.when(F.col("_off").isNotNull(), "jump").otherwise(F.col("ignore_reason"))}).select(*fixes.columns)
    open_ = trips.where("ended_at is null")
    of = lambda t: f.join(t.select(*TRACK), list(TRACK), "left_semi")
    done = trips.where("ended_at is not null")
    t, g = settled(done, of(done), edge, dwell, distance)
    bounds = open_.select(*TRACK, F.col("started_at").alias("_from"))
    running = measured(open_, of(open_), distance).join(bounds, list(TRACK)).withColumn("started_at", F.col("_from")).drop("_from")
    return t.unionByName(running), g.unionByName(of(open_))


def restored(trips: DataFrame, fixes: DataFrame, edge: Edge = Edge(), dwell: Dwell = BRIEF, distance: Distance = haversine_m) -> tuple[DataFrame, DataFrame]:
    """(tracks, fixes) out of a backup: edges by today's rules, bounds by them; STATS are taken anew only where a flag moved."""
    f = dwells.settled(fixes, edge, dwell).select(*fixes.columns)
    was = fixes.select(*TRACK, "seq", F.col("ignored").alias("_was"))
    moved = f.join(was, [*TRACK, "seq"]).where("ignored != _was").select(*TRACK).distinct().withColumn("_moved", F.lit(True))
    anew = measured(trips, f, distance).select(*TRACK, "started_at", "ended_at", *[F.col(c).alias(f"_{c}") for c in STATS])
    t = trips.drop("started_at", "ended_at").join(anew, list(TRACK)).join(moved, list(TRACK), "left")
    own = lambda c: F.when(F.col("_moved"), F.col(f"_{c}")).otherwise(F.col(c)) if c in trips.columns else F.col(f"_{c}")
    return t.withColumns({c: own(c) for c in STATS}).drop("_moved", *[f"_{c}" for c in STATS]), f


def merged(trips: DataFrame, fixes: DataFrame, plans: DataFrame, at_ms: int, edge: Edge = Edge(), dwell: Dwell = BRIEF, distance: Distance = haversine_m) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tracks, fixes, journal) with each plan's two tracks as one; plans: device_id, track_id, next_id, merged_id.

    The new track holds copies of both tracks' fixes, numbered anew, with a break
    where the later one began; it is settled as a whole. The two are discarded as
    merged and keep their fixes. journal: device_id, merged_id, track_id, next_id.
    """
    p = plans.select(*TRACK, "next_id", "merged_id")
    later = trips.select("device_id", F.col("track_id").alias("next_id"), F.col("started_at").alias("_cut"), F.coalesce("ended_at", "started_at").alias("_end"))
    both = p.join(later.hint("merge"), ["device_id", "next_id"])
    new = trips.join(both.hint("merge"), list(TRACK)).withColumns({"track_id": F.col("merged_id"), "ended_at": F.col("_end")}).select(*trips.columns)
    parts = both.select("device_id", F.explode(F.array("track_id", "next_id")).alias("track_id"), "merged_id", "_cut")
    copy = fixes.join(parts.hint("merge"), list(TRACK)).withColumn("track_id", F.col("merged_id"))
    order = Window.partitionBy(*TRACK).orderBy("ts_ms", F.col("ts_ms") >= F.col("_cut"), "seq")
    copy = copy.withColumn("_n", F.row_number().over(order))
    first = F.min(F.when(F.col("ts_ms") >= F.col("_cut"), F.col("_n"))).over(Window.partitionBy(*TRACK))
    copy = copy.withColumn("segment_start", F.col("segment_start") | F.coalesce(F.col("_n") == first, F.lit(False))).withColumn("seq", (F.col("_n") - 1).cast(fixes.schema["seq"].dataType)).select(*fixes.columns)
    t, f = settled(new, copy, edge, dwell, distance)
    gone = parts.select(*TRACK, F.lit(at_ms).cast("long").alias("at"), F.lit("merged").alias("reason"))
    return _together(library.discarded(trips, gone), t), fixes.unionByName(f), p.select("device_id", "merged_id", "track_id", "next_id")


def unmerged(trips: DataFrame, fixes: DataFrame, journal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tracks, fixes) as they were before the merges of a journal."""
    made = journal.select("device_id", F.col("merged_id").alias("track_id"))
    back = journal.select("device_id", F.explode(F.array("track_id", "next_id")).alias("track_id"))
    return library.restored(library.without(trips, made), back), library.without(fixes, made)


def split(trips: DataFrame, fixes: DataFrame, cuts: DataFrame, edge: Edge = Edge(), dwell: Dwell = BRIEF, distance: Distance = haversine_m) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tracks, fixes, journal) with closed tracks cut in two; cuts: device_id, track_id, cut, new_id.

    Fixes from the cut on go to the new track. Each half ends at its own fix next to
    the cut and is settled by itself. A cut that leaves a half with fewer than two
    good fixes is no cut. journal: device_id, track_id, new_id.
    """
    legal = tracks.split_plans(fixes, cuts.select(*TRACK, "cut")).where("legal").select(*TRACK)
    c = cuts.join(legal.hint("merge"), list(TRACK), "left_semi").join(trips.where("ended_at is not null").select(*TRACK).hint("merge"), list(TRACK), "left_semi").select(*TRACK, "cut", "new_id")
    f = fixes.join(c.hint("merge"), list(TRACK)).withColumn("_old", F.col("track_id"))
    inner = f.groupBy(*TRACK).agg(F.max(F.when(F.col("ts_ms") < F.col("cut"), F.col("ts_ms"))).alias("_until"), F.min(F.when(F.col("ts_ms") >= F.col("cut"), F.col("ts_ms"))).alias("_from"))
    old = trips.join(c.hint("merge"), list(TRACK)).join(inner.hint("merge"), list(TRACK))
    halves = old.withColumn("ended_at", F.col("_until")).select(*trips.columns).unionByName(old.withColumns({"track_id": F.col("new_id"), "started_at": F.col("_from")}).select(*trips.columns))
    moved = f.withColumn("track_id", F.when(F.col("ts_ms") >= F.col("cut"), F.col("new_id")).otherwise(F.col("track_id"))).select(*fixes.columns)
    t, g = settled(halves, moved, edge, dwell, distance)
    return _together(library.without(trips, c), t), library.without(fixes, c).unionByName(g), c.select(*TRACK, "new_id")


def unsplit(trips: DataFrame, fixes: DataFrame, journal: DataFrame, edge: Edge = Edge(), dwell: Dwell = BRIEF, distance: Distance = haversine_m) -> tuple[DataFrame, DataFrame]:
    """(tracks, fixes) with the halves of a journal's splits as one again, settled as a whole; a split that is gone is passed over."""
    ends = trips.select("device_id", F.col("track_id").alias("new_id"), F.col("ended_at").alias("_end"))
    j = journal.join(ends, ["device_id", "new_id"]).join(trips.select(*TRACK), list(TRACK), "left_semi").select(*TRACK, "new_id", "_end")
    second = j.select("device_id", F.col("new_id").alias("track_id"), F.col("track_id").alias("_old"))
    mine = j.select(*TRACK).unionByName(second.select(*TRACK))
    whole = trips.join(j.select(*TRACK, "_end"), list(TRACK)).withColumn("ended_at", F.col("_end")).select(*trips.columns)
    back = fixes.join(mine, list(TRACK), "left_semi").join(second, list(TRACK), "left").withColumn("track_id", F.coalesce("_old", "track_id")).select(*fixes.columns)
    t, f = settled(whole, back, edge, dwell, distance)
    return _together(library.without(trips, mine), t), library.without(fixes, mine).unionByName(f)


def swept(trips: DataFrame, fixes: DataFrame, edge: Edge = Edge(), dwell: Dwell = BRIEF, distance: Distance = haversine_m) -> tuple[DataFrame, DataFrame]:
    """(tracks, fixes): those rows of closed tracks that today's rules make another of, as they make them.

    Written over the rows of the same keys (``written_over``), a second sweep gives none.
    """
    done = trips.where("ended_at is not null")
    t, f = settled(done, fixes.join(done.select(*TRACK), list(TRACK), "left_semi"), edge, dwell, distance)
    return _differing(t, trips, [*TRACK]), _differing(f, fixes, [*TRACK, "seq"])


def written_over(rows: DataFrame, changed: DataFrame, key: list[str]) -> DataFrame:
    """Rows with those of the same key replaced by changed ones."""
    return _together(rows.join(changed.select(*key), key, "left_anti"), changed)


def _together(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both; a column that one of them lacks is null there."""
    return a.unionByName(b, allowMissingColumns=True)


def _differing(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new that old has not, or has otherwise."""
    names = [c for c in new.columns if c not in key]
    was = old.select(*key, F.lit(True).alias("_there"), *[F.col(c).alias(f"_{c}") for c in names if c in old.columns])

    def same(c: str) -> Column:
        a, b = F.col(c), F.col(f"_{c}") if c in old.columns else F.lit(None)
        near = F.abs(a - b) <= SAME if dict(new.dtypes)[c] in ("double", "float") else F.lit(False)
        return a.eqNullSafe(b) | F.coalesce(near, F.lit(False))

    differs = F.col("_there").isNull()
    for c in names:
        differs = differs | ~same(c)
    return new.join(was, key, "left").where(differs).select(*new.columns)
