"""Places: nearest pins, capture contests, neighbourhoods, summaries, and greedy clusters of endpoints."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.config import Stays
from waymark.functions.geo import Distance, cell, haversine_m, one_ellipsoid_m
from waymark.sources.shared import dealt

#: Grid of the joins by distance, in degrees; a reach within it needs only neighbouring cells.
CELL = 0.02
#: The radius of a place that is new, in metres.
NEW_RADIUS_M = 150.0


def near_pairs(points: DataFrame, pins: DataFrame, distance: Distance = haversine_m) -> DataFrame:
    """points (device_id, lat, lon, ...) with the pins whose own radius holds them: pin_*, metres.

    Pins are dealt into all cells that their radius touches, so the join is by cell.
    """
    reach = F.col("radius_m") / 110_000.0 * 1.002
    wide = reach / F.greatest(F.lit(0.01), F.cos(F.radians(F.abs(F.col("lat")) + reach)))
    cells = lambda c, r: F.sequence(F.floor((c - r) / CELL).cast("long"), F.floor((c + r) / CELL).cast("long"))
    p = pins.withColumn("_y", F.explode(cells(F.col("lat"), reach))).withColumn("_x", F.explode(cells(F.col("lon"), wide)))
    p = p.select("device_id", "_y", "_x", *[F.col(c).alias(f"pin_{c}") for c in pins.columns if c != "device_id"])
    q = points.withColumn("_y", cell(F.col("lat"), CELL)).withColumn("_x", cell(F.col("lon"), CELL))
    j = q.join(p.hint("merge"), ["device_id", "_y", "_x"]).withColumn("metres", distance(F.col("lat"), F.col("lon"), F.col("pin_lat"), F.col("pin_lon")))
    return j.where("metres <= pin_radius_m").drop("_y", "_x")


def captured(points: DataFrame, pins: DataFrame, distance: Distance = haversine_m) -> DataFrame:
    """Pins with captured, the number of points within their radius; 0 for a pin without any."""
    n = near_pairs(points, pins, distance).groupBy("device_id", F.col("pin_seed_index").alias("seed_index")).agg(F.count("*").alias("captured"))
    return pins.join(n, ["device_id", "seed_index"], "left").withColumn("captured", F.coalesce("captured", F.lit(0)).cast("long"))


def end_places(drafts: DataFrame, pins: DataFrame, keys: list[str], distance: Distance = haversine_m) -> DataFrame:
    """keys, side (from, to), label, lat, lon, radius_m: the places that trips entered by hand add at their ends.

    drafts: keys, with device_id among them, from_lat, from_lon, from_label, to_lat,
    to_lon, to_label. An end adds a place unless its trimmed label is null or empty,
    its coordinates are null, or a pin holds it; the second end, unless the place that
    the first one adds holds it. Trips are judged one by one, against the same pins.
    """
    side = lambda s: F.struct(F.lit(s).alias("side"), F.trim(f"{s}_label").alias("label"), F.col(f"{s}_lat").alias("lat"), F.col(f"{s}_lon").alias("lon"))
    ends = drafts.select(*keys, F.explode(F.array(side("from"), side("to"))).alias("x")).select(*keys, "x.*")
    ends = nearest_pin(ends.where("label != '' and lat is not null and lon is not null"), pins, [*keys, "side"], distance).where("pin is null").drop("pin", "metres")
    first = ends.where("side = 'from'").select(*keys, F.col("lat").alias("_y"), F.col("lon").alias("_x"))
    e = ends.join(first, keys, "left")
    held = (F.col("side") == "to") & (distance(F.col("_y"), F.col("_x"), F.col("lat"), F.col("lon")) <= NEW_RADIUS_M)
    return e.where(~F.coalesce(held, F.lit(False))).drop("_y", "_x").withColumn("radius_m", F.lit(NEW_RADIUS_M))


def nearest_pin(points: DataFrame, pins: DataFrame, keys: list[str], distance: Distance = haversine_m) -> DataFrame:
    """points with pin (seed_index) and metres of the nearest pin that holds them, the first one on ties; else null."""
    best = near_pairs(points, pins, distance).groupBy(*keys).agg(F.min(F.struct("metres", F.col("pin_seed_index").alias("pin"))).alias("best"))
    return points.join(best.hint("merge"), keys, "left").select(*points.columns, "best.pin", "best.metres")


def contested(points: DataFrame, pins: DataFrame, candidate: int, keys: list[str]) -> DataFrame:
    """Points that a candidate pin holds, with lost: whether another pin that holds them is strictly nearer."""
    near = near_pairs(points, pins)
    mine = near.where(F.col("pin_seed_index") == candidate).select(*keys, F.col("metres").alias("mine"))
    rival = near.where(F.col("pin_seed_index") != candidate).groupBy(*keys).agg(F.min("metres").alias("rival"))
    return mine.join(rival, keys, "left").select(*keys, F.coalesce(F.col("rival") < F.col("mine"), F.lit(False)).alias("lost"))


def neighbourhood(pins: DataFrame, within_m: float = 2_000.0, distance: Distance = haversine_m) -> DataFrame:
    """Pairs of a device's pins within some metres of each other, not the same one."""
    near = near_pairs(pins, pins.withColumn("radius_m", F.lit(within_m)), distance)
    return near.where("place_id != pin_place_id").select("device_id", "place_id", F.col("pin_place_id").alias("near_id"), "metres")


def summaries(visits: DataFrame, pins: DataFrame, now_ms: int) -> DataFrame:
    """Per pin: visits, last seen and time spent; visits: device_id, pin, start, end. Pins without visits have zeros and nulls."""
    end = F.coalesce(F.col("end"), F.lit(now_ms))
    v = visits.where(F.col("end").isNull() | (F.col("end") != F.col("start"))).groupBy("device_id", F.col("pin").alias("seed_index")).agg(F.count("*").alias("visits"), F.max(end).alias("last_seen"), F.sum(end - F.col("start")).alias("spent_ms"))
    p = pins.join(v, ["device_id", "seed_index"], "left")
    return p.select("device_id", "place_id", "label", F.coalesce("visits", F.lit(0)).alias("visits"), "last_seen", F.coalesce("spent_ms", F.lit(0)).alias("spent_ms"))


CLUSTERED = "device_id long, track_id long, is_start boolean, cluster long, seed long, anchor_lat double, anchor_lon double"


def greedy_clusters(ends: DataFrame, pins: DataFrame, rule: Stays = Stays(), distance: Callable[[float, float, float, float], float] = one_ellipsoid_m, along: tuple[str, ...] = ()) -> DataFrame:
    """Each endpoint's cluster, by a leader rule that depends on the order of endpoints.

    ends: device_id, track_id, started_at, is_start, lat, lon. Pins are the first
    anchors, with their own radii. An endpoint joins the nearest anchor whose radius
    holds it, the first one on ties, or else founds an anchor. The order is by
    (started_at, track_id), start before end; endpoints without a place are left
    out. What a device holds is one ordered stream: Spark deals and sorts the rows,
    pins before endpoints, and a task walks them from device to device, so it holds
    one device's anchors, and a device of few rows costs no group of its own.
    Anchors are kept in a grid, so an endpoint is measured only against near ones:
    those whose difference in latitude alone doesn't put them out of reach.
    Further columns of ends go along with each row, so that nothing is joined back to it.
    """
    own = {"started_at": "long", "lat": "double", "lon": "double"}
    extra = [c for c in along if c not in own]
    kinds = {c: ends.schema[c].dataType.simpleString() for c in extra}
    schema = ", ".join([CLUSTERED, *(f"{c} {own.get(c) or kinds[c]}" for c in along)])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        device, anchors = object(), None
        for batch in batches:
            ends, picks = [], []
            for n, (of, is_end, y, x, reach) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("device_id", "is_end", "lat", "lon", "reach")))):
                if of != device:
                    device, anchors = of, Anchors(rule.cluster_radius_m, distance)
                if is_end:
                    ends.append(n)
                    picks.append(anchors.join(y, x))
                else:
                    anchors.seed(y, x, reach)
            rows = batch.take(pa.array(ends, pa.int64()))
            key, more = rows.select(["device_id", "track_id", "is_start"]), rows.select(list(along))
            cluster, seed, lat, lon = zip(*picks) if picks else ((),) * 4
            yield pa.RecordBatch.from_arrays([*key.columns, pa.array(cluster, pa.int64()), pa.array(seed, pa.int64()), pa.array(lat, pa.float64()), pa.array(lon, pa.float64()), *more.columns], [c.split()[0] for c in schema.split(", ")])

    none = lambda kind: F.lit(None).cast(kind)
    columns = lambda is_end, seed, at, track, start, reach: [F.col("device_id").cast("long").alias("device_id"), F.lit(is_end).alias("is_end"), seed.cast("long").alias("seed_index"), at.cast("long").alias("started_at"), track.cast("long").alias("track_id"), start.alias("is_start"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), reach.cast("double").alias("reach")]
    e = ends.where("lat is not null and lon is not null").select(*columns(True, none("long"), F.col("started_at"), F.col("track_id"), F.col("is_start"), none("double")), *extra)
    s = pins.where("device_id is not null").select(*columns(False, F.col("seed_index"), none("long"), none("long"), none("boolean"), F.col("radius_m")), *(none(kinds[c]).alias(c) for c in extra))
    # a walk takes far longer than its rows are large. Spark leaves out a deal by columns that both tables come dealt by,
    # and then merges each one's parts in its own way, so a device's pins and endpoints would part; by a hash it can't
    rows = dealt(e.unionByName(s), F.xxhash64("device_id")).sortWithinPartitions("device_id", "is_end", "seed_index", F.col("started_at").asc_nulls_last(), F.col("track_id").asc_nulls_last(), F.desc("is_start"))
    return rows.mapInArrow(walk, schema)


class Anchors:
    """One device's anchors in the order in which they came, pins first, in a grid as wide as the widest reach."""

    def __init__(self, radius: float, distance: Callable[[float, float, float, float], float]):
        self.radius, self.distance = radius, distance
        self.lat, self.lon, self.reach = [], [], []
        self.grid: dict[int, dict[int, list[int]]] | None = None  # built when all pins are there
        self.widths: dict[int, float] = {}
        self.pins = 0

    def seed(self, y: float, x: float, reach: float) -> None:
        self.lat.append(y)
        self.lon.append(x)
        self.reach.append(reach)
        self.pins += 1

    def width(self, row: int) -> float:
        # longitudes shrink with latitude: a row's cells are as wide as its far edge needs
        if row not in self.widths:
            self.widths[row] = self.size / max(0.01, math.cos(math.radians(min(89.4, (abs(row) + 2) * self.size))))
        return self.widths[row]

    def put(self, k: int) -> None:
        row = math.floor(self.lat[k] / self.size)
        self.grid.setdefault(row, {}).setdefault(math.floor(self.lon[k] / self.width(row)), []).append(k)

    def join(self, y: float, x: float) -> tuple[int, int | None, float, float]:
        """The anchor that an endpoint joins or founds: number, the same if it is a pin's, lat, lon."""
        if self.grid is None:
            self.size, self.grid = max([self.radius, *self.reach]) / 110_000 * 1.01, {}
            for k in range(self.pins):
                self.put(k)
        lat, lon, reach = self.lat, self.lon, self.reach
        at, pick, best = math.floor(y / self.size), -1, math.inf
        for row in (at - 1, at, at + 1):
            cells = self.grid.get(row)
            if not cells:
                continue
            column = math.floor(x / self.width(row))
            for c in (column - 1, column, column + 1):
                for k in cells.get(c, ()):
                    if abs(lat[k] - y) * 110_000 > reach[k]:
                        continue
                    d = self.distance(y, x, lat[k], lon[k])
                    if d <= reach[k] and (d < best or d == best and k < pick):
                        pick, best = k, d
        if pick < 0:
            pick = len(lat)
            lat.append(y)
            lon.append(x)
            reach.append(self.radius)
            self.put(pick)
        return pick, pick if pick < self.pins else None, lat[pick], lon[pick]


def centroids(members: DataFrame) -> DataFrame:
    """members: device_id, cluster, lat, lon. The mean of each cluster's members."""
    return members.groupBy("device_id", "cluster").agg(F.count("*").alias("members"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def recenter(captured: DataFrame, pins: DataFrame, least_m: float = 10.0) -> DataFrame:
    """Where a pin's captured points lie on average, if that is some metres off the pin."""
    mean = captured.groupBy("device_id", F.col("pin").alias("seed_index")).agg(F.avg("lat").alias("to_lat"), F.avg("lon").alias("to_lon"))
    j = pins.join(mean, ["device_id", "seed_index"]).withColumn("off_m", haversine_m(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon")))
    return j.where(F.col("off_m") >= least_m).select("device_id", "place_id", "to_lat", "to_lon", "off_m")
