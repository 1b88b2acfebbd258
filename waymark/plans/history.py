"""One data set's history as lazy frames: what the registered queries start from."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import intervals, journeys, places, tracks
from waymark.sources import event_tracks
from waymark.sources.shared import dealt, kept

#: The instant that open intervals last until, and that periods are told from.
NOW_MS = 1_706_700_000_000
#: The pin that is home.
HOME = 0
#: Tracks in one part of the fixes, about: sorts of their fixes stay in a task's memory.
PART_TRACKS = 20_000


class History:
    """Tracks, points and what follows from them; frames are plans, but for those that say that they are written."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def tracks(self) -> DataFrame:
        return event_tracks.tracks(event_tracks.table(self.spark, self.sf_dir, "events"))

    @cached_property
    def points(self) -> DataFrame:
        # dealt by track before a track becomes its fixes, so that what goes by track needs no other shuffle
        return event_tracks.points(dealt(self.tracks, "device_id", "track_id", rows=self.track_count, each=PART_TRACKS))

    @cached_property
    def track_count(self) -> int:
        """A track an event, so that Parquet's footers tell it."""
        return event_tracks.table(self.spark, self.sf_dir, "events").count()

    @cached_property
    def pins(self) -> DataFrame:
        return event_tracks.pins(self.tracks)

    @cached_property
    def atlas(self) -> DataFrame:
        return event_tracks.atlas(event_tracks.table(self.spark, self.sf_dir, "nation"))

    @cached_property
    def stats(self) -> DataFrame:
        return tracks.stats(self.points)

    @cached_property
    def ends(self) -> DataFrame:
        """Tracks with their statistics: first and last good place, counts, metres. Written once: a row a track, out of all its fixes."""
        return kept(self.tracks.join(self.stats.hint("merge"), ["device_id", "track_id"]), "ends")

    @cached_property
    def endpoints(self) -> DataFrame:
        """A row per known end of a track: is_start, at_ms, lat, lon."""
        row = lambda start: F.struct(F.lit(start).alias("is_start"), F.col("started_at" if start else "ended_at").alias("at_ms"), F.col(f"{'start' if start else 'end'}_lat").alias("lat"), F.col(f"{'start' if start else 'end'}_lon").alias("lon"))
        e = self.ends.select("device_id", "track_id", "started_at", F.explode(F.array(row(True), row(False))).alias("x"))
        return e.select("device_id", "track_id", "started_at", "x.*").where("lat is not null and lon is not null")

    @cached_property
    def end_pins(self) -> DataFrame:
        return places.nearest_pin(self.endpoints, self.pins, ["device_id", "track_id", "is_start"])

    @cached_property
    def pinned(self) -> DataFrame:
        """Ends with start_pin and end_pin; written once, as nights, stays and windows each ask for them."""
        of = lambda start, name: self.end_pins.where(F.col("is_start") == start).select("device_id", "track_id", F.col("pin").alias(name))
        key = ["device_id", "track_id"]
        return kept(self.ends.join(of(True, "start_pin").hint("merge"), key, "left").join(of(False, "end_pin").hint("merge"), key, "left"), "pinned")

    @cached_property
    def intervals(self) -> DataFrame:
        """What lies between neighbouring tracks, by distance alone."""
        return intervals.verdicts(intervals.between_tracks(self.ends))

    @cached_property
    def pin_intervals(self) -> DataFrame:
        """What lies between neighbouring tracks; one pin at both ends is one place."""
        return intervals.verdicts(intervals.between_tracks(self.pinned))

    @cached_property
    def stays(self) -> DataFrame:
        return self.intervals.where("kind = 'STAY'")

    @cached_property
    def pin_stays(self) -> DataFrame:
        """Stays at pins: pin, label, category."""
        s = self.pin_intervals.where("kind = 'STAY'").withColumn("pin", F.coalesce("from_pin", "to_pin"))
        p = self.pins.select("device_id", F.col("seed_index").alias("pin"), "place_id", "label", "category")
        return s.where("pin is not null").join(p.hint("merge"), ["device_id", "pin"])

    @cached_property
    def home(self) -> DataFrame:
        return self.pins.where(F.col("seed_index") == HOME)

    @cached_property
    def nights(self) -> DataFrame:
        spans = self.tracks.groupBy("device_id").agg(F.min("started_at").alias("first_at"), F.max("ended_at").alias("last_at"))
        spans = spans.join(self.home.hint("merge"), "device_id").withColumn("offset_ms", journeys.solar_offset_ms(F.col("lon")))
        return journeys.nights(spans)

    @cached_property
    def night_places(self) -> DataFrame:
        at = lambda side: F.coalesce(F.col(f"{side}_pin") == HOME, F.lit(False)).alias(f"{side}_home")
        i = self.pin_intervals.select("device_id", "kind", "start", "end", at("from"), at("to"))
        return journeys.night_places(self.nights, i, self.tracks, self.points, self.home)

    @cached_property
    def journeys(self) -> DataFrame:
        """Written once: few rows, and what asks for them asks several times."""
        return kept(journeys.runs(self.night_places), "journeys")

    @cached_property
    def home_stays(self) -> DataFrame:
        return self.pin_stays.where(F.col("pin") == HOME).select("device_id", "start", "end")

    @cached_property
    def windows(self) -> DataFrame:
        return kept(journeys.windows(self.journeys, kept(self.home_stays, "home"), NOW_MS), "windows")

    @cached_property
    def timeline(self) -> DataFrame:
        days = intervals.per_day(self.stays, F.lit(NOW_MS))
        halves = intervals.gap_halves(self.intervals.where("kind = 'GAP'"))
        cut = ["device_id", "kind", "after_track_id", "slice_start", "slice_end", "holds_start", "holds_end"]
        return intervals.timeline(self.tracks, days.select(*cut).unionByName(halves.select(*cut)))
