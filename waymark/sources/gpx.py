"""GPX files, read by Spark's XML reader and written as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions.text import activity_of_gpx

SPEEDS = "`TrackPointExtension`: struct<speed: double>, `gpxtpx:TrackPointExtension`: struct<`gpxtpx:speed`: double, speed: double>, speed: double, `gpxtpx:speed`: double"
TRACK = f"name string, type string, trkseg array<struct<trkpt: array<struct<_lat: double, _lon: double, ele: double, time: string, speed: double, extensions: struct<{SPEEDS}>>>>>"


def read_gpx(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tracks, points): file, track_no, activity and kept; and what stands in them: seg, pos, ts_ms, lat, lon, alt, speed.

    Points without a coordinate go. A time without a zone is UTC.
    """
    t = spark.read.format("xml").option("rowTag", "trk").schema(TRACK).load(path).withColumn("file", F.input_file_name())
    t = t.withColumn("track_no", F.monotonically_increasing_id())
    tracks = t.select("file", "track_no", activity_of_gpx(F.col("type")).alias("activity"))
    p = t.select("file", "track_no", F.posexplode("trkseg").alias("seg", "s")).select("file", "track_no", "seg", F.posexplode("s.trkpt").alias("pos", "p"))
    e = F.col("p.extensions")
    speed = F.coalesce("p.speed", e["gpxtpx:TrackPointExtension"]["gpxtpx:speed"], e["gpxtpx:TrackPointExtension"]["speed"], e["TrackPointExtension"]["speed"], e["gpxtpx:speed"], e["speed"])
    ms = F.unix_millis(F.try_to_timestamp(F.col("p.time")))
    points = p.select("file", "track_no", "seg", "pos", ms.alias("ts_ms"), F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon"), F.col("p.ele").alias("alt"), speed.alias("speed"))
    return tracks, points.where("lat is not null and lon is not null")


def importable(points: DataFrame) -> DataFrame:
    """The points that a track can be made of, with seq and segment_start; tracks with fewer than two are left out.

    Untimed points go, a segment's points are in order of time, a point that
    repeats the one before it goes, and segments are in order of their first time.
    """
    key = ["file", "track_no"]
    w = Window.partitionBy(*key, "seg").orderBy("ts_ms", "pos")
    p = points.where("ts_ms is not null")
    again = (F.lag("ts_ms").over(w) == F.col("ts_ms")) & (F.lag("lat").over(w) == F.col("lat")) & (F.lag("lon").over(w) == F.col("lon"))
    p = p.withColumn("_again", F.coalesce(again, F.lit(False))).where("not _again").drop("_again")
    p = p.withColumn("_first", F.min("ts_ms").over(Window.partitionBy(*key, "seg")))
    whole = Window.partitionBy(*key).orderBy("_first", "seg", "ts_ms", "pos")
    p = p.withColumn("_n", F.count("*").over(Window.partitionBy(*key))).where("_n >= 2")
    p = p.withColumn("seq", F.row_number().over(whole) - 1).withColumn("segment_start", F.coalesce(F.lag("seg").over(whole) != F.col("seg"), F.lit(False)))
    return p.drop("_first", "_n")


def _time(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def gpx_documents(tracks: DataFrame, points: DataFrame) -> DataFrame:
    """device_id, track_id, file_name, gpx: one document a track, a segment from each break on. Times are to the second, in UTC."""
    # measures are gathered, and become text within their track: text takes several times as much
    carried = [c for c in ("alt", "speed") if c in points.columns]
    fix = F.struct("ts_ms", "seq", "lat", "lon", *carried, "segment_start")
    fixes = points.groupBy("device_id", "track_id").agg(F.array_sort(F.collect_list(fix)).alias("fixes"))

    def text(x: Column, n: Column) -> Column:
        has = lambda c, before, after: F.when(x[c].isNotNull(), F.concat(F.lit(before), x[c].cast("string"), F.lit(after))).otherwise("") if c in carried else F.lit("")
        cut = F.when((n > 0) & x["segment_start"], "    </trkseg>\n    <trkseg>\n").otherwise("")
        ele = has("alt", "        <ele>", "</ele>\n")
        speed = has("speed", "        <extensions><gpxtpx:TrackPointExtension><gpxtpx:speed>", "</gpxtpx:speed></gpxtpx:TrackPointExtension></extensions>\n")
        return F.concat(cut, F.lit('      <trkpt lat="'), x["lat"].cast("string"), F.lit('" lon="'), x["lon"].cast("string"), F.lit('">\n'), ele, F.lit("        <time>"), _time(x["ts_ms"]), F.lit("</time>\n"), speed, F.lit("      </trkpt>\n"))

    body = fixes.select("device_id", "track_id", F.array_join(F.transform("fixes", text), "").alias("body"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="waymark" xmlns="http://www.topografix.com/GPX/1/1" xmlns:gpxtpx="http://www.garmin.com/xmlschemas/TrackPointExtension/v2">\n  <trk>\n    <name>'
    j = tracks.join(body.hint("merge"), ["device_id", "track_id"])
    doc = F.concat(F.lit(head), F.col("activity"), F.lit(" "), _time(F.col("started_at")), F.lit("</name>\n    <type>"), F.col("activity"), F.lit("</type>\n    <trkseg>\n"), F.col("body"), F.lit("    </trkseg>\n  </trk>\n</gpx>"))
    stamp = F.date_format(F.timestamp_millis("started_at"), "yyyyMMdd-HHmmss")
    return j.select("device_id", "track_id", F.concat(F.lower("activity"), F.lit("-"), stamp, F.lit(".gpx")).alias("file_name"), doc.alias("gpx"))


def write_gpx(documents: DataFrame, path: str) -> None:
    """One file per track, in a folder named for the device and the file."""
    documents.select("device_id", "file_name", F.col("gpx").alias("value")).write.partitionBy("device_id", "file_name").text(path)
