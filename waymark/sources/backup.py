"""Backup files: one JSON document per device, gzipped; points are arrays that a header describes.

Written as lines, a track on each, so that no task holds more than one track as
text; read by a data source that takes a document a track at a time, however its
lines are broken.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from waymark.sources.pull import Pull

FORMAT, VERSION = "waymark-backup", 1
# The order of a point's fields in files that are written.
POINT_FIELDS = ("timestamp", "lat", "lon", "alt", "accuracy", "speed", "bearing", "verticalAccuracy", "speedAccuracy", "bearingAccuracy", "satellitesInFix", "cn0", "ignored", "ignoreReason", "segmentStart")
COLUMNS = {"timestamp": "ts_ms", "verticalAccuracy": "vertical_accuracy", "speedAccuracy": "speed_accuracy", "bearingAccuracy": "bearing_accuracy", "satellitesInFix": "satellites", "ignoreReason": "ignore_reason", "segmentStart": "segment_start"}
_ROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "boolean": pa.bool_()}
KINDS = {"timestamp": "long", "lat": "double", "lon": "double", "alt": "double", "satellitesInFix": "int", "ignored": "boolean", "ignoreReason": "string", "segmentStart": "boolean"}
#: What the source gives, by kind; device_id is the folder's.
SCHEMAS = {
    "tracks": "device_id long, track_id long, activity string, started_at long, ended_at long, source string, distance_m double, ignored_count int, good_count int",
    "points": "device_id long, track_id long, seq int, " + ", ".join(f"{COLUMNS.get(f, f)} {KINDS.get(f, 'float')}" for f in POINT_FIELDS),
    "places": "device_id long, place_id long, seed_index long, label string, lat double, lon double, created_at long, radius_m double, category string",
}
RADIUS_M = 150.0


def _json(value: Column) -> Column:
    """A scalar in JSON; null is null."""
    inner = F.to_json(F.struct(value.alias("x")), {"ignoreNullFields": "false"})
    return F.substring(inner, F.lit(6), F.length(inner) - 6)


def _object(names: dict[str, Column]) -> Column:
    parts = [F.concat(F.lit(f'"{k}":'), _json(v)) for k, v in names.items()]
    return F.concat_ws(",", *parts)


def write_backup(tracks: DataFrame, points: DataFrame, places: DataFrame, path: str, exported_at: int) -> None:
    """One gzipped document per device under ``path``/device_id=<id>/; open and discarded tracks are left out.

    tracks, points and places as in ``waymark.schemas``, tracks with the columns of
    ``operators.tracks.stats`` besides.
    """
    t = tracks.where("ended_at is not null")
    if "discarded_at" in tracks.columns:
        t = t.where("discarded_at is null")
    has = lambda c: F.col(c) if c in points.columns else F.lit(None)
    flag = lambda c: F.coalesce(has(c).cast("int"), F.lit(0))
    fields = [flag(f if f == "ignored" else "segment_start") if f in ("ignored", "segmentStart") else has(COLUMNS.get(f, f)) for f in POINT_FIELDS]
    order = "point_id" if "point_id" in points.columns else "seq"
    row = F.concat(F.lit("["), F.concat_ws(",", *[_json(f) for f in fields]), F.lit("]"))
    lines = points.groupBy("device_id", "track_id").agg(F.array_sort(F.collect_list(F.struct("ts_ms", order, row.alias("row")))).alias("p"))
    t = t.join(lines, ["device_id", "track_id"], "left")
    head = _object({"id": F.col("track_id"), "activityType": F.col("activity"), "startedAt": F.col("started_at"), "endedAt": F.col("ended_at"), "source": F.col("source"), "distanceMeters": F.col("distance_m"), "pointCount": F.col("good_count") + F.col("ignored_count"), "ignoredCount": F.col("ignored_count"), "startLat": F.col("start_lat"), "startLon": F.col("start_lon"), "endLat": F.col("end_lat"), "endLon": F.col("end_lon")})
    body = F.array_join(F.transform(F.coalesce("p", F.array().cast(t.schema["p"].dataType)), lambda x: x["row"]), ",")
    track = F.concat(F.lit("{"), head, F.lit(',"points":['), body, F.lit("]}"))
    pin = F.concat(F.lit("{"), _object({"id": F.col("place_id"), "label": F.col("label"), "lat": F.col("lat"), "lon": F.col("lon"), "createdAt": F.col("created_at") if "created_at" in places.columns else F.col("seed_index"), "radiusM": F.col("radius_m")}), F.when(F.col("category").isNotNull(), F.concat(F.lit(',"category":'), _json(F.col("category")))).otherwise(""), F.lit("}"))
    n = t.groupBy("device_id").agg(F.count("*").alias("n"))
    names = ",".join(f'"{f}"' for f in POINT_FIELDS)
    opening = F.concat(F.lit(f'{{"format":"{FORMAT}","version":{VERSION},"exportedAt":{exported_at},"trackCount":'), F.col("n").cast("string"), F.lit(f',"pointFields":[{names}],"tracks":['))
    line = lambda df, part, at, text: df.select("device_id", F.lit(part).alias("part"), F.struct(*at).alias("at"), text.alias("value"))
    zero = [F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")]
    parts = [
        line(n, 0, zero, opening),
        line(t, 1, [F.col("started_at").alias("x"), F.col("track_id").alias("y")], track),
        line(n, 2, zero, F.lit('],"places":[')),
        line(places.join(n, "device_id", "left_semi"), 3, [F.col("seed_index").cast("long").alias("x"), F.col("place_id").cast("long").alias("y")], pin),
        line(n, 4, zero, F.lit("]}")),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    dealt = whole.repartition("device_id").sortWithinPartitions("device_id", "part", "at")
    # a comma in front of all but the first line of a list
    before = F.lag("part").over(_in_device())
    dealt = dealt.withColumn("value", F.when(F.col("part").isin(1, 3) & (before == F.col("part")), F.concat(F.lit(","), F.col("value"))).otherwise(F.col("value")))
    dealt.select("device_id", "value").write.partitionBy("device_id").option("compression", "gzip").text(path)


def _in_device():
    from pyspark.sql import Window

    return Window.partitionBy("device_id").orderBy("part", "at")


class _Fields:
    """Where a document's points have each field; built once from its header."""

    def __init__(self, names):
        self.at = {f: names.index(f) for f in POINT_FIELDS if f in (names or ())}
        for f in ("timestamp", "lat", "lon"):
            if f not in self.at:
                raise ValueError("pointFields lacks a needed field")

    def column(self, points: list[list], f: str) -> pa.Array:
        """One field of a track's points; points may be shorter than the header."""
        k, kind = self.at.get(f), KINDS.get(f, "float")
        cells = [None] * len(points) if k is None else [p[k] if k < len(p) else None for p in points]
        if f in ("timestamp", "lat", "lon") and None in cells:
            raise ValueError(f"point without {f}")
        if kind == "boolean":
            cells = [bool(c) for c in cells]
        elif kind in ("long", "int"):
            cells = [None if c is None else int(c) for c in cells]
        return pa.array(cells, _ROW[kind])

    def recorded(self, points: list[list]) -> bool:
        k = self.at.get("accuracy")
        return k is not None and any(k < len(p) and p[k] is not None for p in points)


def documents(stream: io.TextIOBase, formats: tuple[str, ...]) -> Iterator[tuple[str, dict, _Fields | None]]:
    """("tracks", track, fields) and ("places", place, None) of a document, one after the other.

    A document of another format or version fails, and so does one whose tracks come
    before its header. Other keys are passed over without being held.
    """
    json, known, version, fields = Pull(stream), False, False, None
    for key in json.members():
        if key == "format":
            if not (known := json.value() in formats):
                raise ValueError("no backup of a known version")
        elif key == "version":
            given = json.value()
            if not (version := isinstance(given, int) and 1 <= given <= VERSION):
                raise ValueError("no backup of a known version")
        elif key == "pointFields":
            fields = _Fields(json.value())
        elif key == "tracks":
            if not (known and version):
                raise ValueError("no backup of a known version")
            if fields is None:
                raise ValueError("pointFields lacks a needed field")
            for track in json.elements():
                yield key, track, fields
        elif key == "places":
            for place in json.elements():
                yield key, place, None
        else:
            json.skip()
    json.end()
    if not (known and version):
        raise ValueError("no backup of a known version")


def _track(device: int | None, t: dict, fields: _Fields) -> pa.RecordBatch:
    if t.get("activityType") is None:
        raise ValueError("track without activityType")
    points = t.get("points") or []
    # a file that doesn't say who wrote a track is told by its fixes
    source = t.get("source") or (("recorded" if fields.recorded(points) else "imported") if points else None)
    n, ignored = t.get("pointCount") or 0, t.get("ignoredCount") or 0
    row = (device, t.get("id") or 0, t["activityType"], t.get("startedAt") or 0, t.get("endedAt"), source, float(t.get("distanceMeters") or 0), ignored, n - ignored)
    return _batch("tracks", [[c] for c in row])


def _points(device: int | None, t: dict, fields: _Fields) -> pa.RecordBatch:
    points = t.get("points") or []
    n = len(points)
    return _batch("points", [pa.array([device] * n, pa.int64()), pa.array([t.get("id") or 0] * n, pa.int64()), pa.array(range(n), pa.int32()), *(fields.column(points, f) for f in POINT_FIELDS)])


def _place(device: int | None, p: dict, seed: int) -> pa.RecordBatch:
    radius, category = p.get("radiusM"), p.get("category")
    row = (device, p.get("id") or 0, seed, p.get("label") or "", float(p.get("lat") or 0), float(p.get("lon") or 0), p.get("createdAt") or 0, RADIUS_M if radius is None else float(radius), category if isinstance(category, str) else None)
    return _batch("places", [[c] for c in row])


def _batch(kind: str, columns: list) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in SCHEMAS[kind].split(", ")))
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, _ROW[k]) for c, k in zip(columns, kinds)], list(names))


def batches(stream: io.TextIOBase, kind: str, device: int | None, formats: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Rows of one kind of one document, a track's points at a time."""
    seed = 0
    for key, item, fields in documents(stream, formats):
        if key == kind == "tracks":
            yield _track(device, item, fields)
        elif key == "tracks" and kind == "points":
            yield _points(device, item, fields)
        elif key == kind == "places":
            yield _place(device, item, seed)
            seed += 1


@dataclass
class Document(InputPartition):
    path: str
    device: int | None


class BackupReader(DataSourceReader):
    """One partition a document; a gzipped one can't be entered in its middle."""

    def __init__(self, options):
        self.where, self.kind = options["path"], options.get("kind", "points")
        self.formats = tuple(options.get("formats", FORMAT).split(","))

    def partitions(self) -> list[Document]:
        system, path = fs.FileSystem.from_uri(self.where)
        found = system.get_file_info([path])[0]
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.where)
        files = [found] if found.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        names = [f.path for f in files if f.is_file and not f.base_name.startswith(("_", "."))]
        device = lambda name: int(m[1]) if (m := re.search(r"(?:^|/)device_id=(-?\d+)/", name)) else None
        return [Document(name, device(name)) for name in sorted(names)]

    def read(self, partition: Document) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.where)
        with system.open_input_stream(partition.path, compression=None) as raw:
            bytes_ = io.BufferedReader(raw)
            packed = bytes_.peek(2)[:2] == b"\x1f\x8b"
            yield from batches(io.TextIOWrapper(gzip.GzipFile(fileobj=bytes_) if packed else bytes_, "utf-8"), self.kind, partition.device, self.formats)


class BackupSource(DataSource):
    """spark.read.format("waymark_backup"): path, kind (tracks, points or places), formats (comma-separated)."""

    @classmethod
    def name(cls) -> str:
        return "waymark_backup"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "points")]

    def reader(self, schema) -> BackupReader:
        return BackupReader(self.options)


def read_backup(spark: SparkSession, path: str, formats: tuple[str, ...] = (FORMAT,)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tracks, points, places) of the documents under a path; the device is the folder's name.

    A document of another format or version fails, as does a header without the
    fields that a point needs, one that comes after the tracks, or a point without
    them. Unknown fields and keys are passed over; what is missing gets its default.
    A document is a partition; a task holds one of its tracks at a time. The path may
    be of any file system that Arrow knows.
    """
    spark.dataSource.register(BackupSource)
    read = lambda kind: spark.read.format(BackupSource.name()).option("kind", kind).option("formats", ",".join(formats)).load(path)
    return read("tracks"), read("points"), read("places")
