"""Atlases as packed files: a header, rows of one width by latitude, then their names end to end.

A file has a marker of five bytes, the number of rows (int32), the number of zones
(uint16), each zone as a length byte and UTF-8, then for each row latitude and
longitude in millionths of a degree (int32 each), thousands of people (uint16), a
country of two letters, the zone's number (uint16) and its name's length in bytes
(uint8), then all names. Numbers are big-endian. An atlas may be several files, each
of a range of latitudes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.cities import ATLAS

MAGIC = b"WATL1"
ROW = np.dtype([("lat", ">i4"), ("lon", ">i4"), ("population_k", ">u2"), ("country", "S2"), ("zone", ">u2"), ("name", "u1")])
MOST_PEOPLE, MOST_NAME, MOST_ZONES = 0xFFFF, 0xFF, 0xFFFF


def encode(table: pa.Table, magic: bytes = MAGIC) -> bytes:
    """One file of an atlas's rows, which it puts in order of latitude; an error for a name or zone that doesn't fit."""
    names = [(n or "").encode() for n in table.column("name").to_pylist()]
    zone = [z or "" for z in table.column("zone").to_pylist()]
    zones = sorted(set(zone))
    if any(not 0 < len(n) <= MOST_NAME for n in names):
        raise ValueError(f"a city's name has 1 to {MOST_NAME} bytes")
    if len(zones) > MOST_ZONES or any(len(z.encode()) > 0xFF for z in zones):
        raise ValueError("zones don't fit")
    rows = np.zeros(len(names), ROW)
    for c in ("lat", "lon"):
        rows[c] = np.rint(table.column(c).to_numpy() * 1e6)
    rows["population_k"] = np.minimum(table.column("population_k").fill_null(0).to_numpy(), MOST_PEOPLE)
    rows["country"] = [c.encode("ascii") for c in table.column("country").to_pylist()]
    rows["zone"], rows["name"] = np.searchsorted(zones, zone) if zones else 0, [len(n) for n in names]
    order = np.lexsort((names, rows["lon"], rows["lat"])) if len(names) else np.zeros(0, int)
    head = b"".join([magic, len(names).to_bytes(4, "big"), len(zones).to_bytes(2, "big"), *(len(z.encode()).to_bytes(1, "big") + z.encode() for z in zones)])
    return head + rows[order].tobytes() + b"".join(names[k] for k in order)


def decode(data: bytes, magic: bytes = MAGIC) -> pa.RecordBatch:
    """An atlas's rows out of one file; an error for one with another marker, or one that is too short."""

    def need(end: int) -> int:
        if end > len(data):
            raise ValueError("a packed atlas is cut short")
        return end

    if data[: len(magic)] != magic:
        raise ValueError("not a packed atlas")
    at = len(magic)
    need(at + 6)
    count, zone_count = int.from_bytes(data[at : at + 4], "big", signed=True), int.from_bytes(data[at + 4 : at + 6], "big")
    if count < 0:
        raise ValueError(f"a packed atlas has {count} rows")
    at, zones = at + 6, []
    for _ in range(zone_count):
        end = need(need(at + 1) + data[at])
        zones.append(data[at + 1 : end].decode())
        at = end
    rows = np.frombuffer(data[at : need(at + count * ROW.itemsize)], ROW)
    if count and int(rows["zone"].max()) >= zone_count:
        raise ValueError("a packed atlas names a zone that it hasn't got")
    text = at + count * ROW.itemsize
    ends = text + np.cumsum(rows["name"], dtype=np.int64)
    need(int(ends[-1]) if count else text)
    starts = ends - rows["name"]
    names = [data[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
    degrees = lambda c: pa.array(rows[c].astype(np.float64) / 1e6)
    columns = [degrees("lat"), degrees("lon"), pa.array(rows["population_k"].astype(np.int32)), pa.array([c.decode("ascii") for c in rows["country"].tolist()], pa.string()), pa.array([zones[k] or None for k in rows["zone"].tolist()], pa.string()), pa.array(names, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["lat", "lon", "population_k", "country", "zone", "name"])


def packed(atlas: DataFrame, files: int = 1, magic: bytes = MAGIC) -> DataFrame:
    """file, content: an atlas as packed files, each of a range of latitudes.

    Rows without coordinates, and those whose country isn't two ASCII letters, are
    left out. A file is made by one task, so files is what bounds its memory. An empty
    atlas gives no file.
    """
    rows = atlas.where("lat is not null and lon is not null").where(F.col("country").rlike("^[A-Za-z]{2}$"))
    rows = rows.select("lat", "lon", F.col("population_k").cast("int").alias("population_k"), "country", "zone", "name")
    dealt = rows.repartitionByRange(files, "lat")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([encode(pa.Table.from_batches(held), magic)], pa.binary())], ["content"])

    made = dealt.mapInArrow(encoded, "content binary")
    return made.select(F.spark_partition_id().alias("file"), "content")


def parsed(files: DataFrame, magic: bytes = MAGIC) -> DataFrame:
    """The rows of packed files: of ``spark.read.format("binaryFile")``, or of ``packed``; a file that isn't one is an error."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield decode(content.as_py() or b"", magic)

    return files.select("content").mapInArrow(decoded, ATLAS)
