"""Derived tables that follow their tracks: only the parts that changed are derived anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts that devices are dealt into; a part is the unit that is derived and replaced.
PARTS = 64


def part(device: str = "device_id", parts: int = PARTS):
    return F.pmod(F.hash(device), F.lit(parts)).alias("part")


def _marker(path: str) -> str:
    return f"{path.rstrip('/')}.parts"


def parts_of(spark: SparkSession, path: str, asked: int | None = None) -> int:
    """How many parts a table was dealt into, as kept beside it; asking for another number is an error."""
    parts = spark.read.parquet(_marker(path)).first()["parts"]
    if asked not in (None, parts):
        raise ValueError(f"{path} has {parts} parts, not {asked}")
    return parts


def rebuild(tracks: DataFrame, derive: Callable[[DataFrame], DataFrame], path: str, parts: int = PARTS) -> None:
    """Derives a whole table and writes it by parts."""
    spark = tracks.sparkSession
    derive(tracks).withColumn("part", part(parts=parts)).write.mode("overwrite").partitionBy("part").parquet(path)
    spark.createDataFrame([(parts,)], "parts int").coalesce(1).write.mode("overwrite").parquet(_marker(path))


def dealt(tracks: DataFrame, path: str, parts: int = PARTS) -> None:
    """Writes tracks by parts, so that a refresh reads the parts that it derives and no others."""
    rebuild(tracks, lambda t: t, path, parts)


def of_parts(tracks: DataFrame, numbers: list[int], parts: int) -> DataFrame:
    """The tracks of some parts; those of a table with a column part (``dealt``) are found by their folders."""
    if "part" in tracks.columns:
        return tracks.where(F.col("part").isin(numbers)).drop("part")
    return tracks.where(part(parts=parts).isin(numbers))


def refresh(spark: SparkSession, changed: DataFrame, tracks: DataFrame, derive: Callable[[DataFrame], DataFrame], path: str, parts: int | None = None) -> None:
    """Derives the parts that hold a changed device, and replaces those only.

    changed: device_id. A part with nothing left to derive is emptied, so a device
    whose tracks are all gone leaves no rows. The parts are a closed list. tracks
    that were dealt have as many parts as the table.
    """
    parts = parts_of(spark, path, parts)
    numbers = [r["part"] for r in changed.select(part(parts=parts)).distinct().collect()]
    if not numbers:
        return
    derived = derive(of_parts(tracks, numbers, parts)).withColumn("part", part(parts=parts))
    derived.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    left = {r["part"] for r in of_parts(tracks, numbers, parts).select(part(parts=parts)).distinct().collect()}
    for n in set(numbers) - left:
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part={n}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def follow(stream: DataFrame, tracks_of: Callable[[], DataFrame], derive: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, parts: int | None = None, every: str | None = None):
    """A query that refreshes the derived table for each micro-batch of changes; stream: device_id, ...

    It ends when there are no more changes, or with ``every`` (as "10 seconds") goes
    on and takes them as they come. A batch that runs twice derives the same rows
    twice. Parts without a change keep their rows.
    """

    def apply(batch: DataFrame, _: int) -> None:
        refresh(batch.sparkSession, batch.select("device_id"), tracks_of(), derive, path, parts)

    when = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**when).start()
