"""Tracks, points and places out of a plain table of events.

Each event of a user is one recorded track of ten fixes, from the place of the
user's previous event to its own; every ninth starts somewhere else, so that
there are gaps. Every seventeenth fix is an ignored one. All values follow from
the event's columns, so the same rows come out of any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIXES = 10
NAMED = ("Home", "Work", "Gym", "Shop")
CATEGORIES = ("home", "work", "sports", "shopping")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place_lat(device: Column, place: Column) -> Column:
    return F.lit(38.0) + device * F.lit(0.01) + place * F.lit(0.004)


def place_lon(device: Column, place: Column) -> Column:
    return F.lit(-9.0) + device * F.lit(0.01) + place * place * F.lit(0.002)


def tracks(events: DataFrame) -> DataFrame:
    """device_id, track_id, activity, source, from_place, to_place, started_at, ended_at."""
    e = events.select(F.col("event_id").alias("track_id"), F.col("user_id").alias("device_id"), "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    w = Window.partitionBy("device_id").orderBy("us", "track_id")
    e = e.withColumn("prev_id", F.lag("track_id").over(w)).withColumn("prev_us", F.lag("us").over(w))
    kind = F.col("event_type")
    activity = F.when(kind == "view", "WALKING").when(kind == "click", "RUNNING").when(kind == "purchase", "DRIVING").when(kind == "signup", "CYCLING").otherwise("UNKNOWN")
    t = F.col("track_id")
    start = F.when(F.col("prev_us").isNull(), F.col("us") - 600_000_000).otherwise(F.greatest(F.col("prev_us") + 1, F.col("us") - 600_000_000 - (t % 20) * 60_000_000))
    return e.select(
        "device_id",
        "track_id",
        activity.alias("activity"),
        F.when(t % 7 == 0, "imported").otherwise("recorded").alias("source"),
        F.when(t % 9 == 0, (t + 3) % 6).otherwise(F.coalesce("prev_id", "track_id") % 6).alias("from_place"),
        (t % 6).alias("to_place"),
        F.floor(start / 1000).cast("long").alias("started_at"),
        F.floor(F.col("us") / 1000).cast("long").alias("ended_at"),
    )


def points(tracks: DataFrame) -> DataFrame:
    """Ten fixes a track, in order of (ts_ms, seq), with what a fix measures."""
    p = tracks.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(FIXES - 1))))
    t, i, a, b = F.col("track_id"), F.col("seq"), F.col("from_place"), F.col("to_place")
    ms = F.col("started_at") + F.expr("((ended_at - started_at) * seq) div 9")
    lat = F.lit(38.0) + F.col("device_id") * F.lit(0.01) + (a * (9 - i) + b * i) / F.lit(9.0) * F.lit(0.004) + ((t * 7 + i * 3) % 11 - 5) * F.lit(0.00005)
    lon = F.lit(-9.0) + F.col("device_id") * F.lit(0.01) + (a * a * (9 - i) + b * b * i) / F.lit(9.0) * F.lit(0.002) + ((t * 5 + i) % 13 - 6) * F.lit(0.00005)
    return p.select(
        "device_id",
        "track_id",
        "activity",
        "seq",
        ms.alias("ts_ms"),
        lat.alias("lat"),
        lon.alias("lon"),
        ((t + i) % 17 == 0).alias("ignored"),
        ((t * 3 + i * 11) % 70 + 1).cast("double").alias("accuracy"),
        F.when((t + i) % 3 != 0, ((t + i * 5) % 40).cast("double") / F.lit(3.6)).alias("speed"),
        ((t + i) % 13 == 5).alias("segment_start"),
        ((t + i) % 6).cast("int").alias("satellites"),
    )


def pins(tracks: DataFrame) -> DataFrame:
    """Four named places a device; seed_index is their order."""
    p = tracks.select("device_id").distinct().withColumn("seed_index", F.explode(F.sequence(F.lit(0), F.lit(3))))
    i = F.col("seed_index")
    label = F.element_at(F.array(*map(F.lit, NAMED)), i + 1)
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), i + 1)
    return p.select("device_id", (F.col("device_id") * 10 + i).alias("place_id"), i.cast("long").alias("seed_index"), label.alias("label"), category.alias("category"), place_lat(F.col("device_id"), i).alias("lat"), place_lon(F.col("device_id"), i).alias("lon"), (F.lit(150.0) + i * F.lit(50.0)).alias("radius_m"))


def atlas(nations: DataFrame, each: int = 16) -> DataFrame:
    """An atlas of some cities a nation, around the devices' places, by a rule; nations: n_nationkey, n_name."""
    k = F.col("id")
    a = nations.select(F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("_i"), "n_nationkey", "n_name").withColumn("id", F.col("n_nationkey").cast("long") * each + F.col("_i"))
    a = a.withColumn("lat", F.lit(37.9) + (k * 37 % 400) * F.lit(0.01)).withColumn("lon", F.lit(-9.2) + (k * 53 % 400) * F.lit(0.008))
    country = F.when(k % 13 == 0, "XB").when(F.col("lon") < -8.0, "XA").otherwise("XC")
    people = F.when(k % 9 == 0, 0).otherwise(k * k % 89).cast("int")
    return a.select("lat", "lon", people.alias("population_k"), country.alias("country"), F.when(country == "XC", "Europe/Madrid").otherwise("Europe/Lisbon").alias("zone"), F.concat(F.when(k % 3 == 0, "New ").otherwise(""), "n_name", F.lit(" "), k.cast("string")).alias("name"))
