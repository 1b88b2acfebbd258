"""Totals of activities and places by day, month and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.intervals import local_date
from waymark.schemas import in_totals

#: A day shows a category from this time on, in all.
DAY_FLOOR_MS = 5 * 60_000
MONTHS = 12


def by_activity(tracks: DataFrame, *keys: str, now_ms: int | None = None) -> DataFrame:
    """Metres, time and tracks per activity (and keys); an open track lasts until now."""
    end = F.coalesce("ended_at", F.lit(now_ms))
    return tracks.groupBy(*keys, "activity").agg(F.sum("distance_m").alias("metres"), F.sum(end - F.col("started_at")).alias("ms"), F.count("*").alias("tracks"))


def by_category(stays: DataFrame, *keys: str, floor_ms: int = 0) -> DataFrame:
    """Time and distinct stays per category that counts; stays: after_track_id, category, start, end."""
    s = stays.where(in_totals(F.col("category")))
    t = s.groupBy(*keys, "category").agg(F.sum(F.col("end") - F.col("start")).alias("ms"), F.count_distinct("after_track_id").alias("stays"))
    return t.where(F.col("ms") >= floor_ms)


def month_of(ms: Column, zone: Column | None = None) -> Column:
    """A month's number: 12 times the year and the months before."""
    d = local_date(ms, zone)
    return F.year(d) * 12 + F.month(d) - 1


def month_window(totals: DataFrame, last: Column, *keys: str, months: int = MONTHS) -> DataFrame:
    """Rows (keys, month, value) as a series over the months up to ``last``: values, total, peak, latest, fractions.

    Months without a row are 0; series without anything are left out.
    """
    t = totals.withColumn("slot", F.col("month") - (last - (months - 1))).where(F.col("slot").between(0, months - 1))
    s = t.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("by_slot"))
    values = F.transform(F.sequence(F.lit(0), F.lit(months - 1)), lambda i: F.coalesce(F.element_at("by_slot", i), F.lit(0.0)))
    s = s.withColumn("series", values).withColumn("total", F.aggregate("series", F.lit(0.0), lambda a, x: a + x)).withColumn("peak", F.array_max("series"))
    s = s.where("total > 0").withColumn("latest", F.element_at("series", -1))
    return s.withColumn("fractions", F.transform("series", lambda v: v / F.col("peak"))).drop("by_slot")


def by_period(tracks: DataFrame, now_ms: int, zone: Column | None = None) -> DataFrame:
    """Metres, time and tracks per device today, this month and in the month before."""
    day, today = local_date(F.col("started_at"), zone), local_date(F.lit(now_ms), zone)
    month, this = month_of(F.col("started_at"), zone), month_of(F.lit(now_ms), zone)
    periods = F.array_compact(F.array(F.when(day == today, "today"), F.when(month == this, "month"), F.when(month == this - 1, "last_month")))
    t = tracks.withColumn("period", F.explode(periods))
    return t.groupBy("device_id", "period").agg(F.sum("distance_m").alias("metres"), F.sum(F.col("ended_at") - F.col("started_at")).alias("ms"), F.count("*").alias("tracks"))
