"""Cities: which one names a coordinate, and which ones a name finds.

An atlas has lat, lon, population_k, country, zone and name. It is a dimension of
a fixed size, which is checked before it goes to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geo import ellipsoid_m, on_globe
from waymark.functions.text import fold_text
from waymark.sources.shared import dealt

ATLAS = "lat double, lon double, population_k int, country string, zone string, name string"
#: Rows of an atlas at most: with that many it takes tens of megabytes.
MOST_ROWS = 1_000_000
#: How far out cities vote on the country, how many do, and how far and how much larger a namesake may be.
VOTE_M, VOTERS, NAME_M, LARGER = 25_000.0, 5, 5_000.0, 3
# Feature codes of settlements in the raw table.
SETTLEMENTS = ("PPL", "PPLA", "PPLA2", "PPLA3", "PPLA4", "PPLA5", "PPLC", "PPLF", "PPLG", "PPLL", "PPLR", "PPLS", "STLMT")


def atlas_of(raw: DataFrame) -> DataFrame:
    """An atlas out of a gazetteer's table: tab-separated, 19 columns, no header; read with spark.read.csv."""
    c = raw.columns
    rows = raw.where(F.col(c[7]).isin(*SETTLEMENTS) & (F.length(c[8]) == 2))
    return rows.select(F.col(c[4]).cast("double").alias("lat"), F.col(c[5]).cast("double").alias("lon"), F.floor((F.col(c[14]).cast("long") + 500) / 1000).cast("int").alias("population_k"), F.col(c[8]).alias("country"), F.col(c[17]).alias("zone"), F.col(c[1]).alias("name"))


class Atlas:
    """Rows by latitude; a lookup measures only those in the band that matters."""

    def __init__(self, rows: pd.DataFrame, distance=ellipsoid_m):
        rows = rows.sort_values(["lat", "lon", "name"], kind="stable").reset_index(drop=True)
        self.lat, self.lon, self.pop = (rows[c].to_numpy(float) for c in ("lat", "lon", "population_k"))
        self.country, self.rows, self.distance = rows["country"].to_numpy(object), rows, distance

    def band(self, lat: float, lon: float, metres: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows within some metres, nearest first, and how far each is."""
        reach = metres / 110_000
        rows = np.arange(np.searchsorted(self.lat, lat - reach), np.searchsorted(self.lat, lat + reach, "right"))
        if reach < 80 - abs(lat):
            turn = np.abs(self.lon[rows] - lon)
            rows = rows[np.minimum(turn, 360 - turn) <= reach / np.cos(np.radians(abs(lat) + reach))]
        d = np.asarray(self.distance(lat, lon, self.lat[rows], self.lon[rows]), float)
        order = np.argsort(d, kind="stable")
        rows, d = rows[order], d[order]
        return rows[d <= metres], d[d <= metres]

    def name(self, lat: float, lon: float) -> tuple[int, float] | None:
        """(row, metres) of the city that names a coordinate."""
        if not len(self.lat) or not np.isfinite(lat + lon):
            return None
        lat, lon = on_globe(lat, lon)
        reach = 50_000.0
        while True:
            rows, d = self.band(lat, lon, reach)
            if len(rows) or reach > 3e7:
                break
            reach *= 4
        if not len(rows):
            return None
        rows, d = self.band(lat, lon, d[0] + VOTE_M)
        voters = self.country[rows[:VOTERS]].tolist()
        country = max(voters, key=lambda c: (voters.count(c), -voters.index(c)))
        k = int(np.flatnonzero(self.country[rows] == country)[0])
        home, far = rows[k], d[k]
        if not self.pop[home]:
            return int(home), float(far)
        rows, d = self.band(lat, lon, far + NAME_M)
        big = (self.country[rows] == country) & (self.pop[rows] > self.pop[home]) & (self.pop[rows] >= LARGER * self.pop[home])
        if not big.any():
            return int(home), float(far)
        rows, d = rows[big], d[big]
        k = int(self.pop[rows].argmax())
        return int(rows[k]), float(d[k])


def named(places: DataFrame, atlas: DataFrame, distance=ellipsoid_m) -> DataFrame:
    """Adds city, country, zone and city_m to places with lat and lon.

    The most populous of the cities near the nearest one in the country that its
    five nearest vote for, if it is three times as large. Each distinct coordinate
    is looked up once. An empty atlas, or a null coordinate, gives nulls.
    """
    rows = atlas.limit(MOST_ROWS + 1).toPandas()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"an atlas has {MOST_ROWS} rows at most")
    shared = places.sparkSession.sparkContext.broadcast(rows)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book = Atlas(shared.value, distance)
        for batch in batches:
            hits = [book.name(y, x) for y, x in zip(batch["lat"].to_numpy(float), batch["lon"].to_numpy(float))]
            out = batch.copy()
            for c, name in (("name", "city"), ("country", "country"), ("zone", "zone")):
                out[name] = [None if h is None else book.rows[c][h[0]] for h in hits]
            out["city_m"] = [None if h is None else h[1] for h in hits]
            yield out

    spots = dealt(places.where("lat is not null and lon is not null").select("lat", "lon"), "lat", "lon").distinct()
    found = spots.mapInPandas(look, "lat double, lon double, city string, country string, zone string, city_m double")
    return places.join(found.hint("merge"), ["lat", "lon"], "left")


def by_name(atlas: DataFrame, needle: str, limit: int = 10) -> DataFrame:
    """Cities whose folded name holds a needle of two letters or more: those that start with it first, then by population."""
    n = fold_text(F.lit(needle))
    a = atlas.withColumn("_f", fold_text("name")).where((F.length(n) >= 2) & F.col("_f").contains(n))
    a = a.withColumn("prefix", F.col("_f").startswith(n)).drop("_f")
    return a.orderBy(F.desc("prefix"), F.desc("population_k"), "lat", "lon", "name").limit(limit)


def zones(rows: DataFrame, named_places: DataFrame, key: list[str], fallback: str = "UTC") -> DataFrame:
    """Adds zone to rows: that of their place's city, else the device's."""
    return rows.join(named_places.select(*key, "zone"), key, "left").withColumn("zone", F.coalesce("zone", F.lit(fallback)))


def top_cities(atlas: DataFrame, per_country: int) -> DataFrame:
    """The most populous cities of each country."""
    w = Window.partitionBy("country").orderBy(F.desc("population_k"), "name")
    return atlas.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_country)
