"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import discard, stored


def tangled(edges: DataFrame) -> bool:
    """Whether an id hangs below two others, or below one that hangs below another."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("below")), F.struct(F.col("v").alias("id"), F.lit(0).alias("below")))).alias("x")).select("x.*")
    ids = ends.groupBy("id").agg(F.sum("below").alias("times"), F.min("below").alias("least"))
    return not ids.where("times > 1 or (times = 1 and least = 0)").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that links reach, for each id that a link names.

    Each round hangs neighbours below the smallest neighbour, first the larger ones,
    then the smaller ones, until every id hangs below its component's smallest. The
    smallest neighbours are aggregated before the shuffle, and rounds are written to
    the shared folder. Ids with equal ends and repeated links don't matter.
    """
    up, low = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = stored(links.select(up, low).where("u != v").distinct(), "links")
    while tangled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(edges)
        edges = new
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
