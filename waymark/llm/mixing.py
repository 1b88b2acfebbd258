"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weights that sources get in turn, by code point, null last.
CYCLE = (3, 1, 2)
#: The mix takes so many times the words of all sources; of one source at most so many times its own.
SHARE, MOST = 1.5, 2
#: Documents of one source between two neighbouring cuts of its sampling order, about.
PER_CUT = 4096


def source_targets(sources: DataFrame, share: float = SHARE, most: float = MOST, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """Adds weight and target to (source, source_size, n): one row per source.

    The mix is dealt out by weight; a target stops at ``most`` times its source's
    size, and the excess goes to the others by weight. All targets so capped are
    those with the smallest cap per weight, so running sums in that order find them.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*map(F.lit, cycle))
    w = sources.withColumn("weight", F.element_at(turn, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(cycle))) + 1).cast("int")).cast("double"))
    w = w.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.lit(float(share)) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / rest
    w = w.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    free = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(all_rows)["level"]
    return w.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(free * F.col("weight"))).drop("level", "capped", "cap")


def uniform(*keys) -> F.Column:
    """A number in (0, 1) that depends on the keys alone: 52 bits of their md5."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def inclusion(sizes: DataFrame) -> DataFrame:
    """(_s, _largest, _rate): documents of up to _largest words are included with probability _rate * size, larger ones for certain.

    sizes: _s, size, n, need: how many documents of a source have a size, and how
    many words are to be taken of the source. Probabilities are in proportion to
    size, and words expected of all documents make up need. Which sizes are certain
    follows from running sums over a source's distinct sizes.
    """
    w = Window.partitionBy("_s").orderBy(F.desc("size"))
    words, squares = F.col("n") * F.col("size").cast("decimal(38,0)"), F.col("n") * F.col("size").cast("decimal(19,0)") * F.col("size").cast("decimal(19,0)")
    # what is larger is a running sum, what isn't is the total without it
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    larger = F.coalesce(F.sum(words).over(before), F.lit(0)).cast("double")
    rest = (F.sum(squares).over(Window.partitionBy("_s")) - F.coalesce(F.sum(squares).over(before), F.lit(0))).cast("double")
    s = sizes.where("size > 0").withColumns({"_left": F.col("need") - larger, "_squares": rest})
    s = s.where(F.col("_left") * F.col("size") <= F.col("_squares"))
    return s.groupBy("_s").agg(F.max(F.struct("size", (F.col("_left") / F.col("_squares")).alias("rate"))).alias("m")).select("_s", F.col("m.size").alias("_largest"), F.col("m.rate").alias("_rate"))


def mix_sources(docs: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """How often the mix takes each document: docs' columns and source_size, target, copies, taken.

    docs: doc_id long, source string, size long, and any other columns; those with
    the names of added ones are replaced. Each document of a source first gets the
    whole copies that fit into target / source_size. One more copy goes to a sample
    for the rest of the target, in Pareto order: a document's inclusion probability
    p is in proportion to its size, and 1 for those that this makes certain; rank
    the documents by u / (1 - u) over p / (1 - p), where u is the row's random
    number, and take them in that order until their words make up the rest; the
    last one is taken if that comes nearer. So the words taken of a source miss its
    target by half a document at most.

    A null source is a source of its own. Documents without words are taken zero
    words of. u depends on doc_id and size; rows that repeat both rank side by side.
    An empty table gives an empty result. The order is cut into ranges with
    pre-aggregated sizes, so only the range at the edge is sorted: no task holds a source.
    """
    added = ("source_size", "target", "copies", "taken")
    names = [c for c in docs.columns if c not in added]
    docs = docs.select(*names).withColumn("size", F.coalesce(F.col("size"), F.lit(0)).cast("long"))
    sizes = docs.groupBy("source", "size").agg(F.count("*").alias("n"))
    sources = source_targets(sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n")), share, most)
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    sources = sources.withColumn("_whole", F.floor(rate)).withColumn("_need", F.col("target") - F.col("_whole") * F.col("source_size"))
    sources = sources.withColumn("_cuts", F.ceil(F.col("n") / PER_CUT)).select(F.col("source").alias("_s"), "source_size", "target", "_whole", "_need", "_cuts")
    each = sizes.join(sources, F.col("source").eqNullSafe(F.col("_s"))).select("_s", "size", "n", F.col("_need").alias("need"))
    odds = inclusion(each).withColumnRenamed("_s", "_i")
    sources = sources.join(odds, F.col("_s").eqNullSafe(F.col("_i")), "left").drop("_i")
    d = docs.join(sources, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    p = F.when(F.col("size") <= F.coalesce("_largest", F.lit(0)), F.col("_rate") * F.col("size")).otherwise(F.when(F.col("size") > 0, 1.0).otherwise(0.0))
    d = d.withColumns({"_p": p, "_u": uniform("doc_id", "size")})
    ratio = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    d = d.withColumn("_q", F.when(F.col("_p") >= 1, 0.0).when(F.col("_p") > 0, ratio).otherwise(float("inf"))).drop("_u", "_p", "_largest", "_rate")
    # ratios spread over 0 to 1; the certain ones are a cut of their own
    d = d.withColumn("_cut", F.when(F.col("_q") == 0, -1).when(F.col("_q") == float("inf"), F.col("_cuts")).otherwise(F.floor(F.col("_q") / (1 + F.col("_q")) * F.col("_cuts"))))
    sums = d.groupBy(F.col("source").alias("_s"), F.col("_cut").alias("_c")).agg(F.sum("size").alias("_in"))
    before = F.sum("_in").over(Window.partitionBy("_s").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("_before", F.coalesce(before, F.lit(0)))
    d = d.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_cut") == F.col("_c"))).drop("_s", "_c")
    edge = (F.col("_before") < F.col("_need")) & (F.col("_before") + F.col("_in") > F.col("_need"))
    inside = d.where(~edge).withColumn("_more", (F.col("_before") + F.col("_in") <= F.col("_need")).cast("int"))
    order = Window.partitionBy("source", "_cut").orderBy("_q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("_before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    at_edge = d.where(edge).withColumn("_more", (ahead + F.col("size") / 2 <= F.col("_need")).cast("int"))
    out = inside.unionByName(at_edge).withColumn("copies", F.col("_whole") + F.col("_more"))
    out = out.withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
    return out.select(*names, *added)
