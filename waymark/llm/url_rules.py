"""URL filters by sort-merge range joins, in DataFrame operations only.

A host's key is its labels in reverse, each followed by a dot, so that a host and
all its subdomains are one interval of keys: those with a common prefix. So are the
paths that a rule of one host fits. Such intervals are nested or disjoint: a sweep
over sorted keys needs only the stack of prefixes that are active after each
interval's start or end. Hosts are swept first, and tell which rules' hosts hold
them; then paths are, among the rules of each such host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import ascii_lower, stored

RULES = "host string, path string, verdict string"


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def prefix_events(prefixes: DataFrame) -> DataFrame:
    """(key, rank, stack): what is active from a key on, by prefixes (prefix, value); one row per start and end of an interval.

    A stack holds (length, value) of a prefix and of those that are prefixes of it,
    shortest first; after its interval the last one is gone. Keys are bytes: no text
    has 0xFF, so a prefix with that behind it comes after all that start with it.
    """
    above = F.transform(F.sequence(F.lit(1), F.length("prefix")), lambda n: F.substring(F.col("prefix"), F.lit(1), n))
    chain = prefixes.select("prefix", F.explode(above).alias("up")).join(prefixes.select(F.col("prefix").alias("up"), "value"), "up")
    stacks = chain.groupBy("prefix").agg(F.array_sort(F.collect_list(F.struct(F.length("up").alias("length"), "value"))).alias("stack"))
    key = F.encode("prefix", "utf-8")
    starts = stacks.select(key.alias("key"), F.lit(1).alias("rank"), "stack")
    ends = stacks.select(F.concat(key, F.unhex(F.lit("FF"))).alias("key"), F.lit(0).alias("rank"), F.slice("stack", F.lit(1), F.size("stack") - 1).alias("stack"))
    return starts.unionByName(ends)


def sweep(asked: DataFrame, events: DataFrame, partitions: int) -> DataFrame:
    """asked (key string, and what comes along) with stack: the prefixes whose intervals hold the key.

    Keys and events are range-partitioned by key and written once; each partition
    is swept by itself, from the last event of the partitions before it.
    """
    along = [c for c in asked.columns if c != "key"]
    # rank: a key comes after an event at the same key
    rows = asked.select(F.encode("key", "utf-8").alias("key"), F.lit(2).alias("rank"), F.struct(*along).alias("along"))
    kind = events.schema["stack"].dataType
    rows = rows.withColumn("stack", F.lit(None).cast(kind)).unionByName(events.withColumn("along", F.lit(None).cast(rows.schema["along"].dataType)))
    dealt = stored(rows.repartitionByRange(partitions, "key", "rank").withColumn("part", F.spark_partition_id()), "url-sweep")
    last = dealt.where("stack is not null").groupBy("part").agg(F.max_by("stack", F.struct("key", "rank")).alias("at_end"))
    parts = dealt.select("part").distinct().join(last, "part", "left")
    carried = parts.withColumn("carried", F.last("at_end", True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).drop("at_end")
    now = F.last("stack", True).over(Window.partitionBy("part").orderBy("key", "rank"))
    swept = dealt.withColumn("now", now).where("along is not null")
    return swept.join(carried, "part").select("along.*", F.coalesce("now", "carried").alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", partitions: int | None = None) -> DataFrame:
    """Adds host, path, rule and verdict to pages with a column url.

    A rule fits its host and all subdomains of it where the url's path starts with
    the rule's path; of several the longest (host and path), then the one with the
    longest host, then 'allow' wins. Without a rule, rule is null and verdict is
    ``default``. A null url or one without :// has an empty host and path. Repeated
    urls are judged alike; an empty table gives an empty result; rules without a
    host or path are ignored. Columns of pages with the names of added ones are
    replaced, others stay. Each distinct host, and each distinct path of a host, is
    swept once, so neither a host that holds a third of the pages nor one that has
    very many rules costs a task more.
    """
    added = ("host", "path", "rule", "verdict")
    names = [c for c in pages.columns if c not in added]
    n = partitions or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = pages.select(*names, url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    allow = F.when(F.bool_or(F.col("verdict") == "allow"), "allow").otherwise(F.min("verdict"))
    r = rules.where("host is not null and path is not null").groupBy(ascii_lower(F.col("host")).alias("host"), "path").agg(allow.alias("verdict"))
    of_host = lambda host, path: F.concat(host, F.lit("\0"), path)
    hosts = prefix_events(r.select(host_key(F.col("host")).alias("prefix"), F.col("host").alias("value")).distinct())
    inside = sweep(p.select(host_key(F.col("host")).alias("key"), "host").distinct(), hosts, n)
    asked = p.select("host", "path").distinct().join(inside.select("host", F.explode("stack.value").alias("_of")), "host")
    paths = prefix_events(r.select(of_host(F.col("host"), F.col("path")).alias("prefix"), F.struct("host", "path", "verdict").alias("value")))
    fits = sweep(asked.select(of_host(F.col("_of"), F.col("path")).alias("key"), "host", "path"), paths, n)
    top = F.element_at("stack", -1)["value"]
    fits = fits.where(F.size("stack") > 0).select("host", "path", top.alias("r"))
    best = F.max(F.struct((F.length("r.host") + F.length("r.path")).alias("n"), F.length("r.host").alias("h"), "r"))["r"]
    best = fits.groupBy("host", "path").agg(best.alias("_best"))
    p = p.join(best, ["host", "path"], "left")
    return p.select(*names, "host", "path", F.concat("_best.host", "_best.path").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
