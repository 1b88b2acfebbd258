"""Secret scans: patterns, and two character Markov models compared by log-likelihood ratio.

DataFrame operations only. One model is of random strings, the other of ordinary
identifiers; a candidate is a secret where the first explains it far better.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import sampled

#: Kinds in their order, patterns, and least lengths (of a group).
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")

#: What the models judge: long runs of these characters.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_-]{7,}+"
N = len(ALPHABET) + 1
#: Documents that identifiers are learned from, about: the bound of the training sample.
TRAIN_DOCS = 20_000
RANDOM_STRINGS = 4_000
#: A candidate is a secret at this log ratio (in nats) or above, in all and per character.
LEAST, LEAST_PER_CHAR = 12.0, 0.5


#: Elements that running() folds one by one; what it copies grows with an array's size times this.
FOLD = 256


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body uses it in functions of elements."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, op, zero: Column) -> Column:
    """For each element what op makes of all before it; op is associative. Folds blocks first, then within blocks."""

    def before(v: Column, first: Column) -> Column:
        start = F.struct(first.alias("acc"), F.slice(F.array(zero), F.lit(1), F.lit(0)).alias("out"))
        return F.aggregate(v, start, lambda s, x: F.struct(op(s["acc"], x).alias("acc"), F.concat(s["out"], F.array(s["acc"])).alias("out")))["out"]

    def folded(v: Column) -> Column:
        part = lambda k: F.slice(v, k * FOLD + 1, F.lit(FOLD))
        blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(v) - 1) / FOLD).cast("int")))
        bases = before(F.transform(blocks, lambda k: F.aggregate(part(k), zero, op)), zero)
        return F.flatten(F.transform(bases, lambda base, k: before(part(k), base)))

    return let(values, folded)


def found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of a pattern's leftmost matches, in code points.

    The pieces between matches and the matches take turns, so running sums of their
    lengths are the positions.
    """
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"))

    def spans(x: Column) -> Column:
        gap = lambda i: F.length(F.get(x["gaps"], i))
        before = running(F.transform(x["matches"], lambda m, i: gap(i) + F.length(m)), lambda a, b: a + b, F.lit(0))
        at = lambda b, i: b["before"] + gap(i)
        pairs = F.arrays_zip(before.alias("before"), x["matches"].alias("match"))
        return F.transform(pairs, lambda b, i: F.struct(at(b, i).alias("start"), (at(b, i) + F.length(b["match"])).alias("end"), b["match"].alias("value")))

    return F.when(text.rlike(pattern), let(both, spans)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of others: in order of their ends, with the others' starts between, by the largest end of the others so far."""
    kind = "struct<at:int,other:boolean,start:int,end:int,value:string>"
    mine = F.transform(spans, lambda s: F.struct(s["end"], F.lit(False), s["start"], s["end"], s["value"]).cast(kind))
    theirs = F.transform(others, lambda s: F.struct(s["start"], F.lit(True), s["start"], s["end"], F.lit(None)).cast(kind))

    def kept(x: Column) -> Column:
        reach = running(F.transform(x, lambda s: F.when(s["other"], s["end"]).otherwise(-1)), lambda a, b: F.greatest(a, b), F.lit(-1))
        free = F.filter(F.arrays_zip(x.alias("s"), reach.alias("reach")), lambda p: ~p["s"]["other"] & (p["reach"] <= p["s"]["start"]))
        return F.transform(free, lambda p: F.struct(p["s"]["start"].alias("start"), p["s"]["end"].alias("end"), p["s"]["value"].alias("value")))

    return F.when((F.size(spans) > 0) & (F.size(others) > 0), let(F.array_sort(F.concat(mine, theirs)), kept)).otherwise(spans)


def of_kind(spans: Column, kind: str) -> Column:
    rank = F.lit(KINDS.index(kind))
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank.alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pair_counts(strings: DataFrame) -> dict[tuple[int, int], int]:
    """Counts of neighbouring characters in column s: at most N * N rows come back."""
    s = F.col("s")
    pairs = strings.where(F.length("s") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, 2))).alias("pair"))
    code = lambda c: F.instr(F.lit(ALPHABET), c)
    coded = pairs.groupBy("pair").count().select(F.expr("left(pair, 1)").alias("a"), F.expr("right(pair, 1)").alias("b"), "count")
    rows = coded.select(code(F.col("a")).alias("a"), code(F.col("b")).alias("b"), "count").groupBy("a", "b").sum("count").collect()
    return {(a, b): n for a, b, n in rows}


def random_strings(spark: SparkSession, n: int = RANDOM_STRINGS) -> DataFrame:
    """Labelled samples of random strings: digests written in hex, base 64 and base 32's characters."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.base64(F.unhex(digest))
    forms = F.array(digest, base64, F.translate(base64, "+/=", "xY7"), F.substring(F.upper(F.translate(base64, "+/=", "xY7")), 1, 20))
    return spark.range(n).select(F.explode(forms).alias("s"))


def identifiers(docs: DataFrame, bound: int = TRAIN_DOCS) -> DataFrame:
    """Labelled samples of ordinary identifiers: words without digits of about ``bound`` documents.

    The documents are distinct texts with the lowest hashes, a share of bound / count;
    the sample's size doesn't grow with the table.
    """
    words = sampled(docs.where("text is not null").select("text"), bound).select(F.explode(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))).alias("s"))
    return words.where(~F.col("s").rlike("[0-9]"))


def train(random: DataFrame, ordinary: DataFrame, smooth: float = 1.0) -> list[float]:
    """Log ratios log P_random(b | a) - log P_ordinary(b | a), at a * N + b; N * N numbers."""
    models = []
    for strings in (random, ordinary):
        counts = pair_counts(strings)
        rows = [smooth * N + sum(counts.get((a, b), 0) for b in range(N)) for a in range(N)]
        models.append([math.log((smooth + counts.get((a, b), 0)) / rows[a]) for a in range(N) for b in range(N)])
    return [x - y for x, y in zip(*models)]


def log_ratio(s: Column, ratios: list[float]) -> Column:
    """Sum over neighbouring characters, in one pass over the characters."""
    weights, codes = F.lit(ratios), F.lit([ALPHABET.find(chr(i)) + 1 for i in range(128)])
    code = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.coalesce(F.get(codes, F.ascii(c)), F.lit(0)))
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.when(acc["last"] >= 0, F.get(weights, acc["last"] * N + c)).otherwise(0.0)).alias("sum"))
    return F.aggregate(code, start, step)["sum"]


def scan(docs: DataFrame, ratios: list[float], least: float = LEAST, per_char: float = LEAST_PER_CHAR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov: one row per row of docs.

    docs: doc_id, text; other columns are ignored. Positions are code points of the
    whole text, ends exclusive; an assign span is its whole match. A null text is
    empty; without a span, spans is '' and base_sha256 is that of ''. Rows aren't
    grouped, so repeated rows and ties give repeated rows, and an empty table an
    empty result. Model spans that overlap a pattern's span are left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("text"))
    long_enough = lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 12
    d = d.withColumn("assign", of_kind(F.filter(found(F.col("text"), ASSIGN), long_enough), "assign"))
    d = d.withColumn("access", of_kind(found(F.col("text"), ACCESS), "access")).withColumn("hex", of_kind(found(F.col("text"), HEX), "hex"))
    d = d.withColumn("base", F.array_sort(F.concat("assign", "access", "hex"))).withColumn("candidates", found(F.col("text"), CANDIDATE))
    likely = lambda c: log_ratio(c["value"], ratios) >= F.greatest(F.lit(least), per_char * F.length(c["value"]))
    d = d.withColumn("markov", of_kind(F.filter(apart(F.col("candidates"), F.col("base")), likely), "markov"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return d.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "markov"))).alias("spans"))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Trains both models, the one of identifiers on a bounded sample of docs, and scans all docs."""
    return scan(docs, train(random_strings(docs.sparkSession), identifiers(docs)))
