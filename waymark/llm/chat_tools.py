"""Chat formatting: tool calls and results, linked, ordered, validated and serialised.

DataFrame operations only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import discard, stored

KEY = ["conv_id", "call_id"]
#: Rows of schemas that are broadcast, at most; the rows of more meet their calls in so many shares of a tool.
SCHEMA_ROWS, SHARES = 10_000, 256


def topological_levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level: 0 without needs, else one more than the highest need; null in a cycle or behind one.

    calls: conv_id, call_id, needs array<string>, one row per call. Needs that are
    no call of the conversation don't count. A call waits for its needs; one that
    waits for a single other is skipped over: what waits for it waits for that one
    from then on, with more added. So a chain of n calls takes about log n rounds.
    Only calls with needs take part; a round that settles none leaves cycles.
    """
    ids = calls.select(*KEY)
    edges = calls.select(*KEY, F.explode(F.array_distinct("needs")).alias("need"))
    known = ids.select("conv_id", F.col("call_id").alias("need"))
    edges = edges.join(known.hint("shuffle_hash"), ["conv_id", "need"], "left_semi")
    # level >= floor, and >= add + the need's level
    edges = stored(edges.select(*KEY, "need", F.lit(1).alias("add"), F.lit(1).alias("floor")), "call-needs")
    done = stored(ids.join(edges.select(*KEY).distinct(), KEY, "left_anti").withColumn("level", F.lit(0)), "call-levels")
    settled, call = [done], Window.partitionBy(*KEY)
    while not edges.isEmpty():
        level = done.select("conv_id", F.col("call_id").alias("need"), "level").hint("shuffle_hash")
        j = edges.join(level, ["conv_id", "need"], "left")
        j = j.withColumn("floor", F.max(F.greatest("floor", F.col("add") + F.coalesce("level", F.lit(0)))).over(call)).withColumn("left", F.count_if(F.col("level").isNull()).over(call))
        j = stored(j, "call-needs")
        discard(edges)
        done = j.where(F.col("left") == 0).groupBy(*KEY).agg(F.max("floor").alias("level"))
        rest = j.where("left > 0 and level is null").select(*KEY, "need", "add", "floor", "left")
        if done.isEmpty():  # what is left needs itself
            settled.append(rest.select(*KEY).distinct().withColumn("level", F.lit(None).cast("int")))
            break
        settled.append(done)
        on = rest.where(F.col("left") == 1).select("conv_id", F.col("call_id").alias("need"), F.col("need").alias("next"), F.col("add").alias("more"), F.col("floor").alias("least"))
        r = rest.join(on.hint("shuffle_hash"), ["conv_id", "need"], "left")
        r = r.select(*KEY, F.coalesce("next", "need").alias("need"), (F.col("add") + F.coalesce("more", F.lit(0))).alias("add"), F.greatest("floor", F.col("add") + F.col("least")).alias("floor"))
        edges = stored(r.groupBy(*KEY, "need").agg(F.max("add").alias("add"), F.max("floor").alias("floor")), "call-needs")
    return reduce(DataFrame.unionByName, settled)


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Adds args (a variant, null if no JSON object) and errors (array<string>, sorted) to calls.

    schemas: tool, name, type (as schema_of_variant says it: STRING, BIGINT,
    BOOLEAN, OBJECT, ARRAY, ...), required. A tool without a row is unknown. An
    optional argument may be null.
    """
    tools = schemas.groupBy("tool").agg(F.collect_list(F.struct("name", "type", "required")).alias("fields"))
    v = F.try_parse_json("arguments")
    c = calls.withColumn("args", F.when(F.schema_of_variant(v).startswith("OBJECT"), v))
    # most calls may name one tool, so they aren't dealt by it
    if schemas.count() <= SCHEMA_ROWS:
        c = c.join(F.broadcast(tools), "tool", "left")
    else:
        share = F.pmod(F.xxhash64(*KEY), F.lit(SHARES))
        shares = tools.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
        c = c.withColumn("_share", share).join(shares.hint("shuffle_hash"), ["tool", "_share"], "left").drop("_share")
    c = c.withColumn("given", F.try_variant_get("args", "$", "map<string,variant>"))
    kind = lambda f: F.regexp_extract(F.schema_of_variant(F.element_at("given", f["name"])), "^[A-Z]+", 0)
    has = lambda f: F.map_contains_key("given", f["name"])
    missing = F.transform(F.filter("fields", lambda f: f["required"] & ~has(f)), lambda f: F.concat(F.lit("missing "), f["name"]))
    fits = lambda f: (kind(f) == f["type"]) | (~f["required"] & (kind(f) == "VOID"))
    wrong = F.transform(F.filter("fields", lambda f: has(f) & ~fits(f)), lambda f: F.concat(F.lit("type of "), f["name"]))
    more = F.transform(F.array_except(F.map_keys("given"), F.transform("fields", lambda f: f["name"])), lambda n: F.concat(F.lit("unexpected "), n))
    errors = (
        F.when(F.col("args").isNull(), F.array(F.lit("arguments are no object")))
        .when(F.col("fields").isNull(), F.array(F.lit("unknown tool")))
        .otherwise(F.array_sort(F.concat(missing, wrong, more)))
    )
    return c.withColumn("errors", errors).drop("fields", "given")


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call and per result: conv_id, call_id, kind, level, turn, status, errors, json.

    calls: conv_id, call_id, turn, tool, arguments (JSON), needs array<string> (ids
    whose results the call uses; null counts as none); results: conv_id, call_id,
    turn, content. Calls and results are hash-joined by conv_id and call_id. status
    is linked, unanswered (a call), orphan (a result), duplicate (all rows of an id
    but the one with the lowest turn, then text) or cyclic (a call that needs
    itself; level is null). Sorted by level, turn and kind, each call stands before
    its result and after the results that it needs. json is the canonical message:
    members sorted, no white space. Rows with a null conv_id or call_id are left
    out, other columns are ignored, empty tables give an empty result.
    """
    keyed = "conv_id is not null and call_id is not null"
    c = calls.where(keyed).select(*KEY, "turn", "tool", "arguments", F.coalesce("needs", F.array().cast("array<string>")).alias("needs"))
    r = results.where(keyed).select(*KEY, "turn", "content")
    # which row of an id counts: aggregated first, so that an id with very many rows costs no task more
    first_c = c.groupBy(*KEY).agg(F.min(F.struct("turn", "tool", "arguments", "needs")).alias("c"), F.count("*").alias("n"))
    first_r = r.groupBy(*KEY).agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n"))
    heads = first_c.select(*KEY, "c.*")
    levels = topological_levels(heads)
    both = validated(heads, schemas).join(levels.hint("shuffle_hash"), KEY).join(first_r.select(*KEY, "r").hint("shuffle_hash"), KEY, "full")
    is_call, cyclic = F.col("turn").isNotNull() | F.col("needs").isNotNull(), F.col("needs").isNotNull() & F.col("level").isNull()
    call_status = F.when(cyclic, "cyclic").when(F.col("r").isNull(), "unanswered").otherwise("linked")
    none = F.array().cast("array<string>")
    message = lambda *parts: F.to_json(F.parse_json(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})))
    # a variant's members are sorted by name, at all depths, so its text is canonical
    text = message(F.col("call_id").alias("id"), F.col("tool"), F.col("args").alias("arguments"), F.lit("call").alias("kind"))
    out_c = both.where(is_call).select(*KEY, F.lit("call").alias("kind"), "level", "turn", call_status.alias("status"), "errors", text.alias("json"))
    answer = message(F.col("call_id").alias("id"), F.col("r.content").alias("content"), F.lit("result").alias("kind"))
    status = F.when(~is_call, "orphan").when(cyclic, "cyclic").otherwise("linked")
    out_r = both.where("r is not null").select(*KEY, F.lit("result").alias("kind"), F.when(is_call, F.col("level")).otherwise(0).alias("level"), F.col("r.turn").alias("turn"), status.alias("status"), none.alias("errors"), answer.alias("json"))
    return out_c.unionByName(out_r).unionByName(repeats(c, first_c, "call")).unionByName(repeats(r, first_r, "result"))


def repeats(rows: DataFrame, firsts: DataFrame, kind: str) -> DataFrame:
    """The rows of an id that don't count, once for each repetition."""
    body = [x for x in rows.columns if x not in KEY]
    same = rows.join(firsts.where("n > 1").select(*KEY, F.col("c" if kind == "call" else "r").alias("head")), KEY)
    counted = same.groupBy(*KEY, *body, "head").agg(F.count("*").alias("n"))
    left = counted.withColumn("n", F.col("n") - F.struct(*body).eqNullSafe(F.col("head")).cast("int"))
    each = left.where("n > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    return each.select(*KEY, F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("level"), "turn", F.lit("duplicate").alias("status"), F.array().cast("array<string>").alias("errors"), F.lit(None).cast("string").alias("json"))
