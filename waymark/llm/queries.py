"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import chat_tools, decontaminate, katz, lang_id, mixing, ngram_join, periodic_runs, secret_scan, spelling, token_bin, top_k, url_rules, vector_dedup
from waymark.llm.common import WORD, stored, table, word_count
from waymark.llm.oracle import ORACLE_SQL  # noqa: F401

#: The rules that op9 judges by.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: Tools that op1's calls are checked against: tool, argument, type, required.
TOOLS = [
    ("ask", "prompt", "STRING", True),
    ("ask", "turn", "BIGINT", True),
    ("ask", "note", "STRING", False),
    ("lookup", "prompt", "STRING", True),
    ("lookup", "turn", "STRING", True),
]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn is a call, the assistant's next turn its result; see conversation_calls."""
    calls, results = conversation_calls(table(spark, sf_dir, "conversations"))
    return chat_tools.link_calls(calls, results, spark.createDataFrame(TOOLS, "tool string, name string, type string, required boolean"))


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results out of plain turns.

    A user's turn t is call c<t> of tool ask (of lookup where t is divisible by 6)
    and needs the result of call c<t - 2>; an assistant's turn t answers call c<t - 1>.
    """
    t = F.col("turn")
    call_id = lambda n: F.concat(F.lit("c"), n.cast("string"))
    arguments = F.to_json(F.struct(t.alias("turn"), F.col("text").alias("prompt")), {"ignoreNullFields": "false"})
    tool = F.when(t % 6 == 0, "lookup").otherwise("ask")
    calls = turns.where("role = 'user'").select("conv_id", call_id(t).alias("call_id"), "turn", tool.alias("tool"), arguments.alias("arguments"), F.array(call_id(t - 2)).alias("needs"))
    results = turns.where("role = 'assistant'").select("conv_id", call_id(t - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_bin.token_rows(table(spark, sf_dir, "documents"), default_tokenizer(), 2)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), 3, 9, 10)


def op7_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mixing.mix_sources(stored(docs, "sizes")).select("doc_id", "size", "source_size", "target", "taken")


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, spark.createDataFrame(URL_RULES, url_rules.RULES)).select("page_id", "host", "path", "rule", "verdict")


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(table(spark, sf_dir, "documents"))


def id_hash(doc_id) -> F.Column:
    """crc32 of the id in decimal; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(spelling.vocabulary(table(spark, sf_dir, "documents"), 97))


def whole_components(vectors: DataFrame) -> DataFrame:
    """op12's vectors: vec_id and v, floor(64 x) of each component; only those all of whose components are finite."""
    e = F.col("embedding").cast("array<double>")
    v = vectors.select("vec_id", e.alias("e")).where("e is not null and forall(e, x -> x is not null and not isnan(x) and abs(x) != double('infinity'))")
    return v.select("vec_id", F.transform("e", lambda x: F.floor(64 * x)).alias("v"))


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = whole_components(table(spark, sf_dir, "embeddings"))
    return top_k.exact_top_k(v, v.where("vec_id % 20 = 0"), 20)


def with_periods(docs: DataFrame) -> DataFrame:
    """op13's documents: doc_id, text.

    With h the crc32 of the doc_id and g = floor(h / 10), texts whose h is divisible
    by 10 repeat, from word a = g % n on, the p = 1 + floor((n - a) / (3 + g % 8))
    words that stand there; n is the number of words. Other texts stay as they are.
    """
    d = docs.select("doc_id", "text", id_hash(F.col("doc_id")).alias("_h"))
    d = d.withColumn("_w", F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    d = d.withColumns({"_n": F.size("_w"), "_g": F.floor(F.col("_h") / 10)})
    d = d.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    d = d.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    times = F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), times)), F.lit(1), F.col("_n") - F.col("_a"))
    changed = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), tail), " ")
    return d.select("doc_id", F.when(F.col("_a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_periods(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), periodic_runs.longest(F.col("runs")).alias("r"), digest(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))
    exponent = F.expr("1000 * r.length div r.period")
    return out.select("doc_id", "n_runs", "r.*", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {f.__name__: f for f in (op1_chat_tools, op2_vector_dedup, op3_decontaminate, op4_token_bin, op5_secret_scan, op6_ngram_join, op7_lang_id, op8_mixing, op9_url_rules, op10_katz, op11_spelling, op12_top_k, op13_periodic_runs)}
