"""A corpus pipeline of five operators, each stage on all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import decontaminate, lang_id, mixing, ngram_join, token_bin
from waymark.llm.common import shared_dir, stored, table, word_count
from waymark.llm.queries import default_tokenizer

#: A document goes if its language can't be told, or is told with a score below this.
LEAST_SCORE = 0.2


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is told; models are fitted on a sample of the labelled ones."""
    model = lang_id.train(docs)
    kept = lang_id.predict(docs, model, "_lang_pred", "_score").where((F.col("_lang_pred") != lang_id.UNKNOWN) & (F.col("_score") >= LEAST_SCORE))
    return kept.select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: 5-word shingles, similarity 0.8 or more, the smallest doc_id.

    Rows without a doc_id stay; rows that repeat one stay or go together.
    """
    groups = ngram_join.jaccard_components(docs, 5, 4, 5)
    return docs.join(groups.where("doc_id != component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A second copy is a row of its own; its doc_id is the first one's, so that ids
    stay those of documents. Rows that share a doc_id, or have none, are each taken
    as often as the one of them that is taken most.
    """
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    copies = mixing.mix_sources(stored(sizes, "sizes")).groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").cast("int").alias("_copies")).where("_copies > 0")
    taken = docs.join(copies, F.col("doc_id").eqNullSafe(F.col("_id"))).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return taken.select(*docs.columns)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files, reads them back, and returns a row for each document in them."""
    return token_bin.token_rows(docs, default_tokenizer(), 2)


STAGES = [
    ("language ID", identified),
    ("n-gram Jaccard join", without_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", tokenised),
]

#: Trained models, similarity joins and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's result is written to the shared folder and reread."""
    docs, out = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{k}")
        docs = spark.read.parquet(f"{out}/{k}")
    return docs
