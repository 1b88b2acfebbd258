"""Tables kept in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def dealt(df: DataFrame, *keys: str | Column, rows: int = 0, each: int = 1) -> DataFrame:
    """Rows dealt out by keys to as many parts as the session shuffles to, which are not merged when they are small.

    For rows that become many more, or are walked through for long, in the tasks that
    read them. Where there are many rows, there are more parts, of about each rows.
    """
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(rows / each)), *keys)


def kept(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """The table written to the shared folder, or under a path, and read back; executors can be lost after that."""
    spark = df.sparkSession
    path = f"{path or shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
