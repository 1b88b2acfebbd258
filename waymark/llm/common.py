"""Helpers that several operators share: shared tables, token hashing, text slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Text handled at once inside a Python task, in bytes; bounds its memory, which is some 50 times this for hashes and token ids.
SLICE_BYTES = 1 << 20
#: Texts taken out of a batch at once.
SLICE_ROWS = 256

#: Bits of a filter that is broadcast, at most: 16 MB.
FILTER_BITS = 1 << 27

#: Spark's own setting for removing the shuffle files of a query that has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts the lineage.

    Shuffle files that only the write needed go when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that ``stored`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def likely(rows: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows whose key may be among ids, and few others: a filter in front of a join, which it spares a shuffle.

    Hashes of ids set bits of bitmaps, 64 bits an id up to FILTER_BITS in all, so
    what is broadcast has a fixed bound. With more ids the filter lets more rows
    pass, and takes nothing from the join's result.
    """
    bits = min(FILTER_BITS, max(1 << 12, 1 << (64 * ids.count()).bit_length()))
    spot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits))
    at = ids.select(spot(id_col).alias("spot")).select(F.expr("spot div 64").alias("word"), F.expr("shiftleft(1L, int(spot % 64))").alias("bit"))
    words = at.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    filled = F.map_from_entries(F.collect_list(F.struct((F.col("word") % 64).cast("int"), "bits")))
    maps = words.groupBy(F.expr("word div 64").alias("_map")).agg(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.element_at(filled, i), F.lit(0).cast("long"))).alias("_bits"))
    r = rows.withColumn("_spot", spot(key)).withColumn("_map", F.expr("_spot div 4096"))
    r = r.join(F.broadcast(maps), "_map").where("getbit(_bits[int(_spot div 64 % 64)], int(_spot % 64)) = 1")
    return r.select(*rows.columns)


def sampled(rows: DataFrame, bound: int) -> DataFrame:
    """About ``bound`` distinct rows at most: those whose texts have the lowest hashes, a share of bound / count.

    Hashes are of the text alone, so that neither rows without an id nor a text that
    very many rows repeat make the sample larger.
    """
    share = min(1.0, bound / max(1, rows.count()))
    low = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    return rows.where(low).dropDuplicates()


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def part_of(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id counts as the text 'null'."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), F.lit(buckets))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte.
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """The first n powers of base, kept by the process."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        held = np.full(n + n // 4 + 1, base, np.uint64)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        _POWERS[base] = held
    return held[:n]


def window_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[starts:ends], all windows at once, by a polynomial prefix sum."""
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=prefix[1:])
    shift = powers(len(values) + 1, _UNBASE)
    return mix((prefix[ends] - prefix[starts]) * shift[starts] + (ends - starts).astype(np.uint64))


def in_slices(texts: Iterable[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) in slices of about SLICE_BYTES; null counts as empty."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text or b"")
        size += len(held[-1])
        if size >= SLICE_BYTES:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def slices(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """A column's texts as UTF-8, in slices."""
    return in_slices(text for at in range(0, len(column), SLICE_ROWS) for text in column.slice(at, SLICE_ROWS).cast(pa.large_binary()).to_pylist())


def word_hashes(texts: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, A-Z lower-cased unless told not to; offsets of each text's words. A slice is hashed at a time."""
    hashes, sizes = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for _, part in in_slices(texts):
        words, bounds = _slice_hashes(part, fold)
        hashes.append(words)
        sizes.append(np.diff(bounds))
    return np.concatenate(hashes), np.cumsum(np.concatenate(sizes))


def _slice_hashes(texts: list[bytes], fold: bool) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    space = _SPACE[data]
    before = np.concatenate(([True], space[:-1]))
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(space & ~before)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return window_hashes(BYTE_CODES[_FOLD[data] if fold else data], starts, ends), np.searchsorted(starts, bounds)
