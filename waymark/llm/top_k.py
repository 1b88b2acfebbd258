"""Exact top-k search by inner product with vector-approximation files.

Every distinct vector has an approximation: in each dimension the number of the cell
that its component lies in, a few bits. A scan of the approximations bounds each
score from both sides. A first scan finds the most promising vectors of each query,
whose exact scores say what its k-th result reaches at least; a second scan keeps only
what may reach that, and of it exact vectors are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import discard, shared_dir, stored

#: Bits of a cell's number: a dimension has 2 to this power of cells at most.
BITS = 5
#: Queries that are scanned for at once; their vectors and bounds are what a task holds of them.
QUERIES = 4096
#: Components of approximations that a task unpacks at once.
UNPACKED = 1 << 16
#: Exact vectors are read for so many promising candidates a result before the second scan.
FIRST = 2


def cells_of(vectors: DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of each dimension: where its cells begin, and the least and greatest component in each cell (two tables).

    Cells are cut at quantiles of all vectors' components, approximate ones, which
    costs tightness and no result. Shorter vectors count as followed by zeros.
    """
    n = 1 << BITS
    marks = F.percentile_approx("x", [i / n for i in range(1, n)], 100 * n)
    at = vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.min("x").alias("low"), F.max("x").alias("high"), marks.alias("marks"), F.count("*").alias("n"))
    rows, total = at.orderBy("i").collect(), vectors.count()  # a row a dimension
    starts, low, high = [], np.zeros((len(rows), n), object), np.zeros((len(rows), n), object)
    for r in rows:
        least, most = (r.low, r.high) if r.n == total else (min(r.low, 0), max(r.high, 0))
        cuts = sorted({m for m in r.marks if least < m <= most})
        starts.append(np.array(cuts, np.int64))
        low[r.i, : len(cuts) + 1] = [least, *cuts]
        high[r.i, : len(cuts) + 1] = [*(c - 1 for c in cuts), most]
    return starts, low, high


def packed(codes: np.ndarray) -> np.ndarray:
    """A row of bytes for each row of cell numbers, BITS bits each."""
    bits = (codes[:, :, None] >> np.arange(BITS, dtype=np.uint8)) & 1
    return np.packbits(bits.reshape(len(codes), -1).astype(np.uint8), axis=1)


def unpacked(rows: np.ndarray, dims: int) -> np.ndarray:
    bits = np.unpackbits(rows, axis=1, count=dims * BITS).reshape(len(rows), dims, BITS)
    return bits @ (1 << np.arange(BITS, dtype=np.uint8))


def _padded(column: pa.ListArray, dims: int) -> np.ndarray:
    """Lists of whole numbers as rows of a matrix, followed by zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(ends), dims), np.int64)
    out[np.arange(dims) < ends[:, None]] = flat
    return out


def approximations(exact: DataFrame, starts: list[np.ndarray]) -> DataFrame:
    """(rep, cells): the packed cell numbers of each distinct vector."""
    dims = len(starts)

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, step := max(1, UNPACKED // max(1, dims))):
                part = batch.slice(first, step)
                x = _padded(part.column(1), dims)
                codes = np.zeros(x.shape, np.uint8)
                for i, s in enumerate(starts):
                    codes[:, i] = np.searchsorted(s, x[:, i], "right")
                rows = packed(codes)
                ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
                cells = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])
                yield pa.RecordBatch.from_arrays([part.column(0), cells], ["rep", "cells"])

    return exact.select("rep", "v").mapInArrow(approximate, "rep long, cells binary")


class Bounds:
    """A block of queries, and from approximations the middles and half widths of the bounds of twice their scores."""

    def __init__(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.dims = len(low)
        # bounds of twice the score are whole numbers: middles (low + high) and widths (high - low)
        middle, width = low + high, high - low
        largest = sum(int(np.abs(middle[i]).max() + width[i].max()) * int(np.abs(queries[:, i].astype(object)).max(initial=0)) for i in range(self.dims))
        kind = np.float32 if largest < 1 << 24 else np.float64
        # where products don't fit into a mantissa, bounds are widened by more than rounding can take
        self.slack = 0.0 if largest < 1 << 53 else float(largest) * 2.0**-50 * (self.dims + 1)
        self.queries, self.kind = len(queries), kind
        self.q, self.size, self.middles, self.widths = (np.ascontiguousarray(m, np.float64).astype(kind) for m in (queries.T, np.abs(queries.T.astype(np.float64)), middle.astype(np.float64), width.astype(np.float64)))

    def of(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """reps, and a row a query of middles and of half widths, for some approximations at a time."""
        at = np.arange(self.dims)
        for batch in batches:
            for first in range(0, batch.num_rows, step := max(1, min(1024, UNPACKED // max(1, self.dims)))):
                part = batch.slice(first, step)
                cells = part.column(1)
                rows = np.frombuffer(cells.buffers()[2] or b"", np.uint8).reshape(-1, (self.dims * BITS + 7) // 8)[cells.offset :][: len(cells)] if self.dims else np.zeros((len(cells), 0), np.uint8)
                codes = unpacked(rows, self.dims)
                yield part.column(0).to_numpy(), (self.middles[at, codes] @ self.q).T, (self.widths[at, codes] @ self.size).T + self.kind(self.slack)


def promising(approx: DataFrame, told: Broadcast, k: int) -> DataFrame:
    """(q, rep, middle): of the approximations of each task those with the k greatest middles for each query."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = told.value
        best, reps = np.full((bounds.queries, k), -np.inf, bounds.kind), np.zeros((bounds.queries, k), np.int64)
        for rep, middle, _ in bounds.of(batches):
            # most rows overtake none of a query's best, so only the few that do are sorted in
            least = best.min(axis=1)
            for i in np.flatnonzero((middle > least[:, None]).any(axis=1)):
                new = np.flatnonzero(middle[i] > least[i])
                m, r = np.concatenate([best[i], middle[i, new]]), np.concatenate([reps[i], rep[new]])
                top = np.argpartition(-m, k - 1)[:k]
                best[i], reps[i] = m[top], r[top]
        i, j = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(reps[i, j]), pa.array(best[i, j].astype(np.float64))], ["q", "rep", "middle"])

    return approx.mapInArrow(scan, "q int, rep long, middle double")


def reaching(approx: DataFrame, told: Broadcast, floors: Broadcast) -> DataFrame:
    """(q, rep): what may reach a query's floor, a number that twice a score is compared to."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rep, middle, width in told.value.of(batches):
            i, j = np.nonzero(middle + width >= floors.value[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(rep[j])], ["q", "rep"])

    return approx.mapInArrow(scan, "q int, rep long")


def candidates(approx: DataFrame, queries: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[DataFrame, Broadcast]:
    """(q, rep, least, most): vectors that may be among the k best of the q-th query by their bounds alone, with bounds of twice their score.

    A task scans its approximations against all queries of the block and keeps what
    may be among the k best of those that it has seen.
    """
    told = approx.sparkSession.sparkContext.broadcast(Bounds(queries, low, high))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((told.value.queries, k), -np.inf, told.value.kind)  # the k best lower bounds so far, in no order
        kept: list[tuple[np.ndarray, ...]] = []
        held = 0
        for rep, middle, width in told.value.of(batches):
            lower, upper = middle - width, middle + width
            best = -np.partition(-np.concatenate([best, lower], axis=1), k - 1, axis=1)[:, :k]
            i, j = np.nonzero(upper >= best.min(axis=1)[:, None])
            kept.append((i.astype(np.int32), rep[j], lower[i, j].astype(np.float64), upper[i, j].astype(np.float64)))
            held += len(i)
            if held > 4_000_000:  # those that later rows have overtaken go
                kept = [_still(kept, best)]
                held = len(kept[0][0])
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _still(kept, best)], ["q", "rep", "least", "most"])

    return approx.mapInArrow(scan, "q int, rep long, least double, most double"), told


def _still(kept: list[tuple[np.ndarray, ...]], best: np.ndarray) -> tuple[np.ndarray, ...]:
    i, rep, lower, upper = (np.concatenate(c) for c in zip(*kept))
    ok = upper >= best.min(axis=1)[i]
    return i[ok], rep[ok], lower[ok], upper[ok]


def scored(pairs: DataFrame, exact: DataFrame, queries: np.ndarray) -> tuple[DataFrame, Broadcast]:
    """(q, rep, score) of (q, rep), from the exact vectors. A score that a long can't hold is an error."""
    told = pairs.sparkSession.sparkContext.broadcast(queries)
    dims = queries.shape[1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, step := max(1, 16 * UNPACKED // max(1, dims))):
                part = batch.slice(first, step)
                x, y = _padded(part.column(2), dims), told.value[part.column(0).to_numpy()]
                if (np.abs(x.astype(np.float64)) * np.abs(y.astype(np.float64))).sum(axis=1).max(initial=0) < 2.0**62:
                    products = pa.array(np.einsum("ij,ij->i", x, y))
                else:
                    products = pa.array([sum(map(int.__mul__, a, b)) for a, b in zip(x.tolist(), y.tolist())], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), products], ["q", "rep", "score"])

    return pairs.join(exact.select("rep", "v"), "rep").select("q", "rep", "v").mapInArrow(score, "q int, rep long, score long"), told


def best_of_block(approx: DataFrame, exact: DataFrame, queries: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[DataFrame, list[DataFrame]]:
    """(q, rep, score): the k best distinct vectors of each query of a block, ties to the smaller rep; the tables to discard later."""
    context = approx.sparkSession.sparkContext
    told = context.broadcast(Bounds(queries, low, high))
    by_middle = Window.partitionBy("q").orderBy(F.desc("middle"), "rep")
    first = promising(approx, told, k).withColumn("_n", F.row_number().over(by_middle)).where(F.col("_n") <= FIRST * k)
    read, sent = scored(first.select("q", "rep"), exact, queries)
    kth = read.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("_n") == k)
    floor = np.full(len(queries), -np.inf)
    for r in kth.select("q", "score").collect():  # a row a query of the block
        # a double below twice a score that it can't hold; what only ties with the k-th score stays
        floor[r.q] = np.nextafter(2.0 * r.score, -np.inf)
    floors = context.broadcast(floor)
    pairs = stored(reaching(approx, told, floors), "reaching")
    read, again = scored(pairs, exact, queries)
    done = stored(read, "scores")
    for t in (told, floors, sent, again):
        t.destroy()
    discard(pairs)
    ranked = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))
    return done.withColumn("_n", ranked).where(F.col("_n") <= k).drop("_n"), [done]


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "v") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query, ties to the smaller id.

    vectors and queries: an id (whole number) and an array of whole numbers; other
    columns are ignored, whatever their names. A query's candidates are all vectors
    but those with its own id; with fewer than k of them it gets all. Of rows that
    repeat an id the one with the smallest vector counts. A vector that is shorter
    than another counts as followed by zeros; an empty one scores 0 with all. Rows
    whose id or vector is null, or whose vector holds a null, take no part. Empty
    tables give an empty result. Scores have to fit into a long, else there is an
    error.

    Equal vectors are one with its k + 1 smallest ids, so copies are scanned and read
    once; equal queries are one too. Queries are taken in blocks of QUERIES; for each
    block two scans of the approximations, each followed by exact reads.
    """
    spark = vectors.sparkSession
    fine = lambda d: d.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<long>").alias("v")).where("id is not null and v is not null and not exists(v, x -> x is null)").groupBy("id").agg(F.min("v").alias("v"))
    numbered = fine(vectors).withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_n") <= k + 1)
    exact = stored(numbered.groupBy("v").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("ids")), "exact")
    asked = fine(queries)
    each = stored(asked.groupBy("v").agg(F.min("id").alias("query"), F.count("*").alias("n")), "queries")
    starts, low, high = cells_of(exact)
    approx = stored(approximations(exact, starts), "approximations")
    out = f"{shared_dir(spark)}/top-k-{uuid.uuid4().hex}"
    schema = "query long, top array<struct<score:long,id:long>>"
    blocks = -(-each.count() // QUERIES)
    parts = stored(each.select("query", "v", F.pmod(F.xxhash64("query"), F.lit(max(1, blocks))).cast("int").alias("block")), "blocks")
    spark.createDataFrame([], schema).write.parquet(out)
    for b in range(blocks):
        rows = parts.where(F.col("block") == b).orderBy("query").collect()  # about QUERIES rows
        dims = max([len(starts), *(len(r.v) for r in rows)], default=0)
        if not rows:
            continue
        block = np.zeros((len(rows), dims), np.int64)
        for i, r in enumerate(rows):
            block[i, : len(r.v)] = r.v
        best, held = best_of_block(approx, exact, block[:, : len(starts)], low, high, k + 1)
        names = spark.createDataFrame([(i, r["query"]) for i, r in enumerate(rows)], "q int, query long")
        ids = best.join(exact.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("id"))
        ids = ids.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("_n") <= k + 1)
        tops = ids.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("score"), "id"))).alias("top"))
        tops.join(F.broadcast(names), "q").select("query", "top").write.mode("append").parquet(out)
        for t in held:
            discard(t)
    tops = spark.read.schema(schema).parquet(out)
    mine = asked.join(each.select("v", "query"), "v").select("id", "query").join(tops, "query")
    others = F.slice(F.filter("top", lambda x: x["id"] != F.col("id")), 1, k)
    ranked = mine.select(F.col("id").alias("query_id"), F.posexplode(others).alias("rank", "x"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.score")).alias("score"))
