"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors are rotated and split into low-dimensional blocks. Two vectors whose
squared distance is within the budget are, in some block, within that block's
proportional share of it. So each block is range-joined by itself on a grid, and
the union of what the blocks find is verified exactly by cosine. A pair counts in
the first block that finds it, so pairs never leave the task that finds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import stored
from waymark.llm.components import components

#: Dimensions of a block.
BLOCK_DIMS = 8
#: Vectors of one grid cell in one group, about; a cell with more meets itself in parts. A vector goes to
#: about three groups for each part of its cell, so parts are as large as a task's memory easily holds: megabytes.
PART = 4096
SEED = 20240517
#: Added to budgets, against rounding.
SLACK = 1e-9
#: Cosines of rotated vectors this near to the least one are taken again of the vectors themselves.
ROUNDING = 1e-11


def rotation(dims: int) -> np.ndarray:
    """A random orthogonal matrix, the same for every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks(dims: int, size: int = BLOCK_DIMS) -> list[slice]:
    return [slice(a, min(a + size, dims)) for a in range(0, dims, size)]


def budget(cosine: float) -> float:
    """Squared distance of unit vectors with this cosine."""
    return 2 * (1 - cosine)


def rotated(vectors: DataFrame, id_col: str, cosine: float) -> DataFrame:
    """label, rep, n, dims, unit (rotated; doubles as binary, which no row unpacks before its group does), cells (array<int>, by block)."""
    total = budget(cosine) + SLACK

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, units, cells = [], [], []
            for values in batch.column(3).to_pylist():
                x = np.array(values, np.float64)
                x /= np.abs(x).max()
                x = (x / np.sqrt((x * x).sum())) @ rotation_of(len(x))
                dims.append(len(x))
                units.append(x.tobytes())
                cells.append([int(np.floor(x[b.start] / np.sqrt(total * (b.stop - b.start) / len(x)))) for b in blocks(len(x))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(dims, pa.int32()), pa.array(units, pa.binary()), pa.array(cells, pa.list_(pa.int32()))], ["label", "rep", "n", "dims", "unit", "cells"])

    made: dict[int, np.ndarray] = {}

    def rotation_of(dims: int) -> np.ndarray:
        if dims not in made:
            made[dims] = rotation(dims)
        return made[dims]

    kind = dict(vectors.dtypes)
    return vectors.select("label", id_col, "n", "embedding").mapInArrow(turn, f"label {kind['label']}, rep long, n long, dims int, unit binary, cells array<int>")


def _links(group: pa.Table, cosine: float) -> pa.Table:
    """Of one group of one block: each vector's links (weighted by copies) and a spanning star of them.

    Also, with links null, the pairs that rounding might decide.
    """
    total = budget(cosine) + SLACK
    ids, n = group.column("rep").to_numpy(), group.column("n").to_numpy()
    side = group.column("side").to_numpy()
    units = np.frombuffer(b"".join(group.column("unit").to_pylist()), np.float64).reshape(len(ids), -1)
    b = group.column("block")[0].as_py()
    parts = blocks(units.shape[1])
    share = [total * (p.stop - p.start) / units.shape[1] for p in parts]
    counts, up, unsure = np.zeros(len(ids), np.int64), np.arange(len(ids)), [np.zeros((2, 0), np.int64)]

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    # (budget - squared distance) / 2 as one product, in single precision: it only leaves out what is clearly farther
    block, single = units[:, parts[b]], units.astype(np.float32)
    half = ((block * block).sum(axis=1) / 2)[:, None]
    one = np.ones_like(half)
    x, y = (np.hstack(v).astype(np.float32) for v in ((block, -half, one), (block, one, share[b] / 2 - half)))
    y = y[right].T
    for first in range(0, len(left), 256):
        rows = left[first : first + 256]
        i, j = np.nonzero(x[rows] @ y >= -1e-5)
        i, j = rows[i], right[j]
        ok = (i < j) if group.column("alone")[0].as_py() else np.ones(len(i), bool)
        i, j = i[ok], j[ok]
        for at in range(0, len(i), 50_000):
            p, q = i[at : at + 50_000], j[at : at + 50_000]
            # cosines in single precision leave out nearly all, and of the rest the first block that finds a pair counts it
            close = np.einsum("ij,ij->i", single[p], single[q]) >= cosine - 1e-4
            p, q = p[close], q[close]
            gaps = np.stack([((units[p, s] - units[q, s]) ** 2).sum(axis=1) for s in parts], axis=1) <= np.array(share)
            p, q = (v[gaps[:, b] & ~gaps[:, :b].any(axis=1)] for v in (p, q))
            dot = (units[p] * units[q]).sum(axis=1)
            near = np.abs(dot - cosine) <= ROUNDING
            unsure.append(np.stack([ids[p[near]], ids[q[near]]]))
            links = (dot > cosine) & ~near
            p, q = p[links], q[links]
            np.add.at(counts, p, n[q])
            np.add.at(counts, q, n[p])
            while (up[up] != up).any():
                up = up[up]
            apart = up[p] != up[q]
            for u, v in zip(p[apart].tolist(), q[apart].tolist()):
                u, v = root(u), root(v)
                if u != v:
                    up[max(u, v)] = min(u, v)
    got = np.flatnonzero(counts)
    roots = np.array([root(i) for i in got.tolist()], np.int64)
    a, b = np.concatenate(unsure, axis=1)
    links = pa.concat_arrays([pa.array(counts[got]), pa.nulls(len(a), pa.int64())])
    return pa.table({"a": np.concatenate([ids[got], a]), "b": np.concatenate([ids[roots] if len(roots) else ids[:0], b]), "links": links})


def decided(unsure: DataFrame, same: DataFrame, cosine: float) -> DataFrame:
    """(a, b, links) both ways of the pairs whose cosine, of the vectors as they are, is high enough."""
    side = lambda k: same.select(F.col("rep").alias(k), F.col("embedding").alias(f"e{k}"), F.col("n").alias(f"n{k}"))
    p = unsure.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, x: s + x)
    p = p.where(dot("ea", "eb") / (F.sqrt(dot("ea", "ea")) * F.sqrt(dot("eb", "eb"))) >= cosine)
    return p.select("a", "b", F.col("nb").alias("links")).unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("na").alias("links")))


def near_vectors(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors.

    vectors: vec_id long (unique), embedding array of numbers, label; other columns
    are ignored. Vectors link where labels are equal and not null, lengths are equal
    and the cosine is at least ``cosine``. n_links counts all vectors linked
    directly, component_id is the smallest vec_id that links reach, kept marks the
    one vector of each component with that id. Null, empty and zero vectors, those
    with null or non-finite components and those without a label link with nothing.
    Equal vectors are one with a count. Empty tables give an empty result.
    """
    e = F.col("embedding").cast("array<double>")
    fine = F.col(id_col).isNotNull() & F.col("label").isNotNull() & e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    v = vectors.select(F.col(id_col).alias("id"), "label", e.alias("embedding"), F.coalesce(fine, F.lit(False)).alias("fine"))
    same = v.where("fine").groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    same = stored(same, "vectors")
    units = stored(rotated(same, "rep", cosine), "units")
    spot = units.select("label", "rep", "n", "unit", "dims", F.posexplode("cells").alias("block", "cell"))
    cell = ["label", "dims", "block", "cell"]
    counts = spot.groupBy(*cell).agg(F.count("*").alias("held"))
    k = lambda c: F.coalesce(F.ceil(F.col(c) / PART), F.lit(0)).cast("int")
    after = counts.select("label", "dims", "block", (F.col("cell") - 1).alias("cell"), F.col("held").alias("next"))
    before = counts.select("label", "dims", "block", (F.col("cell") + 1).alias("cell"), F.col("held").alias("last"))
    grid = counts.join(after, cell, "left").join(before, cell, "left").select(*cell, k("held").alias("parts"), k("next").alias("next"), k("last").alias("last"))
    d = spot.join(grid, cell).withColumn("part", F.pmod(F.xxhash64("rep", "block"), F.col("parts")).cast("int"))
    # within a cell: each pair of parts, and a part with itself
    within = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.col("cell").alias("at"), F.least("part", o).alias("i"), F.greatest("part", o).alias("j"), F.when(F.col("part") == o, 2).when(F.col("part") < o, 0).otherwise(1).alias("side"), F.lit(0).alias("step")))
    none = F.array().cast("array<struct<at:int,i:int,j:int,side:int,step:int>>")
    ahead = F.when(F.col("next") > 0, F.transform(F.sequence(F.lit(0), F.col("next") - 1), lambda o: F.struct(F.col("cell").alias("at"), F.col("part").alias("i"), o.alias("j"), F.lit(0).alias("side"), F.lit(1).alias("step")))).otherwise(none)
    behind = F.when(F.col("last") > 0, F.transform(F.sequence(F.lit(0), F.col("last") - 1), lambda o: F.struct((F.col("cell") - 1).alias("at"), o.alias("i"), F.col("part").alias("j"), F.lit(1).alias("side"), F.lit(1).alias("step")))).otherwise(none)
    dealt = d.select("label", "dims", "block", "rep", "n", "unit", F.explode(F.concat(within, ahead, behind)).alias("g")).select("label", "dims", "block", "rep", "n", "unit", "g.*")
    alone = (F.col("step") == 0) & (F.col("i") == F.col("j"))
    rows = dealt.select(*cell[:3], "at", "i", "j", "step", "rep", "n", "unit", "side", alone.alias("alone"))
    links = stored(rows.groupBy(*cell[:3], "at", "i", "j", "step").applyInArrow(lambda g: _links(g, cosine), "a long, b long, links long"), "vector-links")
    links = links.where("links is not null").unionByName(decided(links.where("links is null"), same, cosine))
    reach = components(links.select("a", "b"))
    direct = links.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("direct"))
    known = same.join(direct, "rep", "left").join(reach.select(F.col("id").alias("rep"), "component"), "rep", "left")
    known = known.select("label", "embedding", (F.coalesce("direct", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = v.where("fine").join(known, ["label", "embedding"]).select("id", "n_links", "component_id")
    out = linked.unionByName(v.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
