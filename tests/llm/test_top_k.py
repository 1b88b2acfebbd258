import random

import numpy as np
import pytest

from cases import frame, same_as_sql
from waymark.llm import top_k


def test_query_against_sql(spark):
    got, want = same_as_sql(spark, "op12_top_k")
    assert got == want and len(got) > 100


def brute(vectors, queries, k):
    """vectors, queries: lists of (id, list of ints)."""
    single = lambda rows: {i: min(list(v) for j, v in rows if j == i and v is not None and None not in v) for i, v in rows if i is not None and v is not None and None not in v}
    v, q, out = single(vectors), single(queries), []
    for qid, x in q.items():
        scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in v.items() if i != qid)
        out += [(qid, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def got(spark, vectors, queries, k):
    schema = "vec_id long, v array<long>, query_id int, score string, rep string"
    full = lambda rows: frame(spark, [(*r, 1, "x", "y") for r in rows], schema)
    df = top_k.exact_top_k(full(vectors), full(queries), k)
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("spread,k", [(3, 4), (10**6, 3)])
def test_random_vectors(spark, monkeypatch, spread, k):
    monkeypatch.setattr(top_k, "QUERIES", 25 if spread == 3 else 4096)  # several blocks
    rng = np.random.default_rng(spread)
    centres = rng.integers(-spread, spread, (4, 7))
    rows = [(i, (centres[i % 4] + rng.integers(-spread // 3, spread // 3 + 1, 7)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # copies of one
    queries = [r for r in rows if r[0] % 10 == 0]
    assert got(spark, rows, queries, k) == brute(rows, queries, k)


def test_odd_rows(spark):
    rows = [(1, [1, 2, 3]), (2, [1, 2]), (3, []), (4, None), (None, [9, 9, 9]), (5, [1, None]), (6, [-4, 0, 1, 7]), (7, [1, 2, 3]), (7, [1, 2, 3]), (8, [5, 5]), (8, [0, 5])]
    queries = [(1, [1, 2, 3]), (7, [1, 2, 3]), (3, []), (99, [0, 0, 1, 1, 5]), (8, [5, 5]), (None, [1]), (12, None)]
    for k in (2, 20):
        assert got(spark, rows, queries, k) == brute(rows, queries, k)
    assert got(spark, [], queries, 3) == [] and got(spark, rows, [], 3) == []
    assert got(spark, [(1, []), (2, [])], [(1, [])], 3) == [(1, 1, 2, 0)]


def test_scores_near_the_ends_of_a_long(spark):
    big = 3_037_000_000
    rows = [(i, [big - i, 1]) for i in range(40)] + [(100 + i, [-big + i, 5]) for i in range(40)]
    queries = rows[:3] + rows[40:42]
    assert got(spark, rows, queries, 4) == brute(rows, queries, 4)
    with pytest.raises(Exception):
        got(spark, [(1, [1 << 62]), (2, [4])], [(1, [1 << 62])], 1)


def test_packing():
    rng = random.Random(5)
    for dims in (1, 3, 8, 64, 65):
        codes = np.array([[rng.randrange(32) for _ in range(dims)] for _ in range(9)], np.uint8)
        rows = top_k.packed(codes)
        assert rows.shape[1] == -(-dims * top_k.BITS // 8)
        assert (top_k.unpacked(rows, dims) == codes).all()


def test_scan_prunes_most(spark):
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(3000, 64))
    rows = np.floor(64 * rows / np.sqrt((rows**2).sum(axis=1, keepdims=True))).astype(int)
    exact = frame(spark, [(i, v.tolist()) for i, v in enumerate(rows)], "rep long, v array<long>").repartition(1)
    starts, low, high = top_k.cells_of(exact)
    found, told = top_k.candidates(top_k.approximations(exact, starts), rows[:50], low, high, 21)
    bounds = found.collect()
    assert len(bounds) < 50 * 3000 * 0.15
    for r in bounds:
        assert r.least <= 2 * int(rows[r.q] @ rows[r.rep]) <= r.most
    told.destroy()


def test_second_scan_keeps_what_reaches_the_first_ones_scores(spark):
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(3000, 64))
    rows = np.floor(64 * rows / np.sqrt((rows**2).sum(axis=1, keepdims=True))).astype(int)
    exact = frame(spark, [(i, v.tolist()) for i, v in enumerate(rows)], "rep long, v array<long>").repartition(2)
    starts, low, high = top_k.cells_of(exact)
    approx = top_k.approximations(exact, starts)
    told = spark.sparkContext.broadcast(top_k.Bounds(rows[:50], low, high))
    scores = rows[:50] @ rows.T
    first = {(r.q, r.rep) for r in top_k.promising(approx, told, 21).collect()}
    assert len(first) == 2 * 50 * 21  # of each task
    kth = [sorted((scores[q, rep] for a, rep in first if a == q), reverse=True)[20] for q in range(50)]
    floors = spark.sparkContext.broadcast(2.0 * np.array(kth))
    left = {(r.q, r.rep) for r in top_k.reaching(approx, told, floors).collect()}
    assert {(q, i) for q in range(50) for i in np.flatnonzero(scores[q] >= kth[q])} <= left
    found, sent = top_k.candidates(approx, rows[:50], low, high, 21)
    assert len(left) < found.count() / 2
    for t in (told, floors, sent):
        t.destroy()
