import math
from functools import reduce

import numpy as np
import pytest

from cases import frame, same_as_sql
from waymark.llm import vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def brute(rows, cosine=0.93):
    good = {}
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(np.array(v, np.float32), np.float64)
        good[i] = (label, x / np.sqrt(x @ x))
    links = {i: {j for j in good if j != i and good[j][0] == good[i][0] and len(good[j][1]) == len(good[i][1]) and good[i][1] @ good[j][1] >= cosine} for i in good}
    out = {}
    for i, *_ in rows:
        if i not in good:
            out[i] = (0, i)
            continue
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen))
    return out


def run(spark, rows):
    df = vector_dedup.near_vectors(frame(spark, rows, SCHEMA), 0.93)
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in df.collect()}, df


@pytest.mark.parametrize("dims,seed", [(64, 0), (10, 1), (3, 2)])
def test_random_clusters(spark, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dims))
    rows = []
    for i in range(240):
        v = centres[rng.integers(12)] + rng.standard_normal(dims) * rng.choice([0.0, 0.1, 0.25, 0.4])
        rows.append((i, [float(x) for x in v], int(rng.integers(3)), "x"))
    got, _ = run(spark, rows)
    assert got == brute(rows)


def test_cells_of_several_parts(spark, monkeypatch):
    """Cells that are dealt into parts find the same links, each once."""
    monkeypatch.setattr(vector_dedup, "PART", 8)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 16))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.standard_normal(16) * 0.2], 0, "x") for i in range(150)]
    got, _ = run(spark, rows)
    assert got == brute(rows)


def test_odd_vectors(spark):
    e = [1.0, 0.0, 0.5]
    rows = [(1, e, 1, None), (2, e, 1, None), (3, [2.0, 0.0, 1.0], 1, None), (4, e, 2, None), (5, e, None, None), (6, None, 1, None), (7, [0.0] * 3, 1, None), (8, [float("nan"), 1.0, 0.0], 1, None), (9, [float("inf"), 1.0, 0.0], 1, None), (10, [None, 1.0, 0.0], 1, None), (11, [], 1, None), (12, [1.0, 0.0], 1, None), (13, [-1.0, 0.0, -0.5], 1, None), (14, [1e30, 0.0, 5e29], 1, None)]
    got, df = run(spark, rows)
    assert got == brute(rows)
    assert got[1] == (3, 1) and got[14] == (3, 1) and got[13] == (0, 13)
    assert {r["vec_id"] for r in df.where("kept").collect()} == {i for i, (_, c) in got.items() if i == c}


def test_pairs_that_rounding_decides(spark):
    """Cosines that are the least one exactly, or next to it, are those of the vectors, not of rotated ones."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(200):
        a, b = np.linalg.qr(rng.standard_normal((16, 2)))[0].T
        c = 0.93 + rng.choice([-1e-15, 0, 1e-15])
        rows += [(2 * k, a.tolist(), k, None), (2 * k + 1, (c * a + math.sqrt(1 - c * c) * b).tolist(), k, None)]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_vectors(df, 0.93).collect()}
    dot = lambda x, y: reduce(lambda s, z: s + z, (u * v for u, v in zip(x, y)), 0.0)
    want = {}
    for (i, x, *_), (j, y, *_) in zip(rows[::2], rows[1::2]):
        want[i] = want[j] = int(dot(x, y) / (math.sqrt(dot(x, x)) * math.sqrt(dot(y, y))) >= 0.93)
    assert got == want and 0 < sum(want.values()) < len(want)


def test_rows_that_repeat_an_id(spark):
    rows = [(1, [1.0, 0.0], 1, None), (1, [1.0, 0.0], 1, None), (2, [1.0, 0.01], 1, None), (None, [1.0, 0.0], 1, None)]
    got = vector_dedup.near_vectors(frame(spark, rows, SCHEMA), 0.93).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in got) == [(0, 0, 0), (1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_empty(spark):
    assert run(spark, [])[0] == {}


def test_many_copies_stay_linear(spark):
    rows = [(i, [1.0, 2.0, 3.0 + (i % 3) * 1e-3], 1, None) for i in range(1500)]
    got, _ = run(spark, rows)
    assert set(got.values()) == {(1499, 0)}


def test_query_matches_sql(spark):
    got, want = same_as_sql(spark, "op2_vector_dedup")
    assert got == want
