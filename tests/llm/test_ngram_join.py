import random
import re

import numpy as np
import pytest

from cases import frame, same_as_sql
from waymark.llm import components, ngram_join

SCHEMA = "doc_id long, text string, component_id string"


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, n, num, den):
    sets = {i: shingles(t, n) for i, t, *_ in rows}
    links = {i: [j for j in sets if j != i and sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])] for i in sets}
    out = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(sets[i]), min(seen))
    return out


def run(spark, rows, n, num, den):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(frame(spark, rows, SCHEMA), n, num, den).collect()}


@pytest.mark.parametrize("n,num,den,seed", [(3, 9, 10, 0), (5, 4, 5, 1), (3, 9, 10, 2), (5, 4, 5, 3), (1, 1, 2, 4)])
def test_random_near_copies(spark, n, num, den, seed):
    rng = random.Random(seed)
    rows, bases = [], [[rng.choice("abcdefghijklmnopqrstuvw") * rng.randint(1, 3) for _ in range(rng.randint(1, 120))] for _ in range(12)]
    for i in range(260):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 2)] = [f"new{rng.randrange(50)}"] * rng.randint(0, 2)
            w = w or ["x"]
        rows.append((i, " ".join(x.upper() if rng.random() < 0.1 else x for x in w), "x"))
    assert run(spark, rows, n, num, den) == brute(rows, n, num, den)


def test_edges_of_the_threshold(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(words[:200]), None)]
    rows += [(k, " ".join(words[k : 200 + k]), None) for k in range(1, 30)]  # chains of shifted windows
    rows += [(100 + k, " ".join(words[: 200 - k]), None) for k in range(1, 45)]
    for n, num, den in ((3, 9, 10), (5, 4, 5)):
        assert run(spark, rows, n, num, den) == brute(rows, n, num, den)


def test_large_cluster_in_several_trees(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TREE_SETS", 16)
    monkeypatch.setattr(ngram_join, "PIVOTS", 2)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"n{i}"
        rows.append((i, " ".join(w), None))
    assert run(spark, rows, 3, 9, 10) == brute(rows, 3, 9, 10)


def test_odd_texts(spark):
    rows = [(1, None, None), (2, "", None), (3, " \n\t", None), (4, "One", None), (5, "one", None), (6, "one two", None), (7, "ONE  two", None), (8, "É x y", None), (9, "é x y", None), (10, "a b " * 40_000, None), (11, "b a " * 40_000, None), (12, "a\x00b c d", None)]
    got = run(spark, rows, 3, 9, 10)
    assert got == brute(rows, 3, 9, 10)
    assert got[1] == (0, 1) and got[5] == (1, 4) and got[7] == (1, 6) and got[9] == (1, 9)
    assert run(spark, [], 3, 9, 10) == {}
    assert run(spark, [(None, "a b c", None), (1, "a b c", None)], 3, 9, 10) == {None: (1, None), 1: (1, 1)}


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(200) if i % 40] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(5000, 5000 + k) for k in range(300)] + [(1, 1)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links + links, "a long, b long")).collect()}
    want = {i: root(i) for i in up}
    assert {i: c for i, c in got.items()} == {i: c for i, c in want.items() if i in got}
    assert {i for i in want if any(i in x and x[0] != x[1] for x in links)} <= set(got)


def test_query_matches_sql(spark):
    got, want = same_as_sql(spark, "op6_ngram_join")
    assert got == want


def test_sets_without_a_common_token_share_no_digest():
    rng = np.random.default_rng(6)
    bands = ngram_join.Bands(4, 5)
    seen = set()
    for size in (1, 4, 30, 150, 300, 300, 700, 2000, 2000, 5000):
        got = set(bands.digests(np.unique(rng.integers(1 << 63, size=size, dtype=np.uint64))).tolist())
        assert not got & seen
        seen |= got


@pytest.mark.parametrize("num,den", [(9, 10), (4, 5), (1, 2), (1, 10)])
def test_linked_sets_share_a_digest(num, den):
    rng = np.random.default_rng(7)
    bands = ngram_join.Bands(num, den)
    for _ in range(300):
        x = np.unique(rng.integers(1 << 63, size=int(2 ** rng.uniform(0, 11)), dtype=np.uint64))
        gone = int(rng.integers(0, len(x) * (den - num) // den + 1))
        shared = len(x) - gone
        new = rng.integers(1 << 63, size=shared * den // num - len(x), dtype=np.uint64)  # as many as the threshold lets
        y = np.unique(np.concatenate([x[gone:], new]))
        if den * shared >= num * (len(x) + len(y) - shared) and gone + len(new):
            assert np.isin(bands.digests(x), bands.digests(y)).any()


def test_large_cluster_by_chains_of_passages(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TREE_SETS", 8)
    monkeypatch.setattr(ngram_join, "PIVOTS", 1)
    met = []
    monkeypatch.setattr(ngram_join, "meetings", lambda *a, f=ngram_join.meetings: met.append(f(*a)) or met[-1])
    rng = random.Random(8)
    passages = [" ".join(f"p{k}x{i}" for i in range(12)) for k in range(6)]
    rows = []
    for i in range(150):
        own = [f"d{i}w{k}" for k in range(rng.randint(8, 14))]
        rows.append((2 * i, " ".join([rng.choice(passages), *own, rng.choice(passages)]), None))
        if i % 3 == 0:
            rows.append((2 * i + 1, " ".join([rows[-1][1], "end"]), None))
    assert run(spark, rows, 5, 4, 5) == brute(rows, 5, 4, 5)
    assert met and 0 < met[0].count() < 150 * 150 / 8
