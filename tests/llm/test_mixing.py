import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cases import SF, frame, same_as_sql
from waymark.llm import mixing, queries

SCHEMA = "doc_id long, source string, size long, u string"


def targets(sizes, share=1.5, most=2):
    """Weights dealt out again and again until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        out = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if out[s] >= most * sizes[s]]
        if not over:
            return out | capped
        capped |= {s: most * sizes[s] for s in over}
        if len(capped) == len(order):
            return capped


def run(spark, rows):
    return mixing.mix_sources(frame(spark, rows, SCHEMA)).collect()


def check(rows, got):
    sizes, most = defaultdict(int), defaultdict(int)
    for _, s, n, _ in rows:
        sizes[s] += n or 0
        most[s] = max(most[s], n or 0)
    want = targets(sizes)
    taken = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6, s


@pytest.mark.parametrize("seed", range(4))
def test_random_sources(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "a", "b", "Z", "é", "\U0001f600", "zz"][: rng.randint(1, 8)]
    rows = [(i, rng.choice(names + names[:1] * 5), rng.choice([0, 1, 5, 50, 400]), None) for i in range(900)]
    check(rows, run(spark, rows))


def test_many_cuts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PER_CUT", 32)
    rows = [(i, "hot" if i % 3 else "cold", 1 + i % 90, None) for i in range(3000)]
    check(rows, run(spark, rows))


def test_odd_rows(spark):
    assert run(spark, []) == []
    rows = [(1, "a", 5, None), (1, "a", 5, None), (None, "a", 7, None), (2, "b", None, None), (3, "c", 0, None), (4, None, 9, None)]
    check(rows, run(spark, rows))


def test_inclusion_follows_the_weights(spark):
    rows = [(i, "ab"[i % 2], 10, None) for i in range(6000)] + [(10_000 + i, "c", 10, None) for i in range(30_000)]
    got = run(spark, rows)
    mean = {s: sum(r["copies"] for r in got if r["source"] == s) / sum(1 for r in got if r["source"] == s) for s in "abc"}
    want = targets({"a": 30_000, "b": 30_000, "c": 300_000})
    assert mean["a"] == pytest.approx(want["a"] / 30_000, abs=0.01) and mean["c"] == pytest.approx(want["c"] / 300_000, abs=0.01)


def test_query_matches_sql_and_itself(spark):
    got, want = same_as_sql(spark, "op8_mixing")
    near = lambda rows: [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows]
    assert near(got) == near(want)
    again = sorted(map(tuple, queries.op8_mixing(spark, SF).collect()))
    assert again == sorted(map(tuple, queries.op8_mixing(spark, SF).collect()))


def test_inclusion_is_in_proportion_to_size(spark):
    rows = [(i, "ab"[i % 3 == 0], (10, 20, 40, 5000)[i % 4 if i % 97 else 3], None) for i in range(24_000)]
    rows = [r if r[2] < 5000 or r[0] % 97 == 0 else (r[0], r[1], 80, None) for r in rows]
    got = run(spark, rows)
    sizes = {s: sum(r[2] for r in rows if r[1] == s) for s in "ab"}
    want = targets(sizes)
    for s in "ab":
        rate = want[s] / sizes[s]
        more = {}
        for r in got:
            if r["source"] == s:
                more.setdefault(r["size"], []).append(r["copies"] - int(rate))
        need, low, high = want[s] - int(rate) * sizes[s], 0.0, 1.0
        for _ in range(100):  # the rate at which min(1, rate * size) makes up the words that are needed
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(1, mid * r[2]) * r[2] for r in rows if r[1] == s) < need else (low, mid)
        for n, x in more.items():
            assert sum(x) / len(x) == pytest.approx(min(1, low * n), abs=0.06 if n < 5000 else 0.12), (s, n)


def test_names_that_clash(spark):
    rows = [(i, "ab"[i % 2], 10 + i % 7) for i in range(200)]
    plain = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()}
    names = ["need", "whole", "p", "cuts", "weight", "n", "cap", "level", "u"]
    more = mixing.mix_sources(spark.createDataFrame([(*r, *range(9), 7.0, 8) for r in rows], f"doc_id long, source string, size long, {', '.join(f'{x} int' for x in names)}, target double, taken int"))
    assert {r["doc_id"]: r["taken"] for r in more.collect()} == plain and more.columns == ["doc_id", "source", "size", *names, "source_size", "target", "copies", "taken"]
    assert all([r[x] for x in names] == list(range(9)) and r["target"] > 8 for r in more.collect())


def test_very_many_sizes(spark):
    rows = spark.range(40_000).select(F.lit("s").alias("_s"), (F.col("id") + 1).alias("size"), F.lit(1).cast("long").alias("n"), F.lit(5e8).alias("need"))
    began = time.perf_counter()
    r = mixing.inclusion(rows).collect()[0]
    assert time.perf_counter() - began < 15
    # expected words make up what is needed, and no probability is above 1
    certain = range(r["_largest"] + 1, 40_001)
    assert sum(certain) + r["_rate"] * sum(k * k for k in range(1, r["_largest"] + 1)) == pytest.approx(5e8)
    assert r["_rate"] * r["_largest"] <= 1
