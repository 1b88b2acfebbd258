import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cases import SF, frame, table
from waymark.llm import queries, spelling


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    out, form, held = [], {}, {}
    for w in counts:
        held.setdefault(len(w), []).append(w)
    for w, n in counts.items():
        near = [x for k in (-1, 0, 1) for x in held.get(len(w) + k, []) if is_near(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * n else None
        out.append((w, form[w], n, len(near), counts[best] if form[w] else None))
    rows = []
    for w, f, n, near, form_n in out:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, f, root, n, near, form_n))
    return sorted(rows)


def vocabulary(docs, damage=97):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_query_against_brute_force(spark):
    got = sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in queries.op11_spelling(spark, SF).collect())
    assert got == brute(vocabulary([r[:2] for r in table("documents")]))
    assert sum(r[1] is not None for r in got) > 20 and sum(r[1] is not None and r[2] != r[1] for r in got) > 0


def test_vocabulary(spark):
    texts = ["ÀÉÎõ÷×ÿß ABCDEF abcdef Abcdef", "İstanbul Kelvin naïveté naïveté NAÏVETÉ naÏvetÉ", None, "", "x" * 100_000, "abcdef1abcdef_abcdef-abcd", "straße " * 5]
    rows = [(i if i else None, t * 40 if t and len(t) < 99 else t, "w", 3) for i, t in enumerate(texts)] * 3
    for damage in (0, 3, 97):
        got = spelling.vocabulary(frame(spark, rows, "doc_id long, text string, word string, run int"), damage)
        assert {r.word: r.n for r in got.collect()} == vocabulary([r[:2] for r in rows], damage)


def words(seed, alphabet, count, most):
    rng = random.Random(seed)
    out = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, most))) for _ in range(count)}
    for w in list(out)[: count // 2]:
        i = rng.randrange(len(w) + 1)
        out.add(w[:i] + rng.choice(alphabet) + w[i:])
    return {w: int(rng.paretovariate(0.7)) for w in sorted(out)}


@pytest.mark.parametrize("alphabet,count,most,group", [("ab", 200, 7, 20_000), ("ab", 200, 9, 3), ("abcdé漢😀", 600, 6, 20_000), ("abcdefgh", 800, 12, 10)])
def test_random_words(spark, alphabet, count, most, group):
    counts = words(count + most, alphabet, count, most)
    rows = [(w, n, "x", "y") for w, n in counts.items()]
    df = spelling.variant_groups(frame(spark, rows, "word string, n long, form string, key string"), group)
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(tuple(r) for r in df.collect()) == brute(counts)


def test_odd_rows(spark):
    rows = [(None, 4), ("", 9), ("abcde", None), ("abcde", 2), ("abcde", 3), ("abcdf", 10), ("abcdg", 10), ("q" * 5000, 3), ("q" * 4999, 8)]
    got = sorted(tuple(r) for r in spelling.variant_groups(frame(spark, rows, "word string, n long")).collect())
    assert got == brute({"abcde": 5, "abcdf": 10, "abcdg": 10, "q" * 5000: 3, "q" * 4999: 8})
    assert spelling.variant_groups(frame(spark, [], "word string, n long")).collect() == []


def test_groups_have_a_bound(spark):
    """Words that share all but their end, and words that share all but their start, are dealt until groups are small."""
    counts = {f"prefixprefix{i:04d}prefixprefix": i + 1 for i in range(300)}
    rows = frame(spark, list(counts.items()), "word string, n long")
    held = Counter(r.key for r in spelling.placed(rows, 16).collect())
    # where the edit has one place left, two code points differ at most: a group is bounded by the alphabet's square
    assert max(held.values()) <= 10**2 and sum(n > 16 for n in held.values()) <= 20
    got = sorted(tuple(r) for r in spelling.variant_groups(rows, 16).collect())
    assert got == brute(counts)


def test_pairs_come_once():
    mids = ["a", "aa", "aab", "ab", "abb", "b", "ba", "bab"]
    flat = np.array([ord(c) for w in mids for c in w], np.int64)
    lengths = np.array([len(w) for w in mids])
    for size in (1, 2):
        use = [i for i, w in enumerate(mids) if len(w) in (size, size + 1)]
        starts = (np.cumsum(lengths) - lengths)[use]
        longer = lengths[use] == size + 1
        tries = spelling.levels(flat, starts, lengths[use], np.zeros(len(use), int), longer)
        x, y = spelling.near_pairs(tries, np.array([size]), np.array([True]))
        got = Counter(tuple(sorted((mids[use[i]], mids[use[j]]))) for i, j in zip(x, y))
        want = {tuple(sorted((mids[i], mids[j]))) for i in use for j in use if i < j and is_near(mids[i], mids[j]) and min(len(mids[i]), len(mids[j])) == size}
        assert set(got) == want and set(got.values()) <= {1}
