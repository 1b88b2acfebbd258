import hashlib
import random
import zlib

import pytest

from cases import SF, frame, table
from waymark.llm import periodic_runs, queries


def brute(words):
    """All runs, by trying each period at each place."""
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                found.add((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def want(doc, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str("null" if doc is None else doc).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    kept = [True] * n
    for s, length, q in runs:
        kept[s + q : s + length] = [False] * (length - q)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    row = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *row, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(w for w, k in zip(words, kept) if k)))


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_against_brute_force(spark):
    got = sorted(tuple(r[n] for n in NAMES) for r in queries.op13_periodic_runs(spark, SF).collect())
    docs = [r[:2] for r in table("documents") if len((r[1] or "").split()) <= 2000]
    short = {d for d, _ in docs}
    assert [r for r in got if r[0] in short] == sorted(want(*r) for r in docs)
    assert sum(r[1] > 0 for r in got) > 5 and len(got) == len(table("documents"))


def texts():
    rng = random.Random(7)
    out = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "a b " * 4, "a b a b a b a", "A a A a A a A a", "é é é é é é", "x\x0by\x0cx y x\ry x y", "nul\x00 nul\x00 nul\x00 nul\x00 nul\x00 nul\x00", "a " * 3000, ("a a b " * 5 + "c ") * 6, "x y x y"]
    for _ in range(300):
        letters = "ab" if rng.random() < 0.5 else "abcd"
        parts = [" ".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 5))]
        out.append("  ".join((p + " ") * rng.randint(1, 7) for p in parts))
    return out


def test_random_texts(spark):
    rows = [(i if i % 5 else None, t, "x", [1]) for i, t in enumerate(texts())]
    df = periodic_runs.find_runs(frame(spark, rows, "doc_id long, text string, runs string, collapsed array<int>"))
    assert df.columns == ["doc_id", "runs", "collapsed"]
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in df.collect()]
    for (doc, text, *_), (have, runs, short) in zip(rows, got, strict=True):
        words = (text or "").encode().split()
        assert (have, runs) == (doc, brute(words))
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert short == " ".join(w.decode() for i, w in enumerate(words) if i not in dropped)


def test_stretches_keep_every_run():
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.choice("abc") for _ in range(rng.randint(1, 40))] + ["x", "y", "z", "u"] * rng.randint(0, 6) + [rng.choice("abcdef") for _ in range(20)]
        text = " ".join(words).encode()
        hashes, bounds = periodic_runs.word_hashes([b"a a a", text, b"", text], fold=False)
        places = periodic_runs.stretches(hashes, bounds)
        for s, n, _ in brute(words):
            for at in (bounds[1], bounds[3]):
                assert any(a <= at + s and at + s + n <= b for a, b in places)


@pytest.mark.parametrize("word", ["aaaaaaaa", "abababababab", "abcabcabcabcabcx", "aabaabaabaabaab"])
def test_automaton_has_all_substrings(word):
    link, length, prefixes = periodic_runs.automaton([ord(c) for c in word])
    substrings = {word[i:j] for i in range(len(word)) for j in range(i + 1, len(word) + 1)}
    assert sum(length[s] - length[link[s]] for s in range(1, len(link))) == len(substrings)
    assert [length[s] for s in prefixes] == list(range(1, len(word) + 1))


def test_long_text_and_empty_table(spark):
    rng = random.Random(1)
    block = [str(rng.randint(0, 9999)) for _ in range(20_000)]
    text = " ".join(["start", *block * 5, "end"])
    df = periodic_runs.find_runs(frame(spark, [(1, text), (1, text)], "doc_id long, text string"))
    for r in df.collect():
        assert [tuple(x) for x in r.runs] == [(1, 100_000, 20_000)]
        assert r.collapsed == " ".join(["start", *block, "end"])
    assert periodic_runs.find_runs(frame(spark, [], "doc_id long, text string")).collect() == []
