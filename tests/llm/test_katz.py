import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from cases import SF, frame, table
from waymark.llm import katz, queries

SCHEMA = "doc_id long, text string, score string"
BOS, EOS = "<bos>", "<eos>"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [EOS]


def ratios(counts):
    """Good and Turing's discounts by Katz, of counts up to K."""
    n = Counter(counts)
    common = (katz.K + 1) * n[katz.K + 1] / n[1] if n[1] else 1.0
    out = {}
    for r in range(1, katz.K + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class Brute:
    def __init__(self, rows):
        self.train = [t for i, t in rows if zlib.crc32(("null" if i is None else str(i)).encode()) % 10 != 0]
        self.c, self.pairs, self.as_history = Counter(), Counter(), Counter()
        for text in self.train:
            w = tokens(text)
            self.c.update(w)
            self.pairs.update(zip([BOS, *w], w))
            self.as_history.update([BOS, *w[:-1]])
        self.n, self.v = sum(self.c.values()), len(self.c)
        d = ratios(self.c.values())
        self.p1 = {w: d.get(c, 1) * c / self.n for w, c in self.c.items()}
        left = 1 - sum(self.p1.values())
        self.unknown = left if left > 1e-12 and self.n else 1.0
        self.d2 = ratios(self.pairs.values())
        kept = defaultdict(dict)
        for (h, w), c in self.pairs.items():
            kept[h][w] = self.d2.get(c, 1) * c
        self.kept = kept

    def p(self, h, w):
        own = self.p1.get(w, self.unknown)
        if not self.kept[h]:
            return own
        mass, total = sum(self.kept[h].values()), self.as_history[h]
        total += mass >= total - 1e-9
        if w in self.kept[h]:
            return self.kept[h][w] / total
        return (1 - mass / total) / (1 - sum(self.p1[x] for x in self.kept[h])) * own

    def row(self, i, text):
        w = tokens(text)
        base = sum(math.log10((self.c[x] + 0.1) / (self.n + 0.1 * (self.v + 1))) for x in w)
        score = sum(math.log10(self.p(h, x)) for h, x in zip([BOS, *w], w))
        return (i, zlib.crc32(("null" if i is None else str(i)).encode()) % 10 == 0, len(w), sum(self.c[x] > 0 for x in w), self.n, base, score)


def check(rows, got):
    b = Brute(rows)
    want = sorted((b.row(*r) for r in rows), key=repr)
    got = sorted(map(tuple, got), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9), g
    return b


def test_query(spark):
    rows = [r[:2] for r in table("documents")]
    b = check(rows, queries.op10_katz(spark, SF).collect())
    for h in [BOS, *list(b.kept)[:20]]:  # each history's probabilities, with one for all unseen words, add up to one
        assert sum(b.p(h, w) for w in b.c) + b.p(h, "never seen") == pytest.approx(1)


def test_chunks_dont_matter(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("aabbbcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    df = frame(spark, [(*r, None) for r in rows], SCHEMA)
    check(rows, katz.score_documents(df, chunk_bytes=500, bucket_bytes=900).collect())
    check(rows, katz.score_documents(df, chunk_bytes=1 << 30).collect())


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One one ONE"), (5, "É é"), (6, "a b " * 30_000), (7, "a b"), (7, "a b"), (None, "a b a"), (10, "new words only")]
    check(rows, katz.score_documents(frame(spark, [(*r, None) for r in rows], SCHEMA)).collect())
    assert katz.score_documents(frame(spark, [], SCHEMA)).count() == 0


def test_without_training_rows(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:5]
    rows = [(i, f"words of {i}") for i in held]
    got = katz.score_documents(frame(spark, [(*r, None) for r in rows], SCHEMA)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in got) and len(got) == 5


def test_model_beats_the_base(spark):
    rows = queries.op10_katz(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_pairs_seen_once_are_kept(spark):
    rows = [r[:2] for r in table("documents")]
    b = Brute(rows)
    assert sum(c == 1 for c in b.pairs.values()) == sum(1 for h in b.kept.values() for w in h.values() if w == b.d2[1])
    got = {r["doc_id"]: r["score"] for r in queries.op10_katz(spark, SF).collect()}
    assert got == pytest.approx({i: b.row(i, text)[-1] for i, text in rows}, rel=1e-9, abs=1e-9)


def test_frequent_words_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(katz, "FREQUENT", 20)
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(["the", "the", f"w{rng.randrange(400)}", rng.choice("abc")]) for _ in range(rng.randint(0, 80)))) for i in range(400)]
    check(rows, katz.score_documents(frame(spark, [(*r, None) for r in rows], SCHEMA), chunk_bytes=3000, bucket_bytes=4000).collect())


def test_unseen_word_after_a_history_that_all_words_follow(spark):
    train = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10][:40]
    held = next(i for i in range(200) if not zlib.crc32(str(i).encode()) % 10)
    rows = [(i, t) for i, t in zip(train, ["a a b b a", "b a a b b"] * 20)] + [(held, "a z")]
    got = {r["doc_id"]: r["score"] for r in katz.score_documents(frame(spark, [(*r, None) for r in rows], SCHEMA)).collect()}
    assert all(x <= 0 for x in got.values())
