import random

import numpy as np
import pytest

from cases import SF, frame, table
from waymark.llm import decontaminate, queries

DOCS = "doc_id long, text string, item_id int"
ITEMS = "item_id long, text string, doc_id int"


def fit(pattern, text, most):
    """Fewest edits of a pattern anywhere in a text, by the whole table; None above most."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(pattern, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + np.array([c != t for t in text], int)) if text else np.zeros(0, int)
        out = [i]
        for x in new.tolist():
            out.append(min(x, out[-1] + 1))
        row = np.array(out)
    return int(row.min()) if row.min() <= most else None


def edited(rng, text, edits):
    t = list(text)
    for _ in range(edits):
        k, what = rng.randrange(len(t)), rng.randrange(3)
        if what == 0:
            t[k] = rng.choice("abcdefgh")
        elif what == 1:
            del t[k]
        else:
            t.insert(k, rng.choice("abcdefgh"))
    return "".join(t)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_same_as_whole_alignment(spark, seed):
    rng = random.Random(seed)
    items = [(k, words(rng, rng.randint(8, 30)), None) for k in range(12)]
    docs = []
    for d in range(60):
        text = words(rng, rng.randint(0, 60))
        if d % 3 == 0:
            item = rng.choice(items)[1]
            text += " " + edited(rng, item, rng.randint(0, max(1, len(item) // 12))) + " " + words(rng, 10)
        docs.append((d, text, None))
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.contaminated(frame(spark, docs, DOCS), frame(spark, items, ITEMS)).collect()}
    want = {}
    for d, text, _ in docs:
        for k, item, _ in items:
            p, t = decontaminate.normal(item), decontaminate.normal(text)
            if len(p) < decontaminate.LEAST_CHARS:
                continue
            most = min(int(decontaminate.EDITS * len(p)), (len(p) - decontaminate.Q) // decontaminate.Q)
            e = fit(p, t, most)
            if e is not None:
                want[d, k] = e
    assert got == want
    assert any(want.values())


def test_odd_rows(spark):
    item = "the quick brown fox jumps over the lazy dog while it rains in the valley"
    docs = [(1, None, 0), (2, "", 0), (3, item.upper().replace(" ", " \n "), 0), (None, item, 0), (4, item[:20], 0), (5, "x" * 3_000_000 + " " + item, 0), (6, item + " " + item, 0), (6, item, 0)]
    items = [(1, item, 0), (2, None, 0), (3, "", 0), (4, "too short", 0), (None, item, 0), (5, item, 0)]
    d, i = frame(spark, docs, DOCS), frame(spark, items, ITEMS)
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in decontaminate.contaminated(d, i).collect())
    assert got == sorted((x, k) for x in ("3", "None", "5", "6", "6") for k in (1, 5))
    kept = [r["doc_id"] for r in decontaminate.clean(d, i).collect()]
    assert sorted(map(str, kept)) == ["1", "2", "4", "None"]


def test_empty(spark):
    d, i = frame(spark, [(1, "a" * 60, 0)], DOCS), frame(spark, [(1, "b" * 60, 0)], ITEMS)
    assert decontaminate.contaminated(d.limit(0), i).count() == 0
    assert decontaminate.contaminated(d, i.limit(0)).count() == 0
    assert decontaminate.clean(d, i.limit(0)).count() == 1


def test_query_finds_planted_items(spark):
    items = {i: decontaminate.normal(t) for i, t in table("benchmark")}
    want = {(d[0], i) for d in table("documents") for i, t in items.items() if t in decontaminate.normal(d[1])}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op3_decontaminate(spark, SF).collect()}
    assert want and want <= got
    clean = {d[0] for d in table("documents") if not any(t[: len(t) // 2] in decontaminate.normal(d[1]) or t[len(t) // 2 :] in decontaminate.normal(d[1]) for t in items.values())}
    assert not clean & {d for d, _ in got}


def test_short_items_fit_as_they_are(spark):
    rng = random.Random(5)
    items = [(1, "yes", 0), (2, "a b", 0), (3, "What is it?", 0), (4, "twelve chars", 0), (5, "a line of thirty-nine characters, just .", 0), (6, "É", 0), (7, "a b", 0), (8, "x", 0)]
    docs = [(k, " ".join(rng.choice(["yes", "yesterday", "a", "b", "ab", "What", "is", "it?", "it?!", "twelve", "chars", "charset", "a line of thirty-nine characters, just .", "é"]) for _ in range(rng.randint(0, 12))), 0) for k in range(300)]
    docs += [(999, "so what is IT? yes", 0), (1000, "x", 0), (1001, "x\ny", 0), (1002, "xx", 0)]
    got = {(r["doc_id"], r["item_id"]): (r["edits"], r["start"], r["end"]) for r in decontaminate.contaminated(frame(spark, docs, DOCS), frame(spark, items, ITEMS)).collect()}
    want = {}
    for d, text, _ in docs:
        for i, item, _ in items:
            t, p = f" {decontaminate.normal(text)} ", decontaminate.normal(item)
            if f" {p} " in t:
                want[d, i] = (0, t.index(f" {p} "), t.index(f" {p} ") + len(p))
    assert got == want and {i for _, i in got} == set(range(1, 9))


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    """Items in many blocks, whose indexes come and go one by one, are found as they are in one."""
    items = [r[:2] for r in table("benchmark")][:40]
    docs = [(i, f"before it. {t} and after", 0) for i, (_, t) in enumerate(items)] + [(100, None, 0), (101, "nothing of the kind", 0)]
    found = lambda: sorted(tuple(r) for r in decontaminate.contaminated(frame(spark, docs, DOCS), frame(spark, [(*r, 0) for r in items], ITEMS)).collect())
    whole = found()
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 400)
    assert found() == whole
    assert {r[0] for r in whole} == {i for i, (_, t) in enumerate(items) if t}
