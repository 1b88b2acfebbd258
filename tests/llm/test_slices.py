"""Slices of texts keep a task's memory low, and every text whole and in its place."""

import tracemalloc

import pyarrow as pa

from waymark.llm import common
from waymark.llm.common import slices, word_hashes


def test_slices_hold_every_text_once():
    texts = [None if i % 7 == 0 else "w " * (i % 50 * 400) for i in range(2_000)]
    got = [x for first, part in slices(pa.array(texts)) for x in enumerate(part, first)]
    assert got == [(i, (t or "").encode()) for i, t in enumerate(texts)]


def test_hashing_a_batch_takes_little_memory():
    column = pa.array(["some words of a text " * 50] * 10_000)
    tracemalloc.start()
    for _, texts in slices(column):
        word_hashes(texts)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 100e6


def test_hashing_many_texts_at_once_takes_little_memory():
    texts = [b"some words of a text " * 50] * 5_000
    common._POWERS.clear()
    tracemalloc.start()
    hashes, bounds = word_hashes(texts)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 100e6 and len(hashes) == bounds[-1]


def test_hashes_are_the_same_however_texts_are_sliced(monkeypatch):
    texts = [b"", b"a b  A", b" c", b"", b"a" * 70 + b" b", b"\tb\n"]
    whole = word_hashes(texts)
    monkeypatch.setattr(common, "SLICE_BYTES", 3)
    hashes, bounds = word_hashes(texts)
    assert hashes.tolist() == whole[0].tolist() and bounds.tolist() == whole[1].tolist() == [0, 0, 3, 4, 4, 6, 7]
    assert word_hashes([])[1].tolist() == [0]
