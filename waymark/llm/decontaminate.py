"""Benchmark decontamination by the q-gram lemma.

A passage of m characters with k edits still has m - q + 1 - k q of its q-grams,
and they lie within k diagonals of each other. Shared q-grams are counted in
overlapping bands of diagonals; regions that reach the bound are verified by a
banded alignment. Short items, of which edits would leave too little, are looked for
as they are, on word bounds, by hashes of as many words as they have.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import mix, stored, window_hashes

Q = 12
#: Edits allowed, as a share of an item's characters.
EDITS = 0.06
#: Shorter items (in characters, normalised) must occur as they are, on word bounds.
LEAST_CHARS = 40
#: Characters of items in one index, at most: what is broadcast at once.
BLOCK_CHARS = 8 << 20
SLICE_CHARS = 1 << 20
BITS = 22

FOUND = "doc_id long, item_id long, edits int, start long, end long"


def normal(text: str | None) -> str:
    """Lower case, with single spaces between words."""
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def gram_hashes(text: np.ndarray) -> np.ndarray:
    at = np.arange(max(0, len(text) - Q + 1))
    return window_hashes(mix(text + np.uint64(1)), at, at + Q)


class Words:
    """Short items by their number of words, and for each number their hashes in order."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items: dict[int, dict[int, list[tuple[int, np.ndarray]]]] = {}
        for i, text in items:
            c = codes(text)
            key = int(window_hashes(mix(c + np.uint64(1)), np.array([0]), np.array([len(c)]))[0])
            self.items.setdefault(text.count(" ") + 1, {}).setdefault(key, []).append((i, c))
        self.hashes = {k: np.sort(np.array(list(v), np.uint64)) for k, v in self.items.items()}

    def found(self, text: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, start, end) of occurrences in order; bounds: where each text starts, one gap after the one before."""
        inner = (text != 0x20) & (text != 0)
        edges = np.diff(np.concatenate(([False], inner, [False])).astype(np.int8))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        of, values = np.searchsorted(bounds, starts, "right") - 1, mix(text + np.uint64(1))
        for k, hashes in self.hashes.items():
            a, b = starts[: max(0, len(starts) - k + 1)], ends[k - 1 :]
            same = of[: len(a)] == of[k - 1 :]
            a, b, d = a[same], b[same], of[: len(a)][same]
            h = window_hashes(values, a, b)
            hit = np.flatnonzero(hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h)
            for x in hit.tolist():
                for item, c in self.items[k][int(h[x])]:
                    if np.array_equal(text[a[x] : b[x]], c):
                        yield int(d[x]), item, int(a[x] - bounds[d[x]]), int(b[x] - bounds[d[x]])


class Index:
    """q-grams of a block of items: hashes, and for each the items and offsets that have it; short items apart."""

    def __init__(self, items: list[tuple[int, str]]):
        self.short = Words([(i, t) for i, t in items if len(t) < LEAST_CHARS])
        items = [(i, t) for i, t in items if len(t) >= LEAST_CHARS]
        self.ids = [i for i, _ in items]
        self.texts = [codes(t) for _, t in items]
        sizes = np.array([len(t) for t in self.texts], np.int64)
        # as many edits as leave a q-gram at least
        self.edits = np.minimum((EDITS * sizes).astype(np.int64), (sizes - Q) // Q)
        self.bound = sizes - Q + 1 - self.edits * Q
        grams = [gram_hashes(t) for t in self.texts]
        hashes = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(grams)), np.array([len(g) for g in grams], np.int64))
        offset = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)])
        order = np.argsort(hashes, kind="stable")
        self.item, self.offset = item[order], offset[order]
        self.hashes, first = np.unique(hashes[order], return_index=True)
        self.first = np.append(first, len(order))
        self.filter = np.zeros(1 << BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - BITS)] = True

    def regions(self, text: np.ndarray) -> set[tuple[int, int]]:
        """(item, band): bands of diagonals with enough shared q-grams; band b is of diagonals from b (k + 1) on."""
        if not self.ids:
            return set()
        h = gram_hashes(text)
        at = np.flatnonzero(self.filter[h >> np.uint64(64 - BITS)])
        k = np.searchsorted(self.hashes, h[at])
        k[k == len(self.hashes)] = 0
        real = self.hashes[k] == h[at]
        at, k = at[real], k[real]
        n = self.first[k + 1] - self.first[k]
        posting = np.repeat(self.first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, diagonal = self.item[posting], np.repeat(at, n) - self.offset[posting]
        band = diagonal // (self.edits[item] + 1)
        key = np.concatenate([item << 40 | band + (1 << 32), item << 40 | band - 1 + (1 << 32)])
        found, count = np.unique(key, return_counts=True)
        enough = count >= self.bound[found >> 40]
        return {(int(x >> 40), int(x & (1 << 40) - 1) - (1 << 32)) for x in found[enough]}


def align(pattern: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best fit of a pattern in a text on diagonals low to high; None above most edits."""
    low, high = low - most, high + most
    width = high - low + 1
    steps = np.arange(width)
    none = 1 << 20
    row, start = np.zeros(width, np.int64), low + steps
    row[(start < 0) | (start > len(text))] = none
    for i, c in enumerate(pattern):
        at = low + steps + i
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[at[inside]] == c
        step = np.where(inside, row + ~same, none)
        skip = np.append(row[1:], none) + 1  # the pattern's character is missing in the text
        from_skip = skip < step
        new, origin = np.where(from_skip, skip, step), np.where(from_skip, np.append(start[1:], 0), start)
        # characters that the text has more
        lead = new - steps
        best = np.minimum.accumulate(lead)
        source = np.maximum.accumulate(np.where(lead == best, steps, 0))
        new, start = best + steps, origin[source]
        new[(at + 1 < 0) | (at + 1 > len(text))] = none
        row = new
        if row.min() > most:
            return None
    t = int(row.argmin())
    return (int(row[t]), int(start[t]), low + t + len(pattern)) if row[t] <= most else None


def scan_block(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    """What one block of items has in docs, as a stored table; its index, of BLOCK_CHARS at most, is gone from all machines after that."""
    index = docs.sparkSession.sparkContext.broadcast(Index(items))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            out, first, held, size = [], 0, [], 0
            for i in range(len(ids)):
                held.append(normal(texts[i].as_py()))
                size += len(held[-1]) + Q
                if size >= SLICE_CHARS or i + 1 == len(ids):
                    out += scan_texts(index.value, ids[first : i + 1], held)
                    first, held, size = i + 1, [], 0
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "edits", "start", "end"])

    found = stored(docs.select("doc_id", "text").mapInArrow(scan, FOUND), "found")
    index.destroy()
    return found


def scan_texts(index: Index, ids: list, texts: list[str]) -> list[tuple]:
    """Best match of each item in each text that has one."""
    gap = "\x00" * Q
    whole = codes(gap.join([*texts, ""]))
    bounds = np.cumsum([0, *(len(t) + Q for t in texts)])
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for item, band in sorted(index.regions(whole)):
        most, pattern = int(index.edits[item]), index.texts[item]
        low = band * (most + 1)
        high = low + 2 * most + 1
        docs = range(int(np.searchsorted(bounds, max(0, low), "right")) - 1, int(np.searchsorted(bounds, high, "right")))
        for d in docs:
            if d >= len(texts) or best.get((d, item), (1,))[0] == 0:
                continue
            a = int(bounds[d])
            got = align(pattern, whole[a : int(bounds[d + 1]) - Q], low - a, high - a, most)
            if got and got < best.get((d, item), (most + 1, 0, 0)):
                best[d, item] = got
    short: dict[tuple[int, int], tuple[int, int]] = {}
    if index.short.items:
        for d, item, start, end in index.short.found(whole, bounds):
            short[d, item] = min((start, end), short.get((d, item), (start, end)))
    return [(ids[d], index.ids[item], *got) for (d, item), got in best.items()] + [(ids[d], item, 0, *got) for (d, item), got in short.items()]


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of BLOCK_CHARS characters at most, one partition at the driver at a time."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").where("item_id is not null").toLocalIterator():
        text = normal(row["text"])
        if not text:
            continue
        if held and size + len(text) > BLOCK_CHARS:
            yield held
            held, size = [], 0
        held.append((row["item_id"], text))
        size += len(text)
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, start, end: each benchmark item that a whole text holds, where it fits best.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Texts
    are compared in lower case with single spaces; start and end are characters of
    the text so normalised. An item fits with up to 6 % of its characters edited.
    One of fewer than 40 characters fits as it is only, between white space or at an
    end. Null and empty texts match nothing, on either side. Repeated rows
    give repeated rows; an empty table on either side gives an empty result. All
    documents are scanned against one bounded block of items after another, and one
    block's index is held at a time.
    """
    scans = [scan_block(docs, items) for items in item_blocks(benchmark)]
    if not scans:
        return docs.sparkSession.createDataFrame([], FOUND)
    return reduce(DataFrame.unionByName, scans)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark item; rows with a null doc_id stay."""
    return docs.join(contaminated(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti")
