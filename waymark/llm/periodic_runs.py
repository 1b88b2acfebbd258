"""Periodic runs of words, found with a suffix automaton whose end-position sets are merged small to large.

A run is a stretch of words with a smallest period that no neighbour extends. Each
state of a text's suffix automaton stands for substrings that end at the same
positions; going up the suffix links, the smaller of two ordered position sets is
put into the larger one, and each new pair of neighbours whose distance doesn't
exceed the state's length is a square. Squares are extended to runs.

Automata are built only over the stretches of a text that can hold a run. Inside a
run of period q every three words were last seen at most q words earlier, for at
least three periods on end, so word triples that were seen, or seen too long ago
for the stretch that they stand in, bound those stretches. This leaves out no run.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import mix, slices, word_hashes

#: A run has so many words and so many periods, at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
RUNS = "array<struct<start:long,length:long,period:long>>"
_KIND = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_FAR = 1 << 62


def automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Of a suffix automaton: each state's suffix link and length, and the state of each prefix."""
    moves, link, length, prefixes, last = [{}], [-1], [0], [], 0
    for i, c in enumerate(word):
        new, p = len(moves), last
        moves.append({})
        link.append(0)
        length.append(i + 1)
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(moves[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        prefixes.append(new)
        last = new
    return link, length, prefixes


def squares(word: list[int], periods: int = LEAST_PERIODS) -> Iterator[tuple[int, int, int]]:
    """(first, last, distance): word[first] to word[last] repeat after distance words, at least ``periods`` times in all."""
    link, length, prefixes = automaton(word)
    ends: list[list[int] | None] = [None] * len(link)
    for i, s in enumerate(prefixes):
        ends[s] = [i]
    for s in sorted(range(1, len(link)), key=length.__getitem__, reverse=True):
        few, up = ends[s], link[s]
        ends[s] = None
        if up == 0:
            continue
        if ends[up] is None:
            ends[up] = few
            continue
        many = ends[up]
        if len(few) > len(many):
            few, many = many, few
        most = length[up]
        near = most // (periods - 1)
        for e in few:
            k = bisect(many, e)
            if k and e - many[k - 1] <= near:
                d = e - many[k - 1]
                yield e - d - most + 1, e, d
            if k < len(many) and many[k] - e <= near:
                d = many[k] - e
                yield e - most + 1, many[k], d
            many.insert(k, e)
        ends[up] = many


def stretches(hashes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
    """Where runs can lie: (from, to) in words, in order, apart from one another, none across the texts' bounds."""
    n = len(hashes)
    if n < LEAST_WORDS:
        return []
    text = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
    triple = np.zeros(n, bool)
    triple[: n - 2] = text[: n - 2] == text[2:]
    at = np.flatnonzero(triple)
    three = mix(hashes[at] + mix(hashes[at + 1] + mix(hashes[at + 2] + mix(text[at] + np.uint64(1)))))
    order = np.argsort(three, kind="stable")
    again = np.flatnonzero(three[order][1:] == three[order][:-1])
    back = np.full(n, _FAR)
    back[at[order[again + 1]]] = at[order[again + 1]] - at[order[again]]
    at = np.flatnonzero(back < _FAR)
    while True:
        first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        long = np.diff(first, append=len(at))
        far = np.repeat((long + 2) // (LEAST_PERIODS - 1), long)
        kept = (back[at] <= far) & (np.repeat(long, long) >= LEAST_WORDS - 3)
        if kept.all():
            break
        at = at[kept]
    out: list[tuple[int, int]] = []
    own = bounds[np.searchsorted(bounds, at[first], "right") - 1] if len(at) else at
    for a, b, least in zip((at[first] - (long + 2) // (LEAST_PERIODS - 1)).tolist(), (at[first] + long + 2).tolist(), own.tolist()):
        a = max(a, least)
        if out and a < out[-1][1] and out[-1][0] >= least:
            out[-1] = (min(a, out[-1][0]), max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def smallest(word: list[int], start: int, length: int, period: int) -> bool:
    """Whether no smaller period holds for word[start:start + length], which has four of this one: then it isn't a multiple."""
    for parts in range(2, period + 1):
        if period % parts == 0 and all(parts % k for k in range(2, int(parts**0.5) + 1)):
            shorter = period // parts
            if word[start : start + length - shorter] == word[start + shorter : start + length]:
                return False
    return True


def runs_of(words: list, places: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text, by start, then period; places: where they can lie."""
    numbers: dict = {}
    word = [numbers.setdefault(w, len(numbers)) for w in words]
    found: dict[tuple[int, int], int] = {}
    for a, b in places:
        for first, last, d in squares(word[a:b]):
            first, last = first + a, last + a
            while first and word[first - 1] == word[first - 1 + d]:
                first -= 1
            if (first, d) not in found:
                last += 1
                while last < len(word) and word[last] == word[last - d]:
                    last += 1
                found[first, d] = last - first
    return sorted(((s, n, d) for (s, d), n in found.items() if n >= max(LEAST_WORDS, LEAST_PERIODS * d) and smallest(word, s, n, d)), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if runs:
        kept = np.ones(len(words), bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(kept).tolist()]
    return b" ".join(words)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs, collapsed: one row per row of docs.

    Words are runs of anything but ASCII white space, numbered from 0, and equal if
    their bytes are. A run has a smallest period q and at least max(6, 4 q) words,
    and no neighbouring word keeps the period. runs is an array of (start, length,
    period) by start, then period; collapsed is the text of the words that no run
    holds after its first q words, joined by one space.

    A null text counts as empty: no runs, and an empty collapsed text. Rows are
    judged one by one, so repeated rows and null ids are rows like others, and
    other columns are left out whatever their names. An empty table gives an empty
    result. Texts are taken whole, however long; a task holds one text's words at a
    time, beside slices of some MB of short ones.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                hashes, bounds = word_hashes(texts, fold=False)
                places: dict[int, list[tuple[int, int]]] = {}
                for a, b in stretches(hashes, bounds):
                    i = int(np.searchsorted(bounds, a, "right")) - 1
                    places.setdefault(i, []).append((a - int(bounds[i]), b - int(bounds[i])))
                runs, short = [], []
                for i, text in enumerate(texts):
                    words = text.split()
                    runs.append(runs_of(words, places[i]) if i in places else [])
                    short.append(collapsed(words, runs[-1]))
                named = [[{"start": s, "length": n, "period": d} for s, n, d in r] for r in runs]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(named, _KIND), pa.array(short, pa.binary())], ["id", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(id_col, text_col).mapInArrow(find, f"id {kind}, runs {RUNS}, collapsed binary")
    return found.select(F.col("id").alias(id_col), "runs", F.col("collapsed").cast("string").alias("collapsed"))


def longest(runs: Column) -> Column:
    """The run of greatest length, of those the one that starts first, of those the one of the smallest period."""
    key = F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    best = F.array_max(key)
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))
