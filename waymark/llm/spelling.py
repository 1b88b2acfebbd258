"""Spelling variant grouping by a self-join of vocabulary tries with active nodes.

Two words are near if one inserted, deleted or replaced code point parts them. The
place of that edit lies in the first or the second half of the shorter word, and
what stands outside of that half is the same in both. So words are dealt by what
stands outside, and each group holds a trie of what stands inside: a part of the
vocabulary's trie below a prefix where the second half may differ. Going down a
trie level by level, pairs of nodes at distance one are carried from parents to
children; pairs of terminal nodes are near words. A group of too many words is dealt
anew by halves of its half, down to single places, where the alphabet bounds it, so
no task holds a group that grows with the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import ascii_lower, discard, stored

#: Words have so many code points and occur so often, at least.
LEAST_LENGTH, LEAST_TIMES = 5, 3
#: Words of a group, at most, as long as its words' differing part can be halved.
GROUP = 20_000
#: Words whose tries a task builds at once, about.
AT_ONCE = 50_000
#: More than there are code points.
_POINTS = 0x110000
NEAR = "word string, n long, near long, form_n long, form string"


def vocabulary(docs: DataFrame, damage: int = 0) -> DataFrame:
    """(word, n): how often each word of LEAST_LENGTH code points occurs in all texts; words of LEAST_TIMES or more.

    docs: doc_id long, text string; other columns are ignored. A word is a maximal
    run of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased. With ``damage``, let h
    be the crc32 of <doc_id>:<run>; where damage divides h, the run loses its code
    point h % length before it is counted. A null doc_id counts as the text 'null',
    a null text has no words. Repeated rows count repeatedly.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    # lower() of these code points is right but for U+00C0 to U+00DE
    runs = runs.withColumn("run", F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(ascii_lower(F.col("run"))))
    word = F.col("run")
    if damage:
        runs = runs.withColumn("_h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("run")).cast("binary")))
        at = (F.col("_h") % F.length("run")).cast("int")
        word = F.when(F.col("_h") % damage == 0, F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(word)
    words = runs.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_TIMES)


def _halves(size: Column) -> Column:
    """Both halves of the places of a word of this length: where they begin and end."""
    middle = F.floor(size / 2).cast("int")
    return F.array(F.struct(F.lit(0).alias("a"), middle.alias("b")), F.struct(middle.alias("a"), size.alias("b")))


def placed(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(key, word, n, longer, a, b, last): each word once in each group that it belongs to.

    A group is for words of ``size`` code points and, marked longer, of one more,
    whose edit lies at the places a to b of the shorter one; key names it and what
    the words have in common.
    """
    size = F.length("word")
    both = F.array(F.struct(size.alias("size"), F.lit(False).alias("longer")), F.struct((size - 1).alias("size"), F.lit(True).alias("longer")))
    rows = words.select("word", "n", F.explode(both).alias("x")).select("word", "n", "x.*").where("size > 0")
    rows = rows.select("*", F.explode(_halves(F.col("size"))).alias("p")).select("word", "n", "size", "longer", "p.*").where("a < b")
    after = F.substring(F.col("word"), F.col("b") + F.col("longer").cast("int") + 1, F.length("word"))
    key = F.concat_ws(" ", "size", "a", "b", F.concat(F.substring(F.col("word"), F.lit(1), F.col("a")), after))
    older = None
    while True:
        rows = rows.withColumn("key", key)
        large = rows.where("b - a > 1").groupBy(F.xxhash64("key").alias("_k")).agg(F.count("*").alias("held")).where(F.col("held") > group).select("_k")
        if large.isEmpty():
            return rows.select("key", "word", "n", "longer", "a", "b", (F.col("b") == F.col("size")).alias("last"))
        known = stored(large, "large-groups")
        # a hash that two keys share only splits one more group
        small = rows.withColumn("_k", F.when(F.col("b") - F.col("a") > 1, F.xxhash64("key"))).join(known, "_k", "left_anti").drop("_k")
        split = rows.withColumn("_k", F.when(F.col("b") - F.col("a") > 1, F.xxhash64("key"))).join(known, "_k", "left_semi").drop("_k", "key")
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        split = split.withColumn("p", F.explode(F.array(F.struct("a", middle.alias("b")), F.struct(middle.alias("a"), "b")))).select("word", "n", "size", "longer", "p.*")
        rows = stored(small.drop("key").unionByName(split), "placed")
        if older is not None:
            discard(older)
        older = rows


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... first[i] + count[i] - 1, for all i one after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + count, count)


class Level:
    """The nodes of one depth of all tries: parent (in the level above), code point, whether shorter and longer words lie below."""

    def __init__(self, parent: np.ndarray, code: np.ndarray, shorter: np.ndarray, longer: np.ndarray, group: np.ndarray):
        self.parent, self.code, self.shorter, self.longer, self.group = parent, code, shorter, longer, group
        self.key = parent * _POINTS + code  # ascending
        self.word = np.full(len(parent), -1)  # of terminal nodes

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of nodes of the level above: first child and number of children."""
        first = np.searchsorted(self.parent, nodes)
        return first, np.searchsorted(self.parent, nodes, "right") - first

    def same(self, nodes: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The children of nodes (of the level above) by these code points, -1 where there is none."""
        key = nodes * _POINTS + code
        at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        return np.where(self.key[at] == key, at, -1) if len(self.key) else np.full(len(key), -1)


def levels(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, group: np.ndarray, longer: np.ndarray) -> list[Level]:
    """The tries of all groups, a level at a time; strings of a group ascend, as their words do."""
    count = int(group[-1]) + 1
    edge = np.flatnonzero(np.diff(group, prepend=-1))
    flag = lambda at, cut: np.logical_or.reduceat(at, cut)
    out = [Level(np.arange(count), np.zeros(count, np.int64), flag(~longer, edge), flag(longer, edge), np.arange(count))]
    node, alive, depth = group.copy(), np.arange(len(group)), 0
    while True:
        ends = lengths[alive] == depth
        out[-1].word[node[alive[ends]]] = alive[ends]
        alive = alive[~ends]
        if not len(alive):
            return out
        code = codes[starts[alive] + depth]
        key = node[alive] * _POINTS + code
        new = np.diff(key, prepend=-1) != 0
        cut = np.flatnonzero(new)
        out.append(Level(node[alive[cut]], code[cut], flag(~longer[alive], cut), flag(longer[alive], cut), group[alive[cut]]))
        node[alive] = np.cumsum(new) - 1
        depth += 1


def near_pairs(tries: list[Level], size: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y): indices of near words, each pair once, by the place of its edit that comes last.

    size: the places of each group's differing part; last: whether an edit may stand
    behind them. Active pairs are of nodes at distance one: of one depth where a code
    point is replaced, one level apart where the deeper one has one more.
    """
    none = np.zeros(0, np.int64)
    found, same, more = [(none, none)], (none, none), (none, none)
    nothing = Level(none, none, none.astype(bool), none.astype(bool), none)
    for depth, here in enumerate(tries):
        below = tries[depth + 1] if depth + 1 < len(tries) else nothing
        under = tries[depth + 2] if depth + 2 < len(tries) else nothing
        # a node and its children: the child has one code point more
        u = below.parent
        fresh = below.longer & here.shorter[u] & ((depth < size[here.group[u]]) | last[here.group[u]]) if len(u) else none.astype(bool)
        more = (np.concatenate([more[0], u[fresh]]), np.concatenate([more[1], np.flatnonzero(fresh)]))
        for (x, y), deeper in ((same, here), (more, below)):
            p, q = here.word[x], deeper.word[y]
            ends = (p >= 0) & (q >= 0)
            found.append((p[ends], q[ends]))
        # to the children by equal code points
        u, v = same
        first, n = below.children(u)
        x = _ranges(first, n)
        y = below.same(np.repeat(v, n), below.code[x])
        ok = (y >= 0) & below.shorter[x]
        ok[ok] = below.shorter[y[ok]]
        kept = (x[ok], y[ok])
        u, v = more
        first, n = below.children(u)
        x = _ranges(first, n)
        over = np.repeat(v, n)
        y = under.same(over, below.code[x])
        ok = (y >= 0) & below.shorter[x] & (over != x)  # x above y is a pair of its own
        ok[ok] = under.longer[y[ok]]
        more = (x[ok], y[ok])
        # siblings: one code point replaced
        c = np.flatnonzero(below.shorter)
        after = np.searchsorted(below.parent[c], below.parent[c], "right") - np.arange(len(c)) - 1
        same = (np.concatenate([kept[0], np.repeat(c, after)]), np.concatenate([kept[1], c[_ranges(np.arange(len(c)) + 1, after)]]))
    return tuple(np.concatenate(p) for p in zip(*found))


def _near(rows: pa.Table) -> pa.RecordBatch | None:
    """Of whole groups: each word's number of near words in its group, and the best of them."""
    keys = rows.column("key").combine_chunks()
    new = np.concatenate([[True], pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)])
    group = np.cumsum(new) - 1
    longer = rows.column("longer").to_numpy()
    some = np.bincount(group[~longer], minlength=group[-1] + 1)[group]
    several = (np.bincount(group)[group] > 1) & (some > 0)
    if not several.any():
        return None
    rows = rows.filter(pa.array(several))
    longer, n = longer[several], rows.column("n").to_numpy()
    a, b, last = (rows.column(c).to_numpy() for c in ("a", "b", "last"))
    group = np.unique(group[several], return_inverse=True)[1]
    edge = np.flatnonzero(np.diff(group, prepend=-1))
    words = rows.column("word").to_pylist()
    inside = [w[x : y + z] for w, x, y, z in zip(words, a.tolist(), b.tolist(), longer.tolist())]
    lengths = b - a + longer
    codes = np.frombuffer("".join(inside).encode("utf-32-le"), np.uint32).astype(np.int64)
    x, y = near_pairs(levels(codes, np.cumsum(lengths) - lengths, lengths, group, longer), (b - a)[edge], last[edge])
    x, y = np.concatenate([x, y]), np.concatenate([y, x])
    if not len(x):
        return None
    order = np.lexsort((y, -n[y], x))  # a group's words ascend, so the smaller index is the smaller word
    x, y = x[order], y[order]
    best = np.flatnonzero(np.diff(x, prepend=-1))
    near = np.diff(best, append=len(x))
    take = lambda at: pa.array([words[i] for i in at.tolist()], pa.string())
    return pa.RecordBatch.from_arrays([take(x[best]), pa.array(n[x[best]]), pa.array(near), pa.array(n[y[best]]), take(y[best])], ["word", "n", "near", "form_n", "form"])


def near_words(places: DataFrame) -> DataFrame:
    """(word, n, near, form_n, form): of each group that a word has near words in, their number and the best of them."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < AT_ONCE:
                continue
            rows = pa.Table.from_batches(held)
            keys = rows.column("key")
            # the last group may go on
            cut = pc.index(keys, keys[-1]).as_py()
            if cut and (out := _near(rows.slice(0, cut))):
                yield out
            held = rows.slice(cut).combine_chunks().to_batches()
        if held and sum(b.num_rows for b in held) and (out := _near(pa.Table.from_batches(held))):
            yield out

    return places.repartition("key").sortWithinPartitions("key", "word").mapInArrow(join, NEAR)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where a word's chain of forms ends. Chains halve with each round."""
    now = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = stored(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = moved
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def variant_groups(words: DataFrame, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word.

    words: word string, n long; other columns are ignored. A null word, one without
    code points, or a null n takes no part; of rows that repeat a word the n are
    added up. Two words are near if exactly one inserted, deleted or replaced code
    point parts them; n_near counts a word's near words. Its form is the near word
    of largest n (ties: the smallest by code points) if that n is at least twice its
    own, else null; its root is where forms lead to from it, itself if it has none.
    An empty table gives an empty result. Words of any length and alphabet are fine.
    """
    fine = words.where("word is not null and word != '' and n is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    known = stored(fine, "words")
    near = near_words(placed(known, group)).unionByName(known.selectExpr("word", "n", "0L as near", "null as form_n", "null as form"))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form")))
    each = near.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best.alias("best"))
    has = -F.col("best.less") >= 2 * F.col("n")
    each = each.select("word", F.when(has, F.col("best.form")).alias("form"), "n", "n_near", F.when(has, -F.col("best.less")).alias("form_n"))
    each = stored(each, "variants")
    ends = roots(each.where("form is not null"))
    return each.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
