"""N-gram Jaccard join with signature trees.

Documents are sets of hashed word shingles. Two sets with a Jaccard similarity of
t or more differ in so few shingles that, split by hash into blocks of which more
than that aren't empty, some block that isn't is the same in both. So sets meet in
groups of those that share a block's digest, and signature trees find the links in
the groups: a tree's nodes hold OR-combined token bitmaps and size ranges, and a
traversal of pairs of nodes prunes those whose largest possible overlap is too
small, or that hold sets of one component only.

1. Of groups with the same members one is kept.
2. Each set goes, with its tokens, to the tree of its largest group, where what the
   tree leaves is compared exactly. That connects most copies.
3. In groups whose sets aren't connected yet, one set of each component meets the
   others in a tree of bitmaps alone; tokens of those that it leaves are compared.
4. The same with all sets, in the groups that are left.

No link between different sets is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import discard, likely, mix, slices, stored, word_hashes
from waymark.llm.components import components

#: Sizes in one band differ by this factor at most; a band has one number of blocks.
BAND = 1.5
#: Blocks beyond those that may differ, at least; bands whose sets leave more of them empty have more.
SPARE = 2
#: Sets in one tree, at most; groups that are larger are dealt out to several.
TREE_SETS = 256
#: Sets that each of a large group's trees gets a copy of, about.
PIVOTS = 8
#: Rows that one call of a task gets, about.
LOT = 512
LEAST_BITS, MOST_BITS = 256, 1 << 16
FANOUT = 8

def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted set of hashed n-word shingles of each text; all words as one where there are fewer."""
    words, at = word_hashes(texts)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        w, size = words[a:b], min(n, b - a)
        if not size:
            out.append(np.zeros(0, np.uint64))
            continue
        h = w[: len(w) - size + 1]
        for k in range(1, size):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - size + 1 + k])
        out.append(np.unique(mix(h + np.uint64(size))))
    return out


class Bands:
    """Size bands, and for each the number of blocks its sets are split into."""

    def __init__(self, num: int, den: int):
        self.t = Fraction(num, den)
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * BAND)))
        self.differ = (1 - self.t) / (1 + self.t)
        self.counts: dict[int, int] = {}

    def blocks(self, band: int) -> int:
        """More than the tokens that may differ, by the empty blocks that the band's largest sets leave and some more; 0: there is no such number."""
        largest = self.edges[band + 1] - 1
        differ, spare = int(self.differ * 2 * largest), SPARE
        while differ + 1 + spare <= largest:
            empty = (differ + 1 + spare) * exp(-largest / (differ + 1 + spare))
            if empty + 4 * sqrt(empty) <= spare:
                return differ + 1 + spare
            spare += 1 + spare // 16
        return 0

    def of(self, size: int) -> list[tuple[int, int, int]]:
        """(band, blocks, tokens that may differ) of each band in which a set of this size meets its partners."""
        i = k = int(np.searchsorted(self.edges, size, "right")) - 1
        out = []
        while k == i or size >= self.t * self.edges[k]:  # partners meet in the band of the larger one
            partner = min(self.edges[k + 1] - 1, int(size / self.t))
            if differ := int(self.differ * (size + partner)):  # else partners are the same set
                if k not in self.counts:
                    self.counts[k] = self.blocks(k)
                out.append((k, self.counts[k], differ))
            k += 1
        return out

    def digests(self, tokens: np.ndarray) -> np.ndarray:
        """Digests of the blocks that aren't empty, so that two sets with a common one have tokens in common.

        Of two linked sets, one with more such blocks than tokens that may differ has
        one without such a token, and the other has the same. A set with fewer also
        has a digest for each token; two of these have a token in common.
        """
        out = []
        mixed = mix(tokens + np.uint64(0xA0761D6478BD642F))
        for band, blocks, differ in self.of(len(tokens)):
            used = np.zeros(0, np.int64)
            if blocks:
                block = (tokens % np.uint64(blocks)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                starts = np.flatnonzero(np.diff(block[order], prepend=-1))
                used = block[order][starts]
                sums = np.add.reduceat(mixed[order], starts)
                out.append(mix(sums + used.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB) + np.uint64(band + 1)))
            if len(used) <= differ:
                out.append(mix((mixed ^ np.uint64(0x8EBC6AF09C88C6E3)) + np.uint64(band + 1)))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def set_digests(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, size, h1, h2 (a 128-bit digest of the set), digests (of its blocks)."""
    bands = Bands(num, den)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                sets = shingle_sets(texts, n)
                h1 = [int(np.add.reduce(s).view(np.int64)) for s in sets]
                h2 = [int(np.add.reduce(mix(s + np.uint64(0x8EBC6AF09C88C6E3))).view(np.int64)) for s in sets]
                ds = [bands.digests(s) for s in sets]
                flat = np.concatenate([*ds, np.zeros(0, np.uint64)]).view(np.int64)
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, ds)]).astype(np.int32), pa.array(flat))
                ids = batch.column(0).slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), lists], ["doc_id", "size", "h1", "h2", "digests"])

    return docs.select("doc_id", "text").mapInArrow(digest, "doc_id long, size long, h1 long, h2 long, digests array<long>")


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[max(i, j)] = min(i, j)


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return bool(shared) and den * shared >= num * (len(x) + len(y) - shared)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """A set's bitmap in 64-bit words: two to four bits a token, from LEAST_BITS to MOST_BITS in all."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(tokens) - 1).bit_length()))
    out = np.zeros(bits, bool)
    out[(tokens >> np.uint64(20)) & np.uint64(bits - 1)] = True
    return np.packbits(out).view(np.uint64)


def folded(maps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps of one width: wider ones are OR-combined down to the narrowest."""
    words = min(map(len, maps))
    return np.stack([np.bitwise_or.reduce(m.reshape(-1, words), axis=0) for m in maps])


class SignatureTree:
    """Levels of nodes over sets, leaves first; each node: OR of bitmaps, size range, excess, components.

    A set's excess is its size less its bits: tokens that share a bit with another.
    Two sets share at most as many tokens as bits, and the smaller excess more.
    Sets of one component (known) needn't meet, nor nodes that hold only such sets.
    """

    def __init__(self, maps: list[np.ndarray], sizes: list[int], lows: list[int], known: list[int]):
        self.order = sorted(range(len(sizes)), key=lambda i: (lows[i], sizes[i]))
        size, of = np.array(sizes)[self.order], np.array(known)[self.order]
        packed = folded([maps[i] for i in self.order])
        self.levels = [(packed, size, size, size - np.bitwise_count(packed).sum(axis=1).astype(np.int64), of, of)]
        while len(self.levels[-1][0]) > 1:
            ors, lo, hi, excess, first, last = self.levels[-1]
            at = np.arange(0, len(ors), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(ors, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(excess, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))

    def leaf_pairs(self, num: int, den: int) -> Iterator[tuple[int, int]]:
        """Pairs of sets (numbers, i before j in the tree) that no bound rules out, by a dual traversal from the root."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, i, j = stack.pop()
            ors, lo, hi, excess, first, last = self.levels[level]
            fits = (den * hi[i] >= num * lo[j]) & (den * hi[j] >= num * lo[i]) & ~((first[i] == last[j]) & (last[i] == first[j]) & (first[i] == last[i]))
            i, j = i[fits], j[fits]
            bits = np.bitwise_count(ors[i] & ors[j]).sum(axis=1).astype(np.int64)
            most = np.minimum(bits + np.minimum(excess[i], excess[j]), np.minimum(hi[i], hi[j]))
            # overlap o makes Jaccard o / (x + y - o); x and y are at least the lower ends, and at least o
            fits = (den + num) * most >= num * (np.maximum(lo[i], 1) + np.maximum(lo[j], 1))
            i, j = i[fits], j[fits]
            if not level:
                for a, b in zip(i.tolist(), j.tolist()):
                    if a != b:
                        yield self.order[a], self.order[b]
                continue
            below = len(self.levels[level - 1][0])
            k = np.arange(FANOUT)
            ci = (i[:, None, None] * FANOUT + k[None, :, None] + 0 * k[None, None, :]).ravel()
            cj = (j[:, None, None] * FANOUT + k[None, None, :] + 0 * k[None, :, None]).ravel()
            ok = (ci < below) & (cj < below) & (ci <= cj)
            ci, cj = ci[ok], cj[ok]
            for part in range(0, len(ci), 4096):
                stack.append((level - 1, ci[part : part + 4096], cj[part : part + 4096]))


def grouped(maps: list[np.ndarray], sizes: list[int], lows: list[int], known: list[int], num: int, den: int, check: Callable[[int, int], bool]) -> list[int]:
    """For each of a tree's sets the first set that it is connected with, by known components and by pairs that pass the tree and then check."""
    forest, first = Forest(len(sizes)), {}
    for i, k in enumerate(known):
        forest.join(forest.root(first.setdefault(k, i)), forest.root(i))
    pairs = SignatureTree(maps, sizes, lows, known).leaf_pairs(num, den) if len(sizes) > 2 else [(0, 1)] if len(sizes) == 2 and known[0] != known[1] else []
    for i, j in pairs:
        a, b = forest.root(i), forest.root(j)
        if a != b and check(i, j):
            forest.join(a, b)
    return [forest.root(i) for i in range(len(sizes))]


TOKENS = "rep long, tokens binary"
SIGNATURE = "rep long, size int, low long, bits binary"


def token_row(tokens: np.ndarray) -> list:
    return [tokens.tobytes()]


def signature_row(tokens: np.ndarray) -> list:
    return [len(tokens), int(tokens[0].view(np.int64)), bitmap(tokens).tobytes()]


def made_again(docs: DataFrame, ids: DataFrame, n: int, row: Callable[[np.ndarray], list], schema: str) -> DataFrame:
    """A row for the set of each document whose id may be among ids (rep), and few others: made from the texts once more."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                at, rows = [], []
                for k, tokens in enumerate(shingle_sets(texts, n)):
                    if len(tokens):
                        at.append(first + k)
                        rows.append(row(tokens))
                columns = list(zip(*rows)) or [[]] * (len(names) - 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), t) for c, t in zip(columns, types[1:]))], names)

    return likely(docs.select("doc_id", "text"), "doc_id", ids, "rep").mapInArrow(make, schema)


def in_lots(rows: DataFrame, sets: DataFrame, keys: list[str], link: Callable[[pa.Table], list[tuple]], out: str) -> DataFrame:
    """link of each group of rows with equal keys and their sets (rep, ...); groups are dealt out to lots of about LOT rows, each of which is one call."""
    lots = max(1, ceil(rows.count() / LOT))
    names = [x.split()[0] for x in out.split(", ")]

    def each(lot: pa.Table) -> pa.Table:
        lot = lot.sort_by([(k, "ascending") for k in keys])
        key = np.stack([lot.column(k).to_numpy() for k in keys])
        starts = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0))))
        got = [row for a, b in zip(starts.tolist(), [*starts[1:].tolist(), lot.num_rows]) for row in link(lot.slice(a, b - a))]
        columns = list(zip(*got)) or [[]] * len(names)
        return pa.table({name: pa.array(list(c), pa.int64()) for name, c in zip(names, columns)})

    return rows.join(sets, "rep").groupBy(F.pmod(F.xxhash64(*keys), F.lit(lots)).alias("lot")).applyInArrow(lambda _, lot: each(lot), out)


def exact_links(rows: DataFrame, keys: list[str], sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) in each group of rows (keys, rep, known): a set and the first set that links in its group connect it with."""

    def link(group: pa.Table) -> list[tuple]:
        ids, known = group.column("rep").to_pylist(), group.column("known").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in group.column("tokens").to_pylist()]
        lows = [int(s[0]) for s in sets]
        roots = grouped([bitmap(s) for s in sets], [len(s) for s in sets], lows, known, num, den, lambda i, j: similar(sets[i], sets[j], num, den))
        return [(ids[i], ids[r]) for i, r in enumerate(roots) if ids[i] != ids[r]]

    return in_lots(rows, sets, keys, link, "a long, b long")


def members_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of groups of rows (keys, rep) with the same members, one: keys and g, the number of members, two at least."""
    part = lambda salt: F.sum(F.shiftright(F.xxhash64("rep", F.lit(salt)), 20))
    groups = rows.groupBy(*keys).agg(F.count("*").alias("g"), part(0).alias("x"), part(1).alias("y")).where("g > 1")
    return groups.groupBy("g", "x", "y").agg(F.min(F.struct(*keys)).alias("key")).select("key.*", "g")


def picked(members: DataFrame) -> DataFrame:
    """(digest, tree, rep): each set once, in the largest of its groups, dealt out to trees of TREE_SETS; PIVOTS of its sets are in all of a group's trees."""
    best = members.groupBy("rep").agg(F.max(F.struct("g", "digest")).alias("best")).select("rep", "best.digest")
    best = best.join(best.groupBy("digest").agg(F.count("*").alias("m")), "digest").where("m > 1")
    h, trees = F.pmod(F.xxhash64("rep"), F.lit(1 << 40)), F.ceil(F.col("m") / TREE_SETS).cast("int")
    tree = F.when(trees == 1, F.array(F.lit(0))).when(F.pmod(h, F.col("m")) < PIVOTS, F.sequence(F.lit(0), trees - 1)).otherwise(F.array(F.pmod(F.shiftright(h, 20), trees).cast("int")))
    return best.select("digest", F.explode(tree).alias("tree"), "rep", F.col("rep").alias("known"))


def meetings(members: DataFrame, found: DataFrame, every: bool) -> DataFrame:
    """(digest, i, j, rep, known): the groups that aren't in one component, dealt out to trees.

    found: (id, component). Of each component in a group one set meets those of the
    others, or every one does. A group of more than TREE_SETS is dealt out to several,
    and pairs of these meet. Sets of the component that most of the group is in
    needn't meet each other, so their trees meet those of the other sets only.
    """
    rows = members.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("digest", "rep", F.coalesce("component", "rep").alias("known"))
    if not every:
        rows = rows.groupBy("digest", "known").agg(F.min("rep").alias("rep"))
        rows = stored(rows.join(members_of(rows, ["digest"]).drop("g"), "digest"), "delegates")
    parts = rows.groupBy("digest", "known").agg(F.count("*").alias("n"))
    groups = parts.groupBy("digest").agg(F.sum("n").alias("g"), F.max(F.struct("n", "known")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    open_ = rows.join(groups.select("digest", "g", "main"), "digest")
    minor, main = (F.greatest(F.lit(1), F.ceil(x / TREE_SETS)).cast("int") for x in (F.col("g") - F.col("main.n"), F.col("main.n")))
    spot = lambda trees: F.pmod(F.shiftright(F.pmod(F.xxhash64("rep"), F.lit(1 << 40)), 20), trees).cast("int")
    is_main = F.col("known") == F.col("main.known")
    small = F.col("g") <= TREE_SETS
    own = F.when(small, 0).when(is_main, minor + spot(main)).otherwise(spot(minor))
    others = F.when(small, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), minor - 1 + F.when(is_main, 0).otherwise(main)))
    met = open_.select("digest", "rep", "known", own.alias("own"), F.explode(others).alias("other"))
    return met.select("digest", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "known")


def survivors(rows: DataFrame, signatures: DataFrame, num: int, den: int) -> DataFrame:
    """(digest, i, j, sub, rep): in each tree the sets of pairs that its bounds leave; a sub's sets are connected by these."""

    def keep(group: pa.Table) -> list[tuple]:
        ids, known, sizes = (group.column(c).to_pylist() for c in ("rep", "known", "size"))
        maps = [np.frombuffer(x, np.uint64) for x in group.column("bits").to_pylist()]
        tree = SignatureTree(maps, sizes, group.column("low").to_pylist(), known)
        forest, met = Forest(len(ids)), set()
        for a, b in tree.leaf_pairs(num, den):
            met |= {a, b}
            a, b = forest.root(a), forest.root(b)
            if a != b:
                forest.join(a, b)
        key = [group.column(c)[0].as_py() for c in ("digest", "i", "j")]
        return [(*key, forest.root(k), ids[k], known[k]) for k in met]

    return in_lots(rows, signatures, ["digest", "i", "j"], keep, "digest long, i long, j long, sub long, rep long, known long")


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of docs.

    docs: doc_id long (unique), text string; other columns are ignored. A document's
    set holds its distinct n-word shingles, A-Z lower-cased, or all its words as one
    if it has fewer. Documents link where den * |intersection| >= num * |union|, and
    component_id is the smallest doc_id that links reach. Documents without words
    have n_shingles 0 and link with nothing; those with a null doc_id have their set's
    size, a null component_id and link with nothing. Equal sets are one set with the
    smallest id. Rows that repeat a doc_id are one document with several sets.
    Shingles are compared by 64-bit hashes.
    """
    all_sets = stored(set_digests(docs, n, num, den), "sets")
    same = ["size", "h1", "h2"]
    firsts = stored(all_sets.where("size > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("rep")), "set-reps")
    reps = firsts.select("rep").distinct()
    rows = likely(all_sets.where("size(digests) > 0").select(F.col("doc_id").alias("rep"), "digests"), "rep", reps, "rep").select("rep", F.explode("digests").alias("digest"))
    shared = stored(rows.groupBy("digest").agg(F.count("*").alias("g")).where("g > 1").select("digest"), "shared-blocks")
    members = stored(likely(rows, "digest", shared, "digest").join(reps, "rep", "left_semi").distinct(), "block-members")
    members = stored(members.join(members_of(members, ["digest"]), "digest"), "groups")
    sets = stored(all_sets.select("doc_id", *same), "sets")
    discard(all_sets)
    large = stored(picked(members), "picked")
    links = stored(exact_links(large, ["digest", "tree"], made_again(docs, large, n, token_row, TOKENS), num, den), "tree-links")
    found = components(links)
    keys = ["digest", "i", "j", "sub"]
    for every in (False, True):
        met = stored(meetings(members, found, every), "meetings")
        left = stored(survivors(met, made_again(docs, met, n, signature_row, SIGNATURE), num, den), "survivors")
        discard(met)
        left = stored(left.join(members_of(left, keys).drop("g"), keys), "candidates")
        more = stored(exact_links(left, keys, made_again(docs, left, n, token_row, TOKENS), num, den), "tree-links")
        links = links.unionByName(more)
        found = components(links)
    reach = firsts.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select(*same, F.coalesce("component", "rep").alias("component_id"))
    out = sets.join(reach, same, "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), own.alias("component_id"))
