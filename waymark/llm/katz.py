"""LM scoring: a bigram model with Katz backoff.

Counts are Good-Turing discounted and backoff weights normalise each history's
distribution exactly. Counts live in tables partitioned by word. Documents are
packed in chunks where they are read; a chunk asks for each of its words and word
pairs once, so a word that all documents share is asked for once per chunk, and gets
back the counts of the whole training corpus, with which each token is scored
recursively: by its pair's discounted frequency, or else by the history's backoff
weight times the word's own probability.

Words are dealt out to buckets, whose number grows with the corpus. Pairs go to their
word's bucket, but those of very frequent words are dealt out by history as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import discard, mix, part_of, slices, stored, word_hashes

#: Bytes of text in a chunk, about.
CHUNK_BYTES = 5 << 20
#: Bytes of text for each bucket of words, about.
BUCKET_BYTES = 8 << 20
#: Buckets are counted in so many rounds, so that what is shuffled at once is smaller.
ROUNDS = 3
#: A word is frequent if it is every so many-eth token of a chunk; one that is every 2 x so many-eth of all is dealt out.
FREQUENT = 1000
#: Counts up to this are discounted.
K = 5
#: Pairs in one row of the table that histories are summed up from.
SLAB = 1 << 16
START, END = mix(np.array([0x5354415254, 0x454E44], np.uint64)).tolist()

PACKED = "chunk long, ids array<long>, train array<boolean>, sizes array<int>, texts binary, bytes long, tokens long, often array<long>, often_n array<long>"
ASKED = "bucket int, away boolean, chunk long, words binary, n binary, n_large binary, np binary, np_large binary, hs binary, ns binary, ns_large binary"
ANSWER = "bucket int, away boolean, chunk long, words binary, c binary, c_large binary, cs binary, cs_large binary"
COUNTED = f"{ANSWER}, hot long, own array<long>, own_c array<int>, own_w array<long>, fact long, value long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def packed(docs: DataFrame, folds: int, held_out: int, chunk_bytes: int) -> DataFrame:
    """A row per chunk of documents that were read one after the other: ids, which ones train, texts, frequent words."""
    train = part_of(F.col("doc_id"), folds) != held_out

    def pack(ids: list, train: list, texts: list[bytes], number: int) -> pa.RecordBatch:
        words, _ = word_hashes(texts)
        w, n = np.unique(words, return_counts=True)
        tokens = len(words) + len(texts)
        often = n * FREQUENT >= tokens
        body = b"".join(texts)
        row = [number, ids, train, [len(t) for t in texts], pa.Codec("zstd").compress(body, asbytes=True), len(body), tokens, w[often].view(np.int64).tolist(), n[often].tolist()]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], [x.split()[0] for x in PACKED.split(", ")])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, trains, held, size = [], [], [], 0
        for batch in batches:
            trained, doc_ids = batch.column(2).to_pylist(), batch.column(0).to_pylist()
            for first, texts in slices(batch.column(1)):
                ids += doc_ids[first : first + len(texts)]
                trains += trained[first : first + len(texts)]
                held += texts
                size += sum(map(len, texts))
                if size >= chunk_bytes:
                    yield pack(ids, trains, held, number)
                    number, ids, trains, held, size = number + 1, [], [], [], 0
        if held:
            yield pack(ids, trains, held, number)

    return docs.select("doc_id", "text", train.alias("train")).mapInArrow(chunks, PACKED)


def bucket_of(words: np.ndarray, buckets: int) -> np.ndarray:
    return ((words >> np.uint64(20)) & np.uint64(0x7FFFFFFF)).astype(np.int64) % buckets


class Chunk:
    """The tokens of a chunk's documents: words, then one end each; histories; distinct pairs; and where they are asked for.

    A section is what is asked of one bucket: section 2 b of its own words and their
    pairs, section 2 b + 1 of pairs of frequent words that belong to other buckets.
    """

    def __init__(self, row: dict, buckets: int, hot: np.ndarray):
        body, texts, at = pa.Codec("zstd").decompress(row["texts"], row["bytes"], asbytes=True), [], 0
        for size in row["sizes"]:
            texts.append(body[at : at + size])
            at += size
        self.train = np.array(row["train"], bool)
        hashes, bounds = word_hashes(texts)
        self.lengths = np.diff(bounds) + 1
        ends = np.cumsum(self.lengths) - 1
        self.starts = ends - self.lengths + 1
        w = np.full(int(self.lengths.sum()), END, np.uint64)
        inner = np.ones(len(w), bool)
        inner[ends] = False
        w[inner] = hashes
        self.words, rank = np.unique(np.append(w, np.uint64(START)), return_inverse=True)
        start, rank = rank[-1], rank[:-1].astype(np.int64)
        h = np.append(start, rank[:-1])
        h[self.starts] = start
        weight = np.repeat(self.train, self.lengths)
        self.n = np.bincount(rank, weight, len(self.words)).astype(np.int64)
        self.n[start] = self.train.sum()
        key = rank << 32 | h
        del h, w, inner, hashes, texts, body  # a chunk's arrays are most of a worker's memory
        order = np.argsort(key)
        new = np.flatnonzero(np.diff(key[order], prepend=-1))
        self.pair = np.empty(len(key), np.int64)  # each token's pair
        self.pair[order] = np.repeat(np.arange(len(new)), np.diff(new, append=len(key)))
        pairs = key[order][new]
        self.pair_w, self.pair_h = pairs >> 32, pairs & 0xFFFFFFFF
        self.ns = np.bincount(self.pair, weight, len(pairs)).astype(np.int64)
        # sections
        home = bucket_of(self.words, buckets) * 2
        section = home[self.pair_w]
        split = np.isin(self.words, hot)[self.pair_w]
        if split.any():
            away = bucket_of(mix(self.words[self.pair_w[split]] + mix(self.words[self.pair_h[split]])), buckets) * 2
            section[split] = np.where(away == section[split], away, away + 1)
        by_word = section << 32 | self.pair_w
        self.order = np.argsort(by_word, kind="stable")
        by_word = by_word[self.order]
        self.entries = np.unique(np.concatenate([home << 32 | np.arange(len(self.words)), by_word]))
        self.entry_word, entry_section = self.entries & 0xFFFFFFFF, self.entries >> 32
        self.pairs_of = np.diff(np.searchsorted(by_word, np.append(self.entries, np.iinfo(np.int64).max)))
        self.sections, first = np.unique(entry_section, return_index=True)
        self.entry_at = np.append(first, len(self.entries))
        self.pair_at = np.concatenate(([0], np.cumsum(self.pairs_of)))[self.entry_at]


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _packed(values: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Counts as a byte each, in rows of values[bounds[i]:bounds[i + 1]]; 255 stands for one that follows among the large ones."""
    over = values >= 255
    at = np.concatenate(([0], np.cumsum(over)))[bounds]
    large = _binary(values[over].astype("<i8"), at * 8)
    return _binary(np.minimum(values, 255).astype(np.uint8), bounds), pc.if_else(pa.array(np.diff(at) > 0), large, pa.scalar(None, pa.binary()))


def _unpacked(small: list[bytes], large: list[bytes | None]) -> np.ndarray:
    values = np.frombuffer(b"".join(small), np.uint8).astype(np.int64)
    values[values == 255] = np.frombuffer(b"".join(x for x in large if x), "<i8")
    return values


def asked(chunks: DataFrame, buckets: int, hot: np.ndarray, turn: int) -> DataFrame:
    """What the chunks ask of the buckets of one round: words with their counts, and the histories of each with theirs."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                t = Chunk(row, buckets, hot)
                away = (t.sections % 2).astype(bool)
                counts = np.where(np.repeat(away, np.diff(t.entry_at)), 0, t.n[t.entry_word])
                words = _binary(t.words[t.entry_word].astype("<u8").view(np.uint8), t.entry_at * 8)
                hs = _binary(t.words[t.pair_h[t.order]].astype("<u8").view(np.uint8), t.pair_at * 8)
                columns = [pa.array(t.sections // 2, pa.int32()), pa.array(away), pa.array(np.full(len(away), row["chunk"])), words, *_packed(counts, t.entry_at), *_packed(t.pairs_of, t.entry_at), hs, *_packed(t.ns[t.order], t.pair_at)]
                out = pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ASKED.split(", ")])
                out = out.filter(pa.array(t.sections // 2 % ROUNDS == turn))
                del t, counts, words, hs, columns, row  # not beside the next chunk's
                yield out

    return chunks.select("chunk", "train", "sizes", "texts", "bytes").mapInArrow(ask, ASKED)


def _flat(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _count(rows: pa.Table, hot: np.ndarray) -> pa.Table:
    """Sums what the chunks ask of one bucket, and answers each of them.

    Also rows with distinct pairs, for their histories: their counts, and their
    words' counts (of frequent words, the word instead); and facts: number of words
    (1 + r) and pairs (101 + r) seen r times, distinct words (0) and tokens (-1).
    """
    words, away = _flat(rows.column("words"), "<u8"), rows.column("away").to_numpy()
    per_row = np.array([len(x) // 8 for x in rows.column("words").to_pylist()], np.int64)
    n, pairs_of = (_unpacked(rows.column(k).to_pylist(), rows.column(f"{k}_large").to_pylist()) for k in ("n", "np"))
    ns, hs = _unpacked(rows.column("ns").to_pylist(), rows.column("ns_large").to_pylist()), _flat(rows.column("hs"), "<u8")
    distinct, of = np.unique(words, return_inverse=True)
    c = np.bincount(of, n, len(distinct)).astype(np.int64)
    at_home = np.zeros(len(distinct), bool)
    at_home[of[~np.repeat(away, per_row)]] = True
    histories, h = np.unique(hs, return_inverse=True)
    key = np.repeat(of, pairs_of).astype(np.int64) << 32 | h
    order = np.argsort(key)
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    sums = np.add.reduceat(ns[order], first) if len(first) else ns
    cs = np.empty(len(ns), np.int64)
    cs[order] = np.repeat(sums, np.diff(first, append=len(key)))
    bounds = np.concatenate(([0], np.cumsum(per_row)))
    pair_bounds = np.concatenate(([0], np.cumsum(pairs_of)))[bounds]
    names = [x.split()[0] for x in COUNTED.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in COUNTED.split(", ")])

    def of_columns(size: int, **columns: pa.Array) -> pa.Table:
        return pa.Table.from_arrays([columns.get(k, pa.nulls(size, schema.field(k).type)).cast(schema.field(k).type) for k in names], schema=schema)

    small, large = _packed(c[of], bounds)
    cs_small, cs_large = _packed(cs, pair_bounds)
    out = [of_columns(rows.num_rows, **{k: rows.column(k).combine_chunks() for k in ("bucket", "away", "chunk", "words")}, c=small, c_large=large, cs=cs_small, cs_large=cs_large)]
    # distinct pairs that training has seen
    seen = sums > 0
    pairs, own_c = key[order][first][seen], sums[seen]
    w, own = pairs >> 32, histories[pairs & 0xFFFFFFFF].view(np.int64)
    is_hot = np.isin(distinct, hot)
    cuts = np.flatnonzero((np.diff(w, prepend=-1) != 0) & (is_hot[w] | np.concatenate(([False], is_hot[w][:-1]))))
    cuts = np.unique(np.concatenate([cuts, np.arange(0, len(w), SLAB)]))
    lists = lambda x, kind: pa.ListArray.from_arrays(np.append(cuts, len(w)).astype(np.int32), pa.array(x, kind))
    if len(w):
        hot_w = pa.array(distinct[w[cuts]].view(np.int64), mask=~is_hot[w[cuts]])
        out.append(of_columns(len(cuts), hot=hot_w, own=lists(own, pa.int64()), own_c=lists(own_c, pa.int32()), own_w=lists(np.where(is_hot[w], 0, c[w]), pa.int64())))
    real = at_home & (distinct != np.uint64(START))
    facts = {0: int((c[real] > 0).sum()), -1: int(c[real].sum())}
    for r in range(1, K + 2):
        facts |= {1 + r: int((c[real] == r).sum()), 101 + r: int((sums == r).sum())}
    out.append(of_columns(len(facts), fact=pa.array(list(facts)), value=pa.array(list(facts.values()))))
    known = is_hot & at_home
    if known.any():
        out.append(of_columns(int(known.sum()), hot=pa.array(distinct[known].view(np.int64)), value=pa.array(c[known])))
    return pa.concat_tables(out)


def discounts(seen: dict[int, int]) -> list[float]:
    """Katz's discount ratios of counts 0 to K, by Good and Turing; seen: how many have a count.

    Where the counts of counts can't give a ratio between 0 and 1, half a count is taken off.
    """
    out = [0.0]
    n = [seen.get(r, 0) for r in range(K + 2)]
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


class Model:
    """What is left to know of the corpus: tokens, distinct words, and discounts; a few numbers."""

    def __init__(self, facts: dict[int, int]):
        self.tokens, self.words = facts.get(-1, 0), facts.get(0, 0)
        self.word_d = discounts({r: facts.get(1 + r, 0) for r in range(1, K + 2)})
        self.pair_d = discounts({r: facts.get(101 + r, 0) for r in range(1, K + 2)})
        left = sum((1 - self.word_d[r]) * r * facts.get(1 + r, 0) for r in range(1, K + 1))
        self.unknown = left / self.tokens if left > 0 else 1.0  # of any word that wasn't seen

    def pick(self, c: Column, ratios: list[float]) -> Column:
        return F.when(c > K, F.lit(1.0)).otherwise(F.get(F.lit(ratios), c.cast("int")))

    def word_p(self, c: np.ndarray) -> np.ndarray:
        d = np.array([*self.word_d, 1.0])[np.minimum(c, K + 1)]
        return np.where(c > 0, d * c / max(1, self.tokens), self.unknown)


def histories(counted: DataFrame, model: Model) -> DataFrame:
    """(h, mass, words_mass): sums over the pairs of a history: discounted counts, and word probabilities."""
    hot = F.broadcast(counted.where("value is not null and hot is not null").select("hot", F.col("value").alias("hot_c")))  # fewer than 2 x FREQUENT words
    pairs = counted.where("own is not null").join(hot, "hot", "left").select("hot_c", F.explode(F.arrays_zip("own", "own_c", "own_w")).alias("x"))
    pairs = pairs.select("x.own", "x.own_c", F.coalesce("hot_c", "x.own_w").alias("c"))
    p = model.pick(F.col("c"), model.word_d) * F.col("c") / F.lit(float(max(1, model.tokens)))
    mass = model.pick(F.col("own_c"), model.pair_d) * F.col("own_c")
    return pairs.groupBy(F.col("own").alias("h")).agg(F.sum(mass).alias("mass"), F.sum(p).alias("words_mass"))


def _weights(asked: pa.Table, known: pa.Table) -> pa.Table:
    """Of one bucket, for each chunk its words' backoff weights as histories; below zero where one more count divides them."""
    h = known.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    h, mass, words_mass = h[order], known.column("mass").to_numpy()[order], known.column("words_mass").to_numpy()[order]
    out = []
    for words, small, large in zip(*(asked.column(k).to_pylist() for k in ("words", "c", "c_large"))):
        w, c = np.frombuffer(words, "<u8"), _unpacked([small], [large]).astype(np.float64)
        m, wm = np.zeros(len(w)), np.zeros(len(w))
        if len(h):
            at = np.minimum(np.searchsorted(h, w), len(h) - 1)
            hit = h[at] == w
            m[hit], wm[hit] = mass[at[hit]], words_mass[at[hit]]
        flat = (m > 0) & (m >= c - 1e-9)  # nothing is left for other words: one more count is
        left = 1 - wm
        left = np.where(left > 1e-12, left, 1.0)  # after a history that all words follow, only unseen ones share what is left
        back = np.where(m > 0, (1 - m / np.maximum(c + flat, 1)) / left, 1.0)
        out.append(np.where(flat, -back, back).tobytes())
    n = asked.num_rows
    return pa.table([asked.column("chunk"), asked.column("bucket"), pa.array([False] * n), pa.array(out, pa.binary())], ["chunk", "bucket", "away", "back"])


def _score(chunk: pa.Table, answers: pa.Table, model: Model, buckets: int, hot: np.ndarray) -> pa.Table:
    row = chunk.to_pylist()[0]
    t = Chunk(row, buckets, hot)
    at = {int(s): k for k, s in enumerate(t.sections)}
    c, pair_c, back = np.zeros(len(t.words), np.int64), np.zeros(len(t.pair_w), np.int64), np.ones(len(t.words))
    for x in answers.to_pylist():
        k = at[x["bucket"] * 2 + x["away"]]
        words = t.entry_word[t.entry_at[k] : t.entry_at[k + 1]]
        if x["back"] is not None:
            back[words] = np.frombuffer(x["back"])
            continue
        pair_c[t.order[t.pair_at[k] : t.pair_at[k + 1]]] = _unpacked([x["cs"]], [x["cs_large"]])
        if not x["away"]:
            c[words] = _unpacked([x["c"]], [x["c_large"]])
    total = c + np.signbit(back)
    word_p, d = model.word_p(c), np.array([*model.pair_d, 1.0])[np.minimum(pair_c, K + 1)]
    p = np.where(pair_c > 0, d * pair_c / np.maximum(total[t.pair_h], 1), np.abs(back[t.pair_h]) * word_p[t.pair_w])
    base = np.log10((c + 0.1) / (model.tokens + 0.1 * (model.words + 1)))[t.pair_w]
    per_doc = lambda x: np.add.reduceat(x[t.pair], t.starts)
    n = len(t.train)
    return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(~t.train), "n_tokens": pa.array(t.lengths.astype(np.int64)), "n_known": pa.array(per_doc((c > 0).astype(np.int64)[t.pair_w])), "train_tokens": pa.array([model.tokens] * n, pa.int64()), "base_score": pa.array(per_doc(base)), "score": pa.array(per_doc(np.log10(p)))})


def score_documents(docs: DataFrame, folds: int = 10, held_out: int = 0, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Scores whole texts by a model of those that aren't held out: one row per row of docs.

    docs: doc_id long, text string; other columns are ignored. Tokens are words,
    A-Z lower-cased, then one end; a document starts with a history of its own. A
    null or empty text has the end only. Words that training never saw share one
    probability, the mass that discounting took from words, which a backoff scales
    like any other. Repeated rows are counted and scored as often as they occur.
    An empty table, or one without training rows, works: then all words are unseen.
    base_score is the sum of log10((c + 0.1) / (N + 0.1 (V + 1))). Words are told
    apart by 64-bit hashes. Rows may come in any order, and share ids or have none.
    """
    chunks = stored(packed(docs, folds, held_out, chunk_bytes), "chunks")
    size = chunks.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    buckets = max(ROUNDS, ceil(size["bytes"] / bucket_bytes))
    often = chunks.select(F.explode(F.arrays_zip("often", "often_n")).alias("x")).groupBy("x.often").agg(F.sum("x.often_n").alias("n"))
    # fewer than 2 x FREQUENT words
    hot = np.sort(np.array([r["often"] for r in often.where(F.col("n") * (2 * FREQUENT) >= size["tokens"]).collect()], np.int64).view(np.uint64))
    parts = [stored(asked(chunks, buckets, hot, turn).groupBy("bucket").applyInArrow(lambda rows: _count(rows, hot), COUNTED), "counts") for turn in range(ROUNDS)]
    counted = reduce(DataFrame.unionByName, parts)
    model = Model({r["fact"]: r["n"] for r in counted.where("fact is not null").groupBy("fact").agg(F.sum("value").alias("n")).collect()})
    masses = stored(histories(counted, model), "histories")
    answers = counted.where("chunk is not null")
    home = answers.where("not away").select("chunk", "bucket", "words", "c", "c_large")
    bucket = F.pmod(F.shiftrightunsigned("h", 20).bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(buckets)).cast("int")
    weights = home.groupBy("bucket").cogroup(masses.withColumn("bucket", bucket).groupBy("bucket")).applyInArrow(_weights, "chunk long, bucket int, away boolean, back binary")
    none = F.lit(None).cast("binary")
    told = answers.select("chunk", "bucket", "away", "c", "c_large", "cs", "cs_large", none.alias("back"))
    told = stored(told.unionByName(weights.select("chunk", "bucket", "away", *[none.alias(k) for k in ("c", "c_large", "cs", "cs_large")], "back")), "answers")
    for done in (*parts, masses):  # what the answers were made of
        discard(done)
    d = chunks.select("chunk", "ids", "train", "sizes", "texts", "bytes")
    return d.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(lambda left, right: _score(left, right, model, buckets, hot), SCORES)
