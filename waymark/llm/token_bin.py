"""Token-ID / binary output: flat unsigned integer files with 64-bit document offsets.

A data set is a folder of shards. Shard ``x.bin`` holds the ids of its documents
one after the other (little-endian, uint16 or uint32), ``x.idx`` holds n + 1
64-bit offsets into it, and ``x.ids`` the n document ids, with the lowest 64-bit
integer for a null one. ``bases.json`` lists the shards in document order with the number of ids before each: the prefix sums of
the shards' totals. Readers map the files into memory.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import BYTE_CODES, shared_dir, slices, window_hashes

#: Ids of chunks of text that a task remembers, at most.
CACHE_IDS = 4_000_000
MANIFEST = "shard string, first_doc long, n_docs long, n_tokens long"
#: Stands for a null doc_id in ``x.ids``; a doc_id that equals it is an error.
NO_ID = -(1 << 63)
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def chunk_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where chunks of the texts data[bounds[i]:bounds[i + 1]] start: at texts, and at white space after anything else.

    What may be white space in more than one byte isn't cut behind.
    """
    space = np.isin(data, [0x20, 0x0A])
    at = np.flatnonzero(space[1:]) + 1
    a, b, c = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    maybe = (a <= 0x20) | ((b == 0xC2) & ((a == 0x85) | (a == 0xA0))) | ((c == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((c == 0xE1) & (b == 0x9A)) | ((c == 0xE3) & (b == 0x80))
    start = np.zeros(len(data), bool)
    start[at[~maybe]] = True
    start[bounds[:-1][np.diff(bounds) > 0]] = True
    return np.flatnonzero(start)


class CachedEncoder:
    """Encodes texts with the tokenizers library, each distinct chunk once.

    A byte-level BPE first takes out its added tokens, then cuts a text into words
    with the white space before them: it always cuts between white space and what
    isn't white space before it, and ids never reach over a cut. So chunks encode to
    the same ids as in their text, as long as no added token holds white space or
    takes up what surrounds it. Chunks are found by 64-bit hashes and compared byte
    by byte; where hashes collide, whole texts are encoded.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end_id = end_id
        vocabulary = self.tokenizer.get_vocab()
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.whole = any(t.lstrip or t.rstrip or t.content.split() != [t.content] for t in added)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True  # how byte-level vocabularies write a space
        self.clear()

    def clear(self) -> None:
        self.hashes, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.text_at, self.text_n, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        self.ids = np.array([self.end_id], self.kind)

    def encoded(self, chunks: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, given as bytes one after the other, and how many each has.

        Each has one space, in front, and no other white space. The tokenizer cuts
        there, so many are encoded as one text, and taken apart where an id stands
        for a space and more.
        """
        cuts = np.append(np.arange(0, len(size), 512), len(size))
        bounds = np.concatenate(([0], np.cumsum(size)))
        lots = [chunks[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(bounds[cuts[:-1]], bounds[cuts[1:]])]
        ids, counts = [], []
        for k, done in enumerate(self.tokenizer.encode_batch_fast(lots, add_special_tokens=False)):
            got = np.array(done.ids, self.kind)
            first = np.flatnonzero(self.opens[got])
            n = np.diff(first, append=len(got))
            if len(n) != cuts[k + 1] - cuts[k] or first[0]:  # this tokenizer's ids don't tell
                each = [chunks[bounds[i] : bounds[i + 1]].tobytes().decode("utf-8", "replace") for i in range(cuts[k], cuts[k + 1])]
                each = self.tokenizer.encode_batch_fast(each, add_special_tokens=False)
                got, n = np.array([x for e in each for x in e.ids], self.kind), np.array([len(e.ids) for e in each], np.int64)
            ids.append(got)
            counts.append(n)
        return np.concatenate([np.zeros(0, self.kind), *ids]), np.concatenate([np.zeros(0, np.int64), *counts])

    def learn(self, hashes: np.ndarray, chunks: np.ndarray, size: np.ndarray) -> None:
        """chunks: their bytes, one after the other."""
        start = np.cumsum(size) - size
        # what is white space, or may be in more than one byte
        after = np.append(chunks[1:], 0)
        space = (chunks <= 0x20) | ((chunks == 0xC2) & ((after == 0x85) | (after == 0xA0))) | ((chunks == 0xE1) & (after == 0x9A)) | ((chunks == 0xE2) & ((after == 0x80) | (after == 0x81))) | ((chunks == 0xE3) & (after == 0x80))
        plain = (chunks[start] == 0x20) & (np.add.reduceat(space.astype(np.int64), start) == 1) & (size > 1)
        ids, n = self.encoded(chunks[np.repeat(plain, size)], size[plain])
        odd = [chunks[a : a + k].tobytes().decode("utf-8", "replace") for a, k in zip(start[~plain].tolist(), size[~plain].tolist())]
        rest = self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)
        n = np.concatenate([n, np.array([len(x.ids) for x in rest], np.int64)])
        at = len(self.ids) + np.cumsum(n) - n
        self.ids = np.concatenate([self.ids, ids, np.array([i for x in rest for i in x.ids], self.kind)])
        turn = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        new = (hashes[turn], at, n, len(self.bytes) + start[turn], size[turn])
        self.bytes = np.concatenate([self.bytes, chunks])
        rows = [np.concatenate(x) for x in zip((self.hashes, self.at, self.n, self.text_at, self.text_n), new)]
        order = np.argsort(rows[0])
        self.hashes, self.at, self.n, self.text_at, self.text_n = (x[order] for x in rows)

    def plainly(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        done = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        ids = np.array([i for x in done for i in (*x.ids, self.end_id)], self.kind)
        return ids, np.array([len(x.ids) + 1 for x in done], np.int64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, each text's with the end id; how many each text has."""
        if self.whole:
            return self.plainly(texts)
        data = np.frombuffer(b"".join(texts), np.uint8)
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        starts = chunk_starts(data, bounds)
        size = np.diff(starts, append=len(data))
        hashes, first, of = np.unique(window_hashes(BYTE_CODES[data], starts, starts + size), return_index=True, return_inverse=True)
        # whether each chunk is the same as the first one with its hash
        if (size != size[first][of]).any() or (data != data[np.repeat(starts[first][of] - starts, size) + np.arange(len(data))]).any():
            return self.plainly(texts)
        if len(self.ids) > CACHE_IDS:
            self.clear()
        near = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        new = self.hashes[near] != hashes if len(self.hashes) else np.ones(len(hashes), bool)
        if new.any():
            a, n = starts[first[new]], size[first[new]]
            self.learn(hashes[new], data[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())], n)
        row = np.searchsorted(self.hashes, hashes)
        # and the same as the one that was learned
        a, n = starts[first], size[first]
        if (n != self.text_n[row]).any():
            return self.plainly(texts)
        before, step = np.cumsum(n) - n, np.arange(n.sum())
        if (data[np.repeat(a - before, n) + step] != self.bytes[np.repeat(self.text_at[row] - before, n) + step]).any():
            return self.plainly(texts)
        k = row[of]
        until = np.searchsorted(starts, bounds[1:])  # a text's end id stands behind its last chunk
        at, n = np.insert(self.at[k], until, 0), np.insert(self.n[k], until, 1)
        total = np.cumsum(n)
        lengths = np.diff(total[until + np.arange(len(texts))], prepend=0)
        return self.ids[np.repeat(at - total + n, n) + np.arange(total[-1])], lengths


_ENCODERS: dict[tuple[str, int], CachedEncoder] = {}


def encoder_of(path: str, end_id: int) -> CachedEncoder:
    """One encoder for each process, whatever tasks it runs."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = CachedEncoder(path, end_id)
    return _ENCODERS[path, end_id]


def _local(uri: str) -> str:
    where = urlparse(uri)
    if where.scheme not in ("", "file"):
        raise ValueError(f"shards are memory-mapped: {uri} has to be a mounted folder")
    return where.path


def _put(path: str, parts: list[bytes]) -> None:
    """A file appears under its name only when it is whole."""
    with open(f"{path}.part", "wb") as out:
        out.writelines(parts)
    os.replace(f"{path}.part", path)


def encoded_docs(docs: DataFrame, tokenizer: str, end_id: int, bounds: list[int]) -> DataFrame:
    """range, doc_id, n and ids (little-endian, as the files hold them) of each row, encoded where it is read."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoder = encoder_of(tokenizer, end_id)
            ranges = np.searchsorted(np.array(bounds, np.int64), batch.column(0).fill_null(NO_ID).to_numpy(), "right").astype(np.int32)
            for first, texts in slices(batch.column(1)):
                codes, n = encoder(texts)
                ends = np.concatenate(([0], np.cumsum(n))) * codes.itemsize
                ids = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(codes)])
                yield pa.RecordBatch.from_arrays([pa.array(ranges[first : first + len(n)]), batch.column(0).slice(first, len(n)), pa.array(n), ids.cast(pa.binary())], ["range", "doc_id", "n", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, "range int, doc_id long, n long, ids binary")


class Shard:
    """The files of one range of documents, written as rows come in."""

    def __init__(self, root: str):
        self.name, self.lengths, self.ids = uuid.uuid4().hex, [], []
        self.path = f"{root}/{self.name}"
        self.out = open(f"{self.path}.bin.part", "wb")  # noqa: SIM115

    def add(self, rows: pa.RecordBatch) -> None:
        if (found := rows.column(1).drop_null().to_numpy()).size and found.min() == NO_ID:
            raise ValueError(f"doc_id {NO_ID} stands for null in the files")
        self.ids.append(rows.column(1).fill_null(NO_ID).to_numpy().astype("<i8"))
        self.lengths.append(rows.column(2).to_numpy())
        for codes in rows.column(3):
            self.out.write(codes.as_buffer())

    def close(self, number: int) -> pa.RecordBatch:
        self.out.close()
        os.replace(f"{self.path}.bin.part", f"{self.path}.bin")
        offsets, ids = np.concatenate(([0], np.cumsum(np.concatenate(self.lengths)))).astype("<i8"), np.concatenate(self.ids)
        _put(f"{self.path}.idx", [offsets.tobytes()])
        _put(f"{self.path}.ids", [ids.tobytes()])
        return pa.RecordBatch.from_pydict({"range": pa.array([number], pa.int32()), "shard": [self.name], "first_doc": pa.array([None if ids[0] == NO_ID else int(ids[0])], pa.int64()), "n_docs": [len(ids)], "n_tokens": [int(offsets[-1])]})


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, partitions: int | None = None) -> list[dict]:
    """Encodes whole texts and writes the shards in ascending doc_id order; returns bases.json.

    docs: doc_id long, text string; other columns are ignored. A null text is
    empty and holds only the end id. A null doc_id sorts first and is written as the
    lowest 64-bit integer, which no document may have; all others are kept. Rows with the same doc_id are all written, those with fewer ids first, then
    in the order of their ids' bytes. An empty table gives an empty list. Each
    attempt of a task writes files of its own, and the manifest names those of the
    attempt that ended. Texts are encoded where they are read; what is shuffled is
    ids, by ranges of doc_id whose bounds are approximate quantiles of all of them.
    """
    root = _local(folder)
    os.makedirs(root, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = None, None
        for batch in batches:
            ranges = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(ranges, prepend=-1)).tolist()
            for a, b in zip(sorted({0, *cuts}), [*sorted({0, *cuts})[1:], batch.num_rows]):
                if a < b and ranges[a] != number:
                    if shard:
                        yield shard.close(number)
                    shard, number = Shard(root), int(ranges[a])
                if a < b:
                    shard.add(batch.slice(a, b - a))
        if shard:
            yield shard.close(number)

    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    quantiles = F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 100 * n)
    bounds = sorted(set(docs.agg(quantiles.alias("q")).first()["q"] or ())) if n > 1 else []
    dealt = encoded_docs(docs, tokenizer, end_id, bounds).repartition(n, "range").sortWithinPartitions("range", "doc_id", "n", "ids")
    # one row a range
    shards = sorted((x.asDict() for x in dealt.mapInArrow(write, f"range int, {MANIFEST}").collect()), key=lambda x: x.pop("range"))
    base = 0
    for x in shards:
        x["base"] = base
        base += x["n_tokens"]
    _put(f"{root}/bases.json", [json.dumps({"end_id": end_id, "shards": shards}).encode()])
    return shards


def read_tokens(spark, folder: str, item_size: int = 2) -> DataFrame:
    """One row per document, from the mapped files: doc_id, start, n_tokens, ids_crc32."""
    root = _local(folder)
    with open(f"{root}/bases.json", "rb") as file:
        shards = json.load(file)["shards"]
    kind = np.dtype(f"<u{item_size}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = f"{root}/{shard}"
                tokens = np.memmap(f"{path}.bin", kind, "r")
                offsets = np.memmap(f"{path}.idx", "<i8", "r")
                ids = np.memmap(f"{path}.ids", "<i8", "r")
                for a in range(0, len(ids), 8192):
                    b = min(a + 8192, len(ids))
                    at, docs = offsets[a : b + 1], np.array(ids[a:b])
                    crc = [zlib.crc32(tokens[x:y].astype("<u4")) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(docs, mask=docs == NO_ID), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = [(x["shard"], x["base"]) for x in shards]
    frame = spark.createDataFrame(rows, "shard string, base long")
    return frame.repartition(max(1, len(rows)), "shard").mapInArrow(read, ROWS)


def token_rows(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes a data set of ``docs`` into the shared folder and reads it back."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, folder, tokenizer, end_id)
    wide = Tokenizer.from_file(tokenizer).get_vocab_size() > 1 << 16
    return read_tokens(spark, folder, 4 if wide else 2)
