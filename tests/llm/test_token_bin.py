import json
import os
import tempfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cases import SF, frame, table
from waymark.llm import queries, token_bin

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start int"


def want(rows):
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[1])


def test_query_reads_back_every_text(spark):
    assert got(queries.op4_token_bin(spark, SF)) == want([r[:2] for r in table("documents")])


TEXTS = ["", None, " ", "\n\n", "a  b", " a b ", "tab\tand\r\nline", "it's  we'll x", "<|endoftext|> x", "hello <|endoftext|> world", "a  <|endoftext|>\n<|endoftext|>b<|endoftext|>  c", "x<|endoftext|>", " <|endoftext|> ", "ünï ☃ 漢字", "x\n y", "a b  c", "a\x1cb \x1c c", "a 　b", "1 2 33", "wörd\n\nnext", "-- !? ...", "a" * 50_000, "word " * 20_000, " \n \t x", "nul\x00byte"]


def test_odd_texts(spark):
    rows = [(i * 7 - 20, t, 0) for i, t in enumerate(TEXTS)] + [(5, "again", 0), (5, "again", 0), (5, None, 0)]
    df = token_bin.token_rows(frame(spark, rows, SCHEMA), PATH)
    # a null text sorts before an empty one
    key = lambda r: (r[0], r[1] is not None, r[1] or "")
    expected = want([])
    t = Tokenizer.from_file(PATH)
    start = 0
    for doc, text, _ in sorted(rows, key=key):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got(df) == expected


def test_empty_and_null_id(spark):
    assert token_bin.token_rows(frame(spark, [], SCHEMA), PATH).count() == 0
    rows = got(token_bin.token_rows(frame(spark, [(None, "x y", 0), (0, "z", 0)], SCHEMA), PATH))
    assert [r[0] for r in rows] == [None, 0] and rows[1][1] == rows[0][2]


def test_every_id_stays(spark):
    ids = [-5, -1, 3, None, -(1 << 62), (1 << 63) - 1, 0]
    rows = [(i, f"text {i}", 1, 2) for i in ids]
    df = token_bin.token_rows(frame(spark, rows, "doc_id long, text string, start int, n_tokens int"), PATH)
    assert [r[0] for r in got(df)] == [None, -(1 << 62), -5, -1, 0, 3, (1 << 63) - 1]
    assert got(df) == want([r[:2] for r in rows])
    with pytest.raises(Exception, match="stands for null"):
        token_bin.token_rows(frame(spark, [(-(1 << 63), "x", 0)], SCHEMA), PATH)


@pytest.mark.parametrize("name,size", [("byte_bpe_50k.json", 2), ("word_bpe_49k.json", 2)])
def test_files(spark, name, size):
    folder = tempfile.mkdtemp(prefix="spark-")
    docs = frame(spark, [(i, f"text number {i} " * i, 0) for i in range(30)], SCHEMA)
    shards = token_bin.write_tokens(docs, folder, public_tokenizers.path(name), 2, 4)
    meta = json.load(open(f"{folder}/bases.json"))
    assert meta["end_id"] == 2 and meta["shards"] == shards
    base = 0
    for s in shards:
        assert s["base"] == base
        base += s["n_tokens"]
        offsets = np.fromfile(f"{folder}/{s['shard']}.idx", "<i8")
        tokens = np.fromfile(f"{folder}/{s['shard']}.bin", f"<u{size}")
        assert offsets[0] == 0 and offsets[-1] == len(tokens) == s["n_tokens"] and len(offsets) == s["n_docs"] + 1
        assert (tokens[offsets[1:] - 1] == 2).all()
    assert not [f for f in os.listdir(folder) if f.endswith(".part")]
