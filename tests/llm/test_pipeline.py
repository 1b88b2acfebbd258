import zlib

import pytest

import corpus_pipeline
from cases import SF, frame, table
from waymark.llm import decontaminate
from test_mixing import targets
from test_ngram_join import shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        rows = after.collect()
        assert after.columns == docs.columns
        old = {r["doc_id"]: r for r in before.collect()}
        ids = [r["doc_id"] for r in rows]
        assert all(old[r["doc_id"]] == r for r in rows)
        if name == "language ID":
            gone = set(old) - set(ids)
            assert all(not any(c.isalpha() for c in old[i]["text"] or "") or len(old[i]["text"].split()) < 40 for i in gone)
            assert len(gone) < 0.05 * len(old)
        if name == "n-gram Jaccard join":
            kept = {i: shingles(old[i]["text"], 5) for i in ids}
            for i in set(old) - set(ids):  # each one that goes has a near one, in its group, that is left or goes for another
                s = shingles(old[i]["text"], 5)
                assert any(j != i and 5 * len(s & shingles(old[j]["text"], 5)) >= 4 * len(s | shingles(old[j]["text"], 5)) for j in old)
            sets = list(kept.values())
            assert not any(5 * len(a & b) >= 4 * len(a | b) for k, a in enumerate(sets) for b in sets[:k] if a)
        if name == "benchmark decontamination":
            items = [decontaminate.normal(t) for _, t in table("benchmark")]
            holds = {i for i, r in old.items() if any(t in decontaminate.normal(r["text"]) for t in items)}
            assert holds and not holds & set(ids) and len(set(old) - set(ids)) <= len(holds) + 3
        if name == "mixing sources to target weights":
            sizes = {}
            for r in old.values():
                sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").split())
            taken = dict.fromkeys(sizes, 0)
            for r in rows:
                taken[r["source"]] += len((r["text"] or "").split())
            for s, t in targets(sizes).items():
                assert taken[s] == pytest.approx(t, abs=max(len((r["text"] or "").split()) for r in old.values()) / 2 + 1)
            assert max(map(ids.count, set(ids))) <= 2
        path = f"{corpus_pipeline.shared_dir(spark)}/stage-{zlib.crc32(name.encode())}"
        after.write.mode("overwrite").parquet(path)
        before = spark.read.parquet(path)


def test_run(spark):
    rows = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert [a + n for a, n, _ in rows[:-1]] == [a for a, _, _ in rows[1:]]
    assert [r[2] for r in rows] == sorted(r[2] for r in rows)
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_documents(spark):
    docs = frame(spark, [], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_odd_documents(spark):
    text = "the words of a text that is long enough to tell"
    rows = [(None, None, None, None, None), (1, "", None, None, 0), (2, text, "en", "web", 1), (2, text, "en", "web", 1), (3, (text + " ") * 40_000, "en", None, 1), (4, text.upper(), None, "web", 1)]
    docs = frame(spark, rows, SCHEMA)
    kept = [sorted(r["doc_id"] for r in stage(spark, docs, SF).collect() if r["doc_id"] is not None) for _, stage in corpus_pipeline.STAGES[:4]]
    assert kept[0] == [2, 2, 3, 4]
    assert kept[1] == [1, 2, 2, 3]  # a text in capitals is a copy; a repeated row stays or goes with its like
    assert kept[2] == [1, 2, 2, 3, 4]
    assert set(kept[3]) <= {1, 2, 3, 4} and max(map(kept[3].count, kept[3])) <= 4
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() == len(rows)


def test_columns_with_the_names_of_inner_ones(spark):
    more = ["score", "lang_pred", "size", "target", "copies", "taken", "tokens", "rep", "component_id", "item_id"]
    rows = [(i, f"the words of text number {i} are long enough to tell what they are in", "en" if i % 2 else "fr", "web", 1, *range(len(more))) for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", {c} int" for c in more))
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        got = out.collect()
        assert out.columns == docs.columns and got
        assert all([r[c] for c in more] == list(range(len(more))) for r in got)
