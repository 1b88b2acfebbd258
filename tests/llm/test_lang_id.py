import math
import zlib
from collections import Counter

import numpy as np
from cases import SF, frame, table
from waymark.llm import lang_id, queries

SCHEMA = "doc_id long, text string, lang string, score string, source string"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {d[0]: d for d in table("documents", sf)}
    rows = queries.op7_lang_id(spark, sf).collect()
    assert len(rows) == len(docs)
    right = Counter()
    for r in rows:
        _, text, lang, *_ = docs[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        letters = any(c.isalpha() for c in text or "")
        assert (r["lang_pred"] == "und") == (not letters)
        if r["held_out"] and lang and letters and len(text.split()) >= 5:
            right[r["lang_pred"] == lang] += 1
    assert right[True] / sum(right.values()) > 0.97, right


def test_prediction_uses_text_only(spark):
    docs = table("documents")
    df = frame(spark, [(d[0], d[1], d[2], "", "") for d in docs], SCHEMA)
    model = lang_id.train(df)
    moved = frame(spark, [(None, d[1], None, None, "other") for d in docs], SCHEMA).drop("score")
    a = sorted(tuple(r) for r in lang_id.predict(df.drop("score"), model).select("text", "lang_pred", "score").collect() if r["text"])
    b = sorted(tuple(r) for r in lang_id.predict(moved, model).select("text", "lang_pred", "score").collect() if r["text"])
    assert a == b


def test_odd_texts(spark):
    rows = [(1, None, "en", "", ""), (2, "", "en", "", ""), (3, "123 -- !", None, "", ""), (4, "the cat and the dog " * 20_000, "en", "", ""), (5, "le chat et le chien dans la maison", "fr", "", ""), (6, "x", "fr", "", ""), (6, "x", "fr", "", ""), (7, "漢字 かな", None, "", ""), (None, "the house of the king", "en", "", "")]
    got = lang_id.identify(frame(spark, rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for k in (1, 2, 3):
        assert (by[k]["lang_pred"], by[k]["score"]) == ("und", 0.0)
    assert by[7]["lang_pred"] in ("en", "fr")


def test_nothing_to_learn(spark):
    assert lang_id.identify(frame(spark, [], SCHEMA)).count() == 0
    got = lang_id.identify(frame(spark, [(1, "some words", None, "", "")], SCHEMA)).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)]
    got = lang_id.identify(frame(spark, [(i, "some words here", "en", "", "") for i in range(8)], SCHEMA)).collect()
    assert {r["lang_pred"] for r in got} == {"en"}


def test_same_again(spark):
    one, two = (sorted(map(tuple, queries.op7_lang_id(spark, SF).collect())) for _ in range(2))
    assert one == two


def test_rows_without_an_id_or_of_one_text_leave_the_sample_bounded(spark):
    rows = [(None, f"words of the text number {i} in english", "en", None, None) for i in range(3000)] + [(i, "always the same text", "en", None, None) for i in range(3000)]
    docs = frame(spark, rows, SCHEMA)
    from waymark.llm.common import sampled

    assert sampled(docs.select("lang", "text"), 100).count() < 160


def test_columns_with_the_names_of_added_ones(spark):
    docs = spark.createDataFrame([(1, "the words", 7, "x")], "doc_id long, text string, score int, lang_pred string")
    model = lang_id.train(spark.createDataFrame([("en", "the words of a text"), ("fr", "les mots du texte")], "lang string, text string"))
    got = lang_id.predict(docs, model).first()
    assert got["lang_pred"] in ("en", "fr") and isinstance(got["score"], float)
    kept = lang_id.predict(docs, model, "_l", "_s").first()
    assert (kept["score"], kept["lang_pred"]) == (7, "x") and kept["_l"] in ("en", "fr")


def test_fit_reaches_the_least_loss():
    """Squared hinge loss of the fit against that of a long plain descent."""
    rng = np.random.default_rng(2)
    for n, apart in ((60, 2.0), (200, 0.5)):
        y = np.where(rng.random(n) < 0.3, 1.0, -1.0)
        x = (rng.standard_normal((n, 5)) + apart * y[:, None] * np.array([1, 0, 0.5, 0, 0])).astype(np.float32)
        weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
        x1 = np.hstack([x.astype(float), np.ones((n, 1))])

        def loss(v):
            return v @ v / 20 + weight @ np.maximum(0, 1 - y * (x1 @ v)) ** 2

        v = np.zeros(6)
        for _ in range(20_000):
            v -= 0.02 * (v / 10 - 2 * x1.T @ (weight * y * np.maximum(0, 1 - y * (x1 @ v))))
        w, b = lang_id.fit_svm(x, y)
        assert loss(v) - 1e-9 <= loss(np.append(w, b)) <= loss(v) * 1.01 + 1e-6


def test_predictions_by_brute_force(spark):
    """Family first, then votes of the pairs in it, out of each text's dense features."""
    docs = [d for d in table("documents") if d[1]]
    model = lang_id.train(frame(spark, [(d[0], d[1], d[2], "", "") for d in docs], SCHEMA))
    texts = [d[1].encode() for d in docs[:60]] + [b"x", "été à Paris".encode()]
    langs, scores = model.predict(texts)
    for text, lang, score in zip(texts, langs, scores):
        mixed, _ = lang_id.grams([text])
        x = np.bincount(mixed.ravel(), minlength=lang_id.FEATURES) / mixed.shape[1]
        sure = [1 / (1 + math.exp(-4 * max(-8, min(8, float(x @ model.weights[:, k].astype(float) + model.offsets[k]))))) for k in range(model.weights.shape[1])]
        nf = len(model.families)
        family = max(range(nf), key=lambda f: sure[f])
        members = [v for v in model.languages if lang_id.FAMILY.get(v, v) == model.families[family]]
        votes, means = dict.fromkeys(members, 0), {v: [] for v in members}
        for (i, j), p in zip(model.pairs, sure[nf:]):
            for v, q, won in ((model.languages[i], p, p >= 0.5), (model.languages[j], 1 - p, p < 0.5)):
                if v in votes:
                    votes[v] += won
                    means[v].append(q)
        mean = {v: sum(q) / len(q) if q else 1.0 for v, q in means.items()}
        assert lang == max(members, key=lambda v: votes[v] + mean[v] / 2)
        assert abs(score - mean[lang] * sure[family]) < 1e-4
