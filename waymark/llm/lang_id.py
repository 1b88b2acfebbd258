"""Language ID by hierarchical discrimination.

Linear models on frequencies of hashed character 2- and 3-grams first tell the
language family; within it, one-versus-one linear support vector machines separate
the languages. Models are fitted on a bounded sample; every whole text is judged.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from waymark.llm.common import part_of, sampled, slices

#: Language families; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "semitic": "ar he am mt",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

#: Size of the hashed feature space.
FEATURES = 4096
#: Documents that the models are fitted on, about: the bound of the training sample.
TRAIN_DOCS = 3000
UNKNOWN = "und"

_CLEAN = np.full(256, 0x20, np.int64)
_CLEAN[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_CLEAN[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_CLEAN[0x80:] = np.arange(0x80, 0x100)


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers at each position of all texts, 2- and 3-grams side by side; first position of each text.

    Letters count in lower case (ASCII and Latin-1); anything else in ASCII is a space.
    """
    raw = np.frombuffer(b" " + b"  ".join([*texts, b""]) + b" ", np.uint8)
    b = _CLEAN[raw]
    latin = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)
    b[1:][latin] += 0x20
    starts = np.cumsum([0, *(len(t) + 2 for t in texts[:-1])])
    third = b[2:].copy()
    third[starts[1:] - 1] = 0x20  # a text's last gram doesn't reach into the next one
    two, three = b[:-2] * 0x1F3 + b[1:-1] * 0x2B5, third * 0x4C7
    mixed = np.stack([two * 0x9E3779B1 >> 9, (two + three) * 0x85EBCA77 >> 11]) & (FEATURES - 1)
    return mixed, starts


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mean of values from each start to the next, by columns."""
    n = np.diff(np.append(starts, len(values)))
    return np.add.reduceat(values, starts, axis=0, dtype=np.float64) / n[:, None]


def frequencies(texts: list[bytes]) -> np.ndarray:
    """Relative frequencies of features, one row per text."""
    mixed, starts = grams(texts)
    ends = np.append(starts[1:], mixed.shape[1])
    return np.stack([np.bincount(mixed[:, a:b].ravel(), minlength=FEATURES) / (b - a) for a, b in zip(starts, ends)]).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear support vector machine with squared hinge loss; y: -1 or 1."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    rate = 1 / (1 / c + 2 * float(weight @ np.einsum("ij,ij->i", x1, x1).astype(np.float64)))
    for t in range(rounds):  # Nesterov's accelerated gradient
        slack = np.maximum(0, 1 - y * (x1 @ v.astype(np.float32)))
        grad = v / c - 2 * x1.T @ (weight * y * slack).astype(np.float32)
        new = v - rate * grad
        v, w = new + t / (t + 3) * (new - w), new
    return w[:-1], float(w[-1])


@dataclass
class Model:
    languages: list[str]
    families: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray  # features x (families, pairs)
    offsets: np.ndarray

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        mixed, starts = grams(texts)
        margins = self.offsets + sums(self.weights[mixed[0]] + self.weights[mixed[1]], starts)
        sure = 1 / (1 + np.exp(-4 * np.clip(margins, -8, 8)))
        nf = len(self.families)
        best = sure[:, :nf].argmax(axis=1)
        wins, score = np.zeros((len(texts), len(self.languages))), np.zeros((len(texts), len(self.languages)))
        rivals = np.zeros(len(self.languages))
        for k, (i, j) in enumerate(self.pairs):
            p = sure[:, nf + k]
            wins[:, i] += p >= 0.5
            wins[:, j] += p < 0.5
            score[:, i] += p
            score[:, j] += 1 - p
            rivals[[i, j]] += 1
        score = np.where(rivals > 0, score / np.maximum(1, rivals), 1.0)
        own = np.array([self.families.index(FAMILY.get(x, x)) for x in self.languages])
        rank = np.where(own[None, :] == best[:, None], 1 + wins + score / 2, 0)
        pick = rank.argmax(axis=1)
        total = score[np.arange(len(texts)), pick] * sure[np.arange(len(texts)), best]
        return [self.languages[i] for i in pick], total.tolist()


def fit(x: np.ndarray, labels: list[str]) -> Model:
    """Families one against the rest, and the languages of each family one against one."""
    languages = sorted(set(labels))
    y = np.array([languages.index(v) for v in labels])
    families = sorted({FAMILY.get(v, v) for v in languages})
    of = np.array([families.index(FAMILY.get(v, v)) for v in languages])
    pairs = [(i, j) for i, j in combinations(range(len(languages)), 2) if of[i] == of[j]]
    if not languages:
        return Model([], [], [], np.zeros((FEATURES, 0), np.float32), np.zeros(0))
    scale = 1 / (x.std(axis=0) + 1e-4)
    x = x * scale / np.sqrt(FEATURES)
    fitted = []
    for f in range(len(families)):
        fitted.append(fit_svm(x, np.where(of[y] == f, 1.0, -1.0)) if len(families) > 1 else (np.zeros(FEATURES), 2.0))
    for i, j in pairs:
        rows = (y == i) | (y == j)
        fitted.append(fit_svm(x[rows], np.where(y[rows] == i, 1.0, -1.0)))
    weights = np.stack([w for w, _ in fitted], axis=1) * scale[:, None] / np.sqrt(FEATURES)
    return Model(languages, families, pairs, weights.astype(np.float32), np.array([b for _, b in fitted]))


def train(docs: DataFrame, bound: int = TRAIN_DOCS) -> Model:
    """Fits on about ``bound`` labelled documents at most: distinct ones, those with the lowest hashes of their texts.

    docs: doc_id, text, lang; rows with a null lang or text are left out.
    """
    rows = docs.where("lang is not null and text is not null").select("lang", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                flat = pa.array([row.tobytes() for row in frequencies(texts)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), flat], ["lang", "x"])

    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [(lang, x) for batch in batches for lang, x in zip(*(c.to_pylist() for c in batch.columns))]
        sample.sort()
        x = np.empty((len(sample), FEATURES), np.float32)
        for k, (_, row) in enumerate(sample):
            x[k] = np.frombuffer(row, np.float32)
        model = fit(x, [lang for lang, _ in sample])
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    # the sample is bounded, so one task fits on it, and the driver gets weights only
    sample = sampled(rows, bound).mapInArrow(features, "lang string, x binary").repartition(1)
    got = sample.mapInArrow(fit_all, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else fit(np.zeros((0, FEATURES), np.float32), [])


def predict(docs: DataFrame, model: Model, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Adds lang_col and score_col (0 to 1) to all rows of docs; of its columns only text is read.

    A null text or one without a letter is 'und' with score 0. Repeated rows get
    the same answer, an empty table gives an empty result, other columns are kept;
    columns with the names of the added ones are replaced.
    """
    names = [c for c in docs.columns if c not in (lang_col, score_col)]
    docs = docs.select(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x models, a fixed size

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for first, texts in slices(batch.column(at)):
                langs, scores = model.predict(texts)
                for i, text in enumerate(texts):
                    if not has_letter(text[:4096]) and not has_letter(text):
                        langs[i], scores[i] = UNKNOWN, 0.0
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, lang_col, score_col])

    return docs.mapInArrow(judge, StructType([*docs.schema.fields, StructField(lang_col, StringType()), StructField(score_col, DoubleType())]))


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that aren't held out."""
    out = part_of(F.col("doc_id"), folds) == held_out
    model = train(docs.where(~out))
    kept = docs.select("doc_id", "text", out.alias("held_out"))
    return predict(kept, model).select("doc_id", "held_out", "lang_pred", "score")
