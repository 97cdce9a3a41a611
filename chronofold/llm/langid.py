"""Language identification with a string kernel.

A text is the set of its character n-grams of 1 to 3 characters (a blended spectrum, presence only); the kernel of two
texts is the cosine of their sets. A bounded sample per language gives landmarks; Nyström features are the kernel
values with the landmarks times the inverse square root of the landmarks' own kernel matrix, and one ridge regression per
language (one against the rest) is fitted on them. Scoring a batch of texts is two matrix products: presence by
landmarks, features by weights. The kernel is exact: an n-gram that no landmark has is in no intersection, so it needs no
dimension, and only counts in the size of its set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, mix64

#: texts of each language used for fitting (about so many, chosen by the hash of the id), of all languages at most, and landmarks of each
PER_LANGUAGE, SAMPLE, LANDMARKS = 300, 4000, 32
RIDGE = 0.05
UNKNOWN = "und"

_FOLD = np.arange(0x250, dtype=np.uint32)
for _i in range(0x250):
    _c = chr(_i)
    _FOLD[_i] = ord(_c.lower()) if _c.isalpha() and len(_c.lower()) == 1 else (_i if _c.isalpha() else 32)


def grams(text: str) -> np.ndarray:
    """Sorted distinct hashes of the 1- to 3-character grams. Letters are lower-cased, runs of anything else become one space."""
    u = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    u = np.where(u < 0x250, _FOLD[np.minimum(u, 0x24F)], u).astype(np.uint64)
    u = np.concatenate(([np.uint64(32)], u, [np.uint64(32)]))
    keep = np.ones(len(u), dtype=bool)
    keep[1:] = ~((u[1:] == 32) & (u[:-1] == 32))
    u = u[keep]
    s = np.uint64(21)
    two = (u[:-1] << s) | u[1:]
    three = (two[:-1] << s) | u[2:]
    return np.unique(np.concatenate((u, two, three)))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


@dataclass
class Model:
    languages: list[str]
    keys: np.ndarray  # sorted hashes of the dimensions
    landmarks: np.ndarray  # dimensions x landmarks, each column divided by its norm
    weights: np.ndarray  # landmarks x languages: whitening times ridge weights
    offset: np.ndarray

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Texts by landmarks: size of the intersection over the root of the product of the sizes."""
        x = np.zeros((len(sets), len(self.keys)), dtype=np.float32)
        for i, g in enumerate(sets):
            at = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
            x[i, at[self.keys[at] == g]] = 1
        return (x @ self.landmarks) / np.sqrt([max(len(g), 1) for g in sets], dtype=np.float32)[:, None]

    def margins(self, sets: list[np.ndarray]) -> np.ndarray:
        return self.kernel(sets) @ self.weights + self.offset


def fit(rows: list[tuple[str, np.ndarray]], ridge: float = RIDGE, landmarks: int = LANDMARKS) -> Model | None:
    """Fit on (language, n-gram set) pairs; None without any."""
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    sets = [g for _, g in rows]
    label = np.array([languages.index(lang) for lang, _ in rows])
    marks = [sets[i] for k in range(len(languages)) for i in np.flatnonzero(label == k)[:landmarks]]
    keys = np.unique(np.concatenate(marks))
    columns = np.zeros((len(keys), len(marks)), np.float32)
    for j, g in enumerate(marks):
        columns[np.searchsorted(keys, g), j] = 1 / np.sqrt(len(g))
    model = Model(languages, keys, columns, np.zeros((0, 0)), np.zeros(0))
    value, vector = np.linalg.eigh(model.kernel(marks).astype(np.float64))
    good = value > 1e-6 * value.max()
    white = vector[:, good] / np.sqrt(value[good])
    features = np.concatenate([model.kernel(sets[i:i + 128]).astype(np.float64) for i in range(0, len(sets), 128)]) @ white
    target = np.where(label[:, None] == np.arange(len(languages))[None, :], 1.0, -1.0)
    # every language weighs the same, however many of its texts the sample has
    w = 1.0 / np.bincount(label, minlength=len(languages))[label]
    centre = (features * w[:, None]).sum(axis=0) / w.sum()
    mean = (target * w[:, None]).sum(axis=0) / w.sum()
    f = features - centre
    a = (f * w[:, None]).T @ f + ridge * w.sum() / max(1, len(centre)) * np.eye(len(centre))
    beta = np.linalg.solve(a, (f * w[:, None]).T @ (target - mean))
    return Model(languages, keys, columns, (white @ beta).astype(np.float32), (mean - centre @ beta).astype(np.float32))


def training_sets(docs: DataFrame, allowed: Column, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> list[tuple[str, np.ndarray]]:
    """N-gram sets of about ``per_language`` texts of each language, ``sample`` in all at most.

    A row is taken where the hash of its id, as a share of all hashes, times the number of its language's rows is below
    ``per_language`` (less where there are many languages), so no language is ranked or gathered in one task. Of rows that repeat an id
    the first text in order counts. Null ids, languages and texts are left out.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("doc_id is not null and lang is not null and text is not null").where(allowed)
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    quota = max(1, min(per_language, sample // max(1, languages)))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    picked = rows.join(F.broadcast(counts) if languages <= sample else counts, "lang").where(share * F.col("n") < quota)
    picked = picked.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([grams(t).view(np.int64) if has_letter(t) else None for t in b.column(2).to_pylist()], pa.list_(pa.int64()))], names=["doc_id", "lang", "g"])

    got = picked.mapInArrow(run, "doc_id long, lang string, g array<long>").where("g is not null").toArrow()
    order = np.argsort(mix64(got["doc_id"].to_numpy().astype(np.uint64)), kind="stable")
    lang, g = got["lang"].to_pylist(), got["g"]
    return [(lang[i], np.asarray(g[i].values).view(np.uint64)) for i in order.tolist()]


def identify_language(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` beside its columns (columns of these names are replaced).

    Texts that are null or without any letter, and all texts where nothing could be learned, get ``und`` and 0. The score is the
    winner's share after a softmax of the margins. Ties go to the language that comes first in the alphabet. Rows are
    independent, so repeated ones get equal answers; texts are read whole; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
            for k in range(0, len(known), 128):
                part = known[k:k + 128]
                m = model.margins([grams(texts.iloc[i]) for i in part])
                p = np.exp(4 * (m - m.max(axis=1, keepdims=True)))
                best = m.argmax(axis=1)
                for i, b, q in zip(part, best.tolist(), (p.max(axis=1) / p.sum(axis=1)).tolist()):
                    lang[i], score[i] = model.languages[b], q
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    own = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    out = "__l"
    while out in docs.columns:
        out += "_"
    return docs.withColumn(out, predict(F.col(text_col))).select(*own, f"{out}.lang_pred", f"{out}.score")
