"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability sigmoid(bias + sum of the weights of its
distinct features); the document's score is their noisy-or, 1 - prod(1 - p). Only document labels are
seen in training; the noisy-or puts the blame on the sentences that explain the label, so the same
model locates the offending sentences.

Features are words and word beginnings of four and five letters. Training uses a bounded sample of
labelled documents: `max_docs` documents in expectation, chosen by a hash of doc_id, and the `max_features`
features with the largest chi-squared against the labels among those of at least `min_docs` documents.
Scoring covers every sentence of every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanqa.llm.common import land

MAX_DOCS = 20_000
MAX_FEATURES = 2_000
MIN_DOCS = 3
THRESHOLD = 0.3
OFFENDING = 0.5
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORDS = re.compile(r"\w+")
_CACHE = 500_000


class _Features(dict):
    """word -> ids of its features, filled as words are met; emptied when it has too many words."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > _CACHE:
            self.clear()
        ids = tuple(i for i in map(self.vocabulary.get, names(word)) if i is not None)
        self[word] = ids
        return ids


def names(word: str) -> list[str]:
    """Feature names of a lower-case word."""
    out = [word]
    if len(word) > 4:
        out.append(word[:4] + "*")
    if len(word) > 5:
        out.append(word[:5] + "*")
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    """Feature weights and bias; `score` gives a text's probability and its offending sentences."""

    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray, bias: float):
        self.vocabulary, self.weights, self.bias = vocabulary, weights.tolist(), float(bias)
        self._features = _Features(vocabulary)
        self._plain = float(np.logaddexp(0.0, bias))

    def __reduce__(self):
        return Model, (self.vocabulary, np.array(self.weights), self.bias)

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """(probability, [(start, end, probability) of sentences at OFFENDING or more]); no sentence: 0."""
        total, found, features, w = 0.0, [], self._features, self.weights
        for m in _SENTENCE.finditer(text or ""):
            words = set(_WORDS.findall(m.group().lower()))
            if not words:
                continue
            ids = {i for x in words for i in features[x]}
            if not ids:
                total += self._plain
                continue
            z = self.bias + sum(w[i] for i in ids)
            total += z + np.log1p(np.exp(-z)) if z > 0 else np.log1p(np.exp(z))
            if z >= 0:  # sigmoid(z) >= OFFENDING
                found.append((m.start(), m.end(), float(1 / (1 + np.exp(-z)))))
        return float(-np.expm1(-total)), found


def fit(vocabulary: list[str], y: np.ndarray, plain: np.ndarray, doc: np.ndarray, sent: np.ndarray, feat: np.ndarray,
        rounds: int = 300, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Train on bags. y: label of each document; plain: its sentences without a feature; doc: document of each other
    sentence; sent, feat: sentence and feature of each occurrence."""
    n, k = len(y), len(doc)
    if not n or y.min() == y.max():
        return Model({}, np.zeros(0), 20.0 if n and y.min() > 0 else -20.0)
    w, b = np.zeros(len(vocabulary)), -4.0
    m1, m2, mb1, mb2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = b + np.bincount(sent, w[feat], k)
        p = 1 / (1 + np.exp(-z))
        pb = 1 / (1 + np.exp(-b))
        total = np.bincount(doc, np.logaddexp(0, z), n) + plain * np.logaddexp(0, b)
        slope = np.where(y > 0, -1 / np.expm1(np.maximum(total, 1e-6)), 1.0) / n
        gz = slope[doc] * p
        gw = np.bincount(feat, gz[sent], len(w)) + decay * w
        gb = gz.sum() + (slope * plain).sum() * pb
        m1, m2 = 0.9 * m1 + 0.1 * gw, 0.999 * m2 + 0.001 * gw * gw
        mb1, mb2 = 0.9 * mb1 + 0.1 * gb, 0.999 * mb2 + 0.001 * gb * gb
        c1, c2 = 1 - 0.9 ** step, 1 - 0.999 ** step
        w -= rate * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-8)
        b -= rate * (mb1 / c1) / (np.sqrt(mb2 / c2) + 1e-8)
    return Model({f: i for i, f in enumerate(vocabulary)}, w, b)


def sentences(text: str) -> Iterator[set[str]]:
    """Distinct features of each sentence with a word."""
    for m in _SENTENCE.finditer(text):
        words = set(_WORDS.findall(m.group().lower()))
        if words:
            yield {f for x in words for f in names(x)}


def select(sample: DataFrame, max_features: int, min_docs: int) -> list[str]:
    """The features with the largest chi-squared against the label; sample: (y, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            have, hit = Counter(), Counter()
            for y, t in zip(b.column(0).to_pylist(), b.column(1)):
                seen = {f for s in sentences(t.as_py() or "") for f in s}
                have.update(seen)
                if y:
                    hit.update(seen)
            yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.string()), pa.array(list(have.values()), pa.int64()),
                                              pa.array([hit[f] for f in have], pa.int64())], ["f", "c", "a"])

    n, pos = sample.agg(F.count("*"), F.sum("y")).first()
    if not n or not pos or n == pos:
        return []
    counts = (sample.mapInArrow(run, "f string, c long, a long").groupBy("f")
              .agg(F.sum("c").cast("double").alias("c"), F.sum("a").cast("double").alias("a")).where(F.col("c") >= min_docs))
    chi = F.pow(F.col("a") * n - F.col("c") * pos, F.lit(2.0)) / F.greatest(F.col("c") * (n - F.col("c")), F.lit(1.0))
    return [r.f for r in counts.orderBy(chi.desc(), "f").limit(max_features).select("f").collect()]


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_features: int = MAX_FEATURES,
          min_docs: int = MIN_DOCS, **params) -> Model:
    """Fit on documents that have a label and are not held out.

    docs: (doc_id, text); labels: (doc_id, toxic), rows with a null in either are left out, a document with
    several labels counts as toxic if one says so. Without both classes the model is constant.
    """
    known = (labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("_y")))
    n = known.count()
    share = min(1.0, max_docs / max(n, 1))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    sample = land(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(known, "doc_id")
                  .select("doc_id", F.col("_y").alias("y"), "text"), "toxicity-sample")
    vocabulary = select(sample.select("y", "text"), max_features, min_docs)
    place = {f: i for i, f in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags, plain = [], []
            for t in b.column(2):
                ids = [sorted(place[f] for f in s if f in place) for s in sentences(t.as_py() or "")]
                bags.append([x for x in ids if x])
                plain.append(len(ids) - len(bags[-1]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(plain, pa.int32()), pa.array(bags, pa.list_(pa.list_(pa.int32())))],
                ["doc_id", "y", "plain", "bags"])

    # ordered, so that the fit doesn't depend on the order in which tasks end
    got = (sample.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, plain int, bags array<array<int>>")
           .orderBy("doc_id", "plain", "bags").drop("doc_id").toArrow().combine_chunks())
    y, plain = got.column("y").to_numpy(), got.column("plain").to_numpy().astype(float)
    bags = got.column("bags").combine_chunks() if len(got) else pa.array([], pa.list_(pa.list_(pa.int32())))
    per_doc = np.asarray(pc.list_value_length(bags), int)
    inner = bags.flatten()
    per_sentence = np.asarray(pc.list_value_length(inner), int)
    return fit(vocabulary, y, plain, np.repeat(np.arange(len(y)), per_doc), np.repeat(np.arange(len(inner)), per_sentence),
               np.asarray(inner.flatten(), int), **params)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` plus toxicity (0 to 1) and offending (array of start, end, score in code points).

    Null, empty and wordless texts score 0. Columns of those names are replaced, others pass through.
    """
    @F.pandas_udf("score double, offending array<struct<start:int,end:int,score:double>>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            got = [model.score(x) for x in t]
            yield pd.DataFrame({"score": [g[0] for g in got],
                                "offending": [[{"start": s, "end": e, "score": p} for s, e, p in g[1]] for g in got]})

    return (docs.drop("toxicity", "offending").withColumn("_r", run(F.col("text").cast("string")))
            .withColumns({"toxicity": F.col("_r.score"), "offending": F.col("_r.offending")}).drop("_r"))
