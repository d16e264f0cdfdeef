"""Language identification with a byte convolutional network written in numpy.

Texts are cut into fixed windows of `WINDOW` bytes (the last one padded), ASCII letters lowered. A window passes
through a byte embedding, filters of several widths, the maximum over positions, and a softmax. A document's
prediction joins the log-probabilities of all its windows, weighted by their length.

Training uses a bounded sample: `MAX_DOCS` documents in expectation, shared equally among the languages and
chosen by a hash of doc_id, three windows of each. Prediction covers every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
MAX_DOCS = 4_000
WINDOWS_PER_DOC = 3
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = 192


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Network:
    """embedding (256, e), filters (width_max * e, widths * filters) zero-padded to the widest, output layer."""

    def __init__(self, langs: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.langs = langs
        span = max(WIDTHS)
        self.e = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.e[0] = 0
        self.mask = np.concatenate([np.repeat(np.arange(span) < w, EMBEDDING)[:, None] * np.ones(FILTERS)
                                    for w in WIDTHS], axis=1).astype(np.float32)
        self.k = (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.kb = np.zeros(self.k.shape[1], np.float32)
        self.o = rng.normal(0, 0.1, (self.k.shape[1], len(langs))).astype(np.float32)
        self.ob = np.zeros(len(langs), np.float32)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter outputs (windows, positions, filters) and the patches they were made from."""
        n, length = x.shape
        span = max(WIDTHS)
        emb = self.e[x].reshape(n, length * EMBEDDING)
        view = np.lib.stride_tricks.sliding_window_view(emb, span * EMBEDDING, axis=1)[:, ::EMBEDDING]
        patches = np.ascontiguousarray(view)
        return patches, (patches.reshape(-1, span * EMBEDDING) @ self.k).reshape(n, -1, self.k.shape[1])

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.langs)), np.float32)
        for lo in range(0, len(x), _STEP):
            h = np.maximum(self.pooled(x[lo:lo + _STEP])[1].max(axis=1) + self.kb, 0)
            z = h @ self.o + self.ob
            z -= z.max(axis=1, keepdims=True)
            out[lo:lo + _STEP] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 3e-3, seed: int = 0):
        rng = np.random.default_rng(seed)
        params = [self.e, self.k, self.kb, self.o, self.ob]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        span, step = max(WIDTHS), 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                b = order[lo:lo + batch]
                patches, c = self.pooled(x[b])
                at = c.argmax(axis=1)
                top = np.take_along_axis(c, at[:, None], 1)[:, 0] + self.kb
                h = np.maximum(top, 0)
                z = h @ self.o + self.ob
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(b)), y[b]] -= 1
                p /= len(b)
                gh = (p @ self.o.T) * (top > 0)
                rows = np.take_along_axis(patches, at[:, :, None], 1)  # (batch, filters, span * embedding)
                gk = np.einsum("bfi,bf->if", rows, gh) * self.mask
                gpatch = gh[:, :, None] * self.k.T[None]
                bytes_ = x[b][np.arange(len(b))[:, None, None], at[:, :, None] + np.arange(span)]
                where = (bytes_[..., None].astype(np.int64) * EMBEDDING + np.arange(EMBEDDING)).ravel()
                ge = np.bincount(where, gpatch.ravel(), 256 * EMBEDDING).reshape(256, EMBEDDING)
                ge[0] = 0
                step += 1
                for i, g in enumerate((ge, gk, gh.sum(axis=0), h.T @ p, p.sum(axis=0))):
                    m[i] += 0.1 * (g - m[i])
                    v[i] += 0.001 * (g * g - v[i])
                    params[i] -= (rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(windows, bytes in each) of a text that isn't empty."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    n = -(-len(raw) // WINDOW)
    x = np.zeros(n * WINDOW, np.uint8)
    x[:len(raw)] = raw
    size = np.full(n, WINDOW)
    size[-1] = len(raw) - (n - 1) * WINDOW
    return x.reshape(n, WINDOW), size


def train(docs: DataFrame, max_docs: int = MAX_DOCS) -> Network | None:
    """Fit on the text and lang of documents that are not held out; None if none has both and a letter."""
    known = docs.where("lang is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).where(
        F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", F.col("text").cast("string").alias("text"))
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    langs = sorted(counts)
    share = F.create_map(*[F.lit(v) for k in langs for v in (k, int(min(1.0, max_docs / len(langs) / counts[k]) * (1 << 20)) + 1)])
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")])
    size = F.length("text")
    at = F.array(*[F.greatest(F.lit(0), F.floor(size * (2 * i + 1) / (2 * WINDOWS_PER_DOC)) - WINDOW // 2).cast("int")
                   for i in range(WINDOWS_PER_DOC)])
    parts = F.array_distinct(F.transform(at, lambda a: F.substr(F.col("text"), a + 1, F.lit(WINDOW))))
    rows = sample.select("doc_id", "lang", F.explode(parts).alias("part")).where("part != ''").orderBy(
        "doc_id", "lang", "part").select("lang", "part").toPandas()
    x = np.concatenate([windows(p)[0][:1] for p in rows["part"]])
    y = rows["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy()
    net = Network(langs)
    net.train(x, y)
    return net


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """`docs` plus lang_pred and lang_score (the predicted language's probability).

    Null texts and texts without a letter are `und` with score 0, as is everything if no language was learnt.
    Columns of those names are replaced, others pass through.
    """
    @F.pandas_udf("lang string, score double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            lang, score = ["und"] * len(t), [0.0] * len(t)
            group, weight = [], 0
            for i, text in enumerate(t):
                if net is None or not text or not any(map(str.isalpha, text)):
                    continue
                x, size = windows(text)
                group.append((i, x, size))
                weight += len(x)
                if weight >= 1024:
                    _settle(net, group, lang, score)
                    group, weight = [], 0
            if group:
                _settle(net, group, lang, score)
            yield pd.DataFrame({"lang": lang, "score": score})

    return (docs.drop("lang_pred", "lang_score").withColumn("_r", run(F.col("text").cast("string")))
            .withColumns({"lang_pred": F.col("_r.lang"), "lang_score": F.col("_r.score")}).drop("_r"))


def _settle(net: Network, group: list, lang: list[str], score: list[float]) -> None:
    """Predictions of a group of texts, put in their places."""
    logp = net.log_probabilities(np.concatenate([x for _, x, _ in group]))
    at = 0
    for i, x, size in group:
        mean = np.average(logp[at:at + len(x)], axis=0, weights=size).astype(float)
        at += len(x)
        p = np.exp(mean - mean.max())
        best = int(p.argmax())
        lang[i], score[i] = net.langs[best], float(p[best] / p.sum())
