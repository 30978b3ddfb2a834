"""Hashed n-gram features and logistic models trained in shards on a bounded sample."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import WordHashes, words

SHARDS = 4
Features = tuple[np.ndarray, np.ndarray]  # ascending distinct indices, values


def counted(hashes: np.ndarray, bits: int, scale: float) -> Features:
    """Sparse vector of hashed items: their shares times ``scale``."""
    index, times = np.unique(hashes >> np.uint64(64 - bits), return_counts=True)
    return index.astype(np.int64), scale * times / max(len(hashes), 1)


def dot_counted(model: np.ndarray, hashes: np.ndarray, bits: int, scale: float) -> float:
    """Dot product of ``model`` with :func:`counted`, without building the vector."""
    return scale * float(model[hashes >> np.uint64(64 - bits)].mean(dtype=np.float64)) if len(hashes) else 0.0


def word_grams(text: str | None, known: WordHashes) -> np.ndarray:
    """64-bit hashes of all words and pairs of neighbouring words of a whole text, A-Z lowered.

    A pair of equal words counts as one and the same item, whatever the word.
    """
    h = np.array([known[w] for w in words(text)], np.uint64)
    if not len(h):
        return h
    a, b = h[:-1], h[1:]
    pairs = np.where(a == b, np.uint64(0x5851F42D4C957F2D), a * np.uint64(0x9E3779B97F4A7C15) ^ (b >> np.uint64(7)) ^ b)
    items = np.concatenate([h, pairs * np.uint64(0xBF58476D1CE4E5B9)])
    items ^= items >> np.uint64(29)
    return items * np.uint64(0x94D049BB133111EB)


def char_grams(text: str | None, size: int = 3) -> np.ndarray:
    """64-bit hashes of all ``size``-character runs of a whole text."""
    if not text:
        return np.empty(0, np.uint64)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = min(size, len(c))
    h = np.zeros(len(c) - n + 1, np.uint64)
    for k in range(n):
        h = (h + c[k: len(c) - n + 1 + k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def ftrl(rows: list[tuple[Features, int]], size: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0,
         l1: float = 1e-4, l2: float = 1e-3) -> np.ndarray:
    """Follow-the-regularised-leader, proximal form, per coordinate; the last weight is the bias."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(z[i]) <= l1, 0.0, w)

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            (index, value), y = rows[k]
            i, x = np.append(index, size), np.append(value, 1.0)
            w = weights(i)
            g = (sigmoid(w @ x) - y) * x
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - step * w
            n[i] += g * g
    return weights(np.arange(size + 1))


def adagrad(rows: list[tuple[Features, int]], size: int, epochs: int = 6, rate: float = 0.5,
            decay: float = 1e-6) -> np.ndarray:
    """Logistic regression by per-coordinate gradient steps; the last weight is the bias."""
    w, n = np.zeros(size + 1), np.full(size + 1, 1e-2)
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            (index, value), y = rows[k]
            i, x = np.append(index, size), np.append(value, 1.0)
            g = (sigmoid(w[i] @ x) - y) * x + decay * w[i]
            n[i] += g * g
            w[i] -= rate * g / np.sqrt(n[i])
    return w


def fit(sampled: DataFrame, features: Callable[[str, WordHashes], Features], size: int,
        train: Callable[..., np.ndarray], shards: int = SHARDS) -> np.ndarray:
    """Mean of the models fitted on ``shards`` parts of a bounded sample.

    Parts are dealt by hash of the id and fitted one by one, in order of the id, so the model
    does not depend on how many tasks hold them. No labelled row at all gives a model of
    zeros, whose scores are all one half.
    """
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts = WordHashes(), {}
        for batch in batches:
            names = ("shard", "doc_id", "text", "y")
            for shard, _, text, y in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                parts.setdefault(shard, []).append((features(text, known), y))
        for shard, rows in parts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([train(rows, size).astype(np.float32).tobytes()], pa.binary()),
                 pa.array([len(rows)], pa.int64())], names=["shard", "model", "rows"])

    dealt = sampled.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).cast("long")).repartition(
        shards, "shard").sortWithinPartitions("shard", "doc_id", "text", "y")
    found = dealt.mapInArrow(one, "shard long, model binary, rows long").collect()  # ``shards`` rows of ``size`` numbers
    if not found:
        return np.zeros(size + 1, np.float32)
    found.sort(key=lambda r: r.shard)
    weight = np.array([r.rows for r in found], float)
    return (np.stack([np.frombuffer(r.model, np.float32) for r in found]) * (weight / weight.sum())[:, None]
            ).sum(axis=0).astype(np.float32)
