"""Soft-max regression by Newton's method: a handful of passes over the rows, however many there are.

The penalty is one over the summed row weights, so of two features that are nearly multiples of each other the
loss is the flatter the more rows there are, and a method that follows gradients needs more passes for more rows.
Newton's steps do not depend on how flat the loss is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import RISK_LABELS
from ..sources.store import cut, discard
from .trees import parts

CLASSES = len(RISK_LABELS)
PAIRS = [(a, b) for a in range(CLASSES) for b in range(a, CLASSES)]
PRECISION = 1e-15  # of the mean loss: what another step would still gain
MOST_STEPS = 1000


def scaled(rows: DataFrame, mean: np.ndarray, std: np.ndarray) -> DataFrame:
    """(label, weight, z): values around their mean in standard deviations, 0 where there is none, stored as bytes."""
    by = np.where(std > 0, std, np.inf)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(mean))
            z = np.ascontiguousarray((x - mean) / by)
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("weight"), parts(z.reshape(-1), np.arange(batch.num_rows) * len(mean))],
                names=["label", "weight", "z"])

    slim = rows.select(F.col("label").cast("int").alias("label"), "weight", vector_to_array("features").alias("v"))
    return cut(slim.mapInArrow(coded, "label int, weight double, z binary"), "scaled-rows")


def values_of(rows: pa.Array, features: int) -> np.ndarray:
    """Values by row and feature, and a last column of ones for the constant."""
    ends = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset: rows.offset + len(rows) + 1]
    out = np.ones((len(rows), features + 1))
    out[:, :features] = np.frombuffer(rows.buffers()[2], np.uint8)[ends[0]: ends[-1]].view(np.float64).reshape(len(rows), features)
    return out


def sums_at(work: DataFrame, at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and second derivatives at the weights ``at`` (class, feature), without the penalty.

    Tasks sum their rows; the sums meet by place: as many as the model has pairs of weights, whatever the rows.
    """
    size = at.shape[1]
    places = 1 + CLASSES * size + len(PAIRS) * size * size

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, slope, bend = 0.0, np.zeros((CLASSES, size)), np.zeros((len(PAIRS), size, size))
        for batch in batches:
            if not batch.num_rows:
                continue
            z, w = values_of(batch.column("z"), size - 1), batch.column("weight").to_numpy()
            hit = np.eye(CLASSES)[batch.column("label").to_numpy()]
            margin = z @ at.T
            margin -= margin.max(axis=1, keepdims=True)
            p = np.exp(margin)
            total = p.sum(axis=1, keepdims=True)
            p /= total
            loss += float(w @ (np.log(total[:, 0]) - (margin * hit).sum(axis=1)))
            slope += (w[:, None] * (p - hit)).T @ z
            for i, (a, b) in enumerate(PAIRS):
                bend[i] += (z * (w * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ z
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(places), pa.int32()), pa.array(np.concatenate([[loss], slope.reshape(-1), bend.reshape(-1)]))],
            names=["place", "value"])

    found = work.mapInArrow(summed, "place int, value double").groupBy("place").agg(
        F.sum("value").alias("value")).orderBy("place").toArrow().column("value").to_numpy()
    slope, bend = found[1: 1 + CLASSES * size], found[1 + CLASSES * size:].reshape(-1, size, size)
    second = np.zeros((CLASSES, size, CLASSES, size))
    for i, (a, b) in enumerate(PAIRS):
        second[a, :, b, :] = second[b, :, a, :] = bend[i]
    return found[0], slope, second.reshape(CLASSES * size, CLASSES * size)


def fit(rows: DataFrame) -> list[tuple[int, int, float]]:
    """(class, feature, weight) on raw values, feature -1 being the constant, of rows (label, weight, features).

    The loss is the weighted log loss and half the sum of squared weights on scaled values; constants are
    free and sum to 0. A step that does not lower the loss is halved. Fails where the minimum is not reached.
    """
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(rows)
    mean, std = scaler.mean.toArray(), scaler.std.toArray()
    work, size = scaled(rows, mean, std), len(mean) + 1
    everything = rows.agg(F.sum("weight")).first()[0]
    free = np.tile(np.arange(size) == size - 1, CLASSES)
    # constants that all move alike change nothing: a wall across that direction
    wall = everything * np.outer(free, free)
    best, low, here = np.zeros(CLASSES * size), np.inf, np.zeros(CLASSES * size)
    for _ in range(MOST_STEPS):
        loss, slope, second = sums_at(work, here.reshape(CLASSES, size))
        bound = np.where(free, 0.0, here)
        loss += bound @ bound / 2
        if loss > low + 1e-12 * abs(low):
            here = (here + best) / 2
            continue
        best, low, slope = here, loss, slope + bound
        step = np.linalg.solve(second + np.diag(np.where(free, 0.0, 1.0)) + wall, -slope)
        here = best + step
        if not -slope @ step > PRECISION * everything:
            break
    else:
        raise ValueError(f"logistic regression: no minimum after {MOST_STEPS} steps")
    discard(work)
    return raw_rows(here.reshape(CLASSES, size), mean, std)


def raw_rows(weights: np.ndarray, mean: np.ndarray, std: np.ndarray) -> list[tuple[int, int, float]]:
    """Scaling is folded into weights and constants."""
    raw = np.where(std > 0, weights[:, :-1] / np.where(std > 0, std, 1.0), 0.0)
    out = []
    for c, row in enumerate(raw):
        out.append((c, -1, float(weights[c, -1] - row @ mean)))
        out += [(c, i, float(w)) for i, w in enumerate(row)]
    return out
