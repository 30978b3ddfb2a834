"""Whitening of embeddings along their principal components.

Three passes over the vectors, each of which gives partial sums that Spark adds: exact totals of
the distinct vectors, their covariance centred before multiplying, and the covariance of the
whitened ones as a check. The components of the small covariance come from :mod:`contour`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import contour
from .clustering import finite
from .scratch import cut, drop

SHIFT = 1_000_000
SCALE = 64
FAR = 2 ** 61  # entries are held within this, so that they stay longs
FLAT = 1e-12  # an eigenvalue below this share of the largest counts as zero


def _longs(vectors: pa.Array, dims: int) -> np.ndarray:
    """floor(64 * c) + 1,000,000 as longs, a row per vector."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * flat), -FAR, FAR).astype(np.int64).reshape(-1, dims) + SHIFT


def _packed(x: np.ndarray) -> list[bytes]:
    """Rows in the narrowest of four widths that holds them: equal rows, and no others, give equal bytes."""
    y = x - SHIFT
    size = np.abs(y).max(axis=1, initial=0)
    out: list[bytes] = [b""] * len(y)
    lower = -1
    for kind, upper in (("<i1", 127), ("<i2", 2 ** 15 - 1), ("<i4", 2 ** 31 - 1), ("<i8", 2 ** 63 - 1)):
        for i in np.flatnonzero((size > lower) & (size <= upper)).tolist():
            out[i] = y[i].astype(kind).tobytes()
        lower = upper
    return out


def _unpacked(rows: pa.Array, dims: int) -> np.ndarray:
    out = np.empty((len(rows), dims), np.int64)
    if not len(rows):
        return out
    sizes = np.diff(np.frombuffer(rows.buffers()[1], np.int32)[rows.offset: rows.offset + len(rows) + 1])
    for kind in ("<i1", "<i2", "<i4", "<i8"):
        mine = np.flatnonzero(sizes == dims * int(kind[2]))
        if len(mine):
            data = b"".join(rows.take(pa.array(mine)).to_pylist())
            out[mine] = np.frombuffer(data, kind).reshape(-1, dims)
    return out + SHIFT


def _summed(fit: DataFrame, dims: int, width: int, values: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all vectors of v v', v being ``values`` of them: a task gives its cells once, Spark adds the tasks'."""
    upper = np.triu_indices(width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            v = values(_unpacked(batch.column("x"), dims))
            total += v.T @ v
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(upper[0])), pa.int32()), pa.array(total[upper])], names=["cell", "part"])

    rows = fit.mapInArrow(partial, "cell int, part double").groupBy("cell").agg(F.sum("part").alias("part")).collect()
    out = np.zeros((width, width))
    for r in rows:  # width * (width + 1) / 2 of them
        i, j = upper[0][r.cell], upper[1][r.cell]
        out[i, j] = out[j, i] = r.part
    return out


def _totals(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums per dimension."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dims
        for batch in batches:
            x = _unpacked(batch.column("x"), dims)
            n += len(x)
            wide = len(x) and int(np.abs(x).max()) > 2 ** 40
            part = [sum(map(int, c)) for c in x.T] if wide else x.sum(axis=0).tolist()
            sums = [a + b for a, b in zip(sums, part)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dims), pa.int32()), pa.array(list(map(str, sums)), pa.string()), pa.array([n] * dims, pa.int64())],
            names=["dim", "part", "n"])

    # 38 digits hold the sum of 10^19 longs
    rows = fit.mapInArrow(partial, "dim int, part string, n long").groupBy("dim").agg(
        F.sum(F.col("part").cast("decimal(38, 0)")).alias("total"), F.sum("n").alias("n")).collect()
    sums = {r.dim: int(r.total) for r in rows}
    return (rows[0].n if rows else 0), [sums.get(d, 0) for d in range(dims)]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2; exact; null beyond a long."""
    means = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)  # n * x - S = n * (x - mean) - rest
    away = x - means
    most = int(np.abs(away).max(initial=0))
    if (n * (most + 1)) ** 2 * max(len(sums), 1) < 2 ** 63:
        part = n * away - rest
        return (part * part).sum(axis=1).tolist()
    out = []
    for row in x:
        value = sum((n * int(v) - s) ** 2 for v, s in zip(row, sums))
        out.append(value if value < 2 ** 63 else None)
    return out


def commonest_length(rows: DataFrame, vector: Column) -> int | None:
    found = rows.groupBy(F.size(vector).alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    return found.d if found else None


def whiten(vectors: DataFrame, most: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per kept row and component.

    Rows of ``vectors(vec_id, embedding, ...)`` are kept whose vector is neither null nor holds
    an entry that is null or not finite. Where lengths differ, vectors of the commonest length
    count (the greater among equals) and the others are left out, empty ones too. Components with
    an eigenvalue of zero, as of fewer distinct vectors than dimensions, cannot be scaled and
    are not given: at most ``most`` are. A deviation beyond a long is null; entries beyond 2^61 are
    held at it. Repeated rows, null ids and other columns change nothing else; a table without
    such vectors gives no rows.
    """
    slim = vectors.select("vec_id", "embedding").where(finite(F.col("embedding")))
    kind = slim.schema["vec_id"].dataType.simpleString()
    dims = commonest_length(slim, F.col("embedding"))
    kept = slim.where(F.size("embedding") == (dims or -1))
    shape = f"vec_id {kind}, deviation long, parts array<double>"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _packed(_longs(batch.column("embedding"), dims))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["x"])

    values = np.empty(0)
    if dims:
        # distinct vectors move once, a byte or two an entry; copies collapse before the exchange
        fit = cut(kept.select("embedding").mapInArrow(packed, "x binary").distinct(), "fit-list")
        n, sums = _totals(fit, dims)
        mean = np.array([s // n for s in sums], np.int64)
        rest = np.array([s % n / n for s in sums])

        def centred(x: np.ndarray) -> np.ndarray:
            return (x - mean).astype(np.float64) - rest

        covariance = _summed(fit, dims, dims, centred) / n
        trace = float(np.trace(covariance))
        values, components = contour.leading(covariance, most)
        real = values > FLAT * max(float(values[0]), 0.0)
        values, components = values[real], components[:, real]
    if not len(values):
        return kept.limit(0).select(
            "vec_id", F.lit(1).alias("component"), *[F.lit(0).cast("long").alias(c) for c in ("n", "deviation")],
            *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")])
    turned = components / np.sqrt(values)
    seen = _summed(fit, dims, len(values), lambda x: centred(x) @ turned) / n
    error = float(np.abs(seen - np.eye(len(values))).max())
    drop(fit)

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _longs(batch.column("embedding"), dims)
            parts = centred(x) @ turned
            ends = pa.array(np.arange(len(x) + 1) * parts.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(_deviations(x, n, sums), pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(parts.reshape(-1)))], names=["vec_id", "deviation", "parts"])

    shares = F.array(*[F.lit(float(v / trace)) for v in values])
    return kept.mapInArrow(whitened, shape).select(
        "vec_id", "deviation", F.posexplode("parts").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
