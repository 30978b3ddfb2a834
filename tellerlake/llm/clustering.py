"""Centroid clustering of integer vectors, each assigned by a tournament of bisectors.

For every pair of centroids the normal and threshold of the plane between them are computed
once. A vector passes k - 1 sign tests: the winner so far against the next centroid; zero, a
tie, leaves the smaller number in front. Only the distance to the last winner is computed.
All arithmetic is exact: in doubles where every sum stays below 2^53, else in whole numbers of
any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cut

SAFE = 1 << 19  # components up to this size: all sums below are exact in doubles for 64 of them
MOST = (1 << 63) - 1  # distances beyond a long are given as the largest long


def finite(vector: Column) -> Column:
    """True where a vector and all its entries are present and finite."""
    as_double = lambda e: e.cast("double")
    bad = F.exists(vector, lambda e: e.isNull() | F.isnan(as_double(e)) | (F.abs(as_double(e)) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def integers(batch: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of all vectors as rows; whole doubles, however large."""
    flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * flat)
    # where a double cannot hold the product, the entry itself stands for it
    return np.where(np.isfinite(scaled), scaled, flat).reshape(-1, dims)


class Tournament:
    """Normals and thresholds of all pairs of centroids."""

    def __init__(self, centroids: Sequence[Sequence[int]]) -> None:
        self.centroids = [list(map(int, c)) for c in centroids]
        self.dims = len(self.centroids[0]) if self.centroids else 0
        self.small = all(abs(v) <= SAFE for c in self.centroids for v in c) and self.dims <= 64
        if self.small:
            c = np.array(self.centroids, np.float64).reshape(-1, self.dims)
            square = (c * c).sum(axis=1)
            self.table = c
            self.normals = c[None, :, :] - c[:, None, :]  # [i, j]: from i towards j
            self.thresholds = (square[None, :] - square[:, None]) / 2  # halves are exact

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, list[int] | np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row of whole doubles."""
        plain = np.abs(x).max(axis=1, initial=0) <= SAFE if self.small else np.zeros(len(x), bool)
        numbers, distances = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        rows = x[plain]
        front = np.zeros(len(rows), np.int64)
        for j in range(1, len(self.centroids) if len(rows) else 0):
            side = np.einsum("nd,nd->n", self.normals[front, j], rows) - self.thresholds[front, j]
            front = np.where(side > 0, j, front)
        numbers[plain] = front
        if len(rows):
            away = rows - self.table[front]
            distances[plain] = np.einsum("nd,nd->n", away, away).astype(np.int64)
        for i in np.flatnonzero(~plain):  # few if any: whole numbers of any size
            numbers[i], distances[i] = self._assign_one([int(v) for v in x[i]])
        return numbers, distances

    def _assign_one(self, x: list[int]) -> tuple[int, int]:
        front = 0
        for j in range(1, len(self.centroids)):
            a, b = self.centroids[front], self.centroids[j]
            if sum(2 * (q - p) * v - q * q + p * p for p, q, v in zip(a, b, x)) > 0:
                front = j
        return front, min(sum((v - p) ** 2 for p, v in zip(self.centroids[front], x)), MOST)


def _seeds(kept: DataFrame, k: int, scale: int) -> list[list[int]]:
    """The k vectors of least hash, in order of the hash; equal ids in order of their entries."""
    rows = kept.select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h"), "embedding").where(
        "h IS NOT NULL").orderBy("h", "embedding").limit(k)
    vectors = [[float(v) for v in r.embedding] for r in rows.collect()]  # k rows
    return [[int(np.floor(scale * v)) if np.isfinite(scale * v) else int(v) for v in x] for x in vectors]


def _moved(kept: DataFrame, centroids: list[list[int]], dims: int, scale: int) -> list[list[int]]:
    """Centroids replaced by the floored means of their vectors; empty ones stay."""
    play = Tournament(centroids)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [[0] * dims for _ in centroids]
        counts = [0] * len(centroids)
        for batch in batches:
            x = integers(batch.column("embedding"), dims, scale)
            numbers, _ = play.assign(x)
            for c in np.unique(numbers).tolist():
                mine = x[numbers == c]
                counts[c] += len(mine)
                if np.abs(mine).max(initial=0) <= SAFE:
                    part = mine.sum(axis=0).astype(np.int64).tolist()  # below 2^53 for a batch
                else:
                    part = [sum(int(v) for v in column) for column in mine.T]
                totals[c] = [a + b for a, b in zip(totals[c], part)]
        rows = [(c, d, str(totals[c][d]), counts[c]) for c in range(len(centroids)) if counts[c] for d in range(dims)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
             pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int64())],
            names=["cluster", "dim", "part", "n"])

    # a task gives k * dims partial sums, only their totals come to the driver; totals of more than 38 digits are
    # added there, from one number a task
    parts = kept.mapInArrow(summed, "cluster int, dim int, part string, n long")
    totals = parts.groupBy("cluster", "dim").agg(
        F.try_sum(F.expr("try_cast(part AS decimal(38, 0))")).alias("total"), F.sum("n").alias("n"),
        F.count_if(F.expr("try_cast(part AS decimal(38, 0)) IS NULL")).alias("large"))
    found = totals.collect()
    out = [list(c) for c in centroids]
    for r in found:
        total = r.total
        if r.large or total is None:
            total = sum(int(x.part) for x in parts.where(
                (F.col("cluster") == r.cluster) & (F.col("dim") == r.dim)).select("part").toLocalIterator())
        out[r.cluster][r.dim] = int(total) // r.n
    return out


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per kept row.

    Kept are rows of ``vectors(vec_id, embedding, ...)`` whose vector has exactly ``dims``
    entries, none null or not finite. Fewer than ``k`` rows start with as many centroids; rows
    with a null id are assigned but start none; a table without any id gives no rows. Equal rows
    give equal results, centroids that coincide leave all their vectors to the smaller number.
    Distances and inertias beyond a long are given as the largest long. Other columns are ignored.
    """
    kept = vectors.select("vec_id", "embedding").where((F.size("embedding") == dims) & finite(F.col("embedding")))
    centroids = _seeds(kept, k, scale)
    kind = kept.schema["vec_id"].dataType.simpleString()
    if not centroids:
        return kept.limit(0).select(
            "vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
            F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        centroids = _moved(kept, centroids, dims, scale)
    play = Tournament(centroids)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, distances = play.assign(integers(batch.column("embedding"), dims, scale))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(numbers, pa.int32()), pa.array(distances, pa.int64())],
                names=["vec_id", "cluster", "distance"])

    # ids, numbers and distances are stored: totals and rows must come from one and the same pass
    rows = cut(kept.mapInArrow(assigned, f"vec_id {kind}, cluster int, distance long"), "assigned")
    sums = {r.cluster: int(r.total) for r in rows.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38, 0)")).alias("total")).collect()}  # k rows
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    within = F.array(*[F.lit(min(sums.get(c, 0), MOST)).cast("long") for c in range(len(centroids))])
    return rows.select(
        "vec_id", "cluster", "distance", F.get(within, F.col("cluster")).alias("cluster_inertia"),
        F.lit(min(sum(sums.values()), MOST)).cast("long").alias("inertia"),
        F.get(F.array(*map(F.lit, names)), F.col("cluster")).alias("centroid_sha256"))


def statement(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> str:
    """The same in SQL, by plain distances to all centroids."""
    distance = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"

    def nearest(n: int) -> str:
        return f"""near{n} AS MATERIALIZED (SELECT pos, arg_min(num, d * {k} + num) AS num, min(d) AS d FROM (
            SELECT pos, num, CAST({distance} AS BIGINT) AS d FROM v, cent{n}) GROUP BY pos)"""
    steps = []
    for n in range(rounds):
        steps.append(nearest(n))
        steps.append(f"""sums{n} AS (SELECT num, dim, CAST(sum(CAST(part AS HUGEINT)) AS HUGEINT) AS s, count(*) AS m FROM (
            SELECT num, unnest(x) AS part, unnest(range(1, {dims + 1})) AS dim FROM v JOIN near{n} USING (pos)) GROUP BY num, dim)""")
        steps.append(f"""cent{n + 1} AS MATERIALIZED (SELECT num, coalesce(moved, c) AS c FROM cent{n} LEFT JOIN (
            SELECT num, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY dim) AS moved FROM sums{n} GROUP BY num) USING (num))""")
    steps.append(nearest(rounds))
    return f"""WITH kept AS (SELECT vec_id, embedding, row_number() OVER () AS pos FROM embeddings
          WHERE len(embedding) = {dims} AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e)))),
        v AS MATERIALIZED (SELECT vec_id, pos, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
          FROM kept),
        cent0 AS MATERIALIZED (SELECT num, x AS c FROM v JOIN (SELECT pos, row_number() OVER (ORDER BY h, embedding) - 1 AS num FROM (
          SELECT pos, sha256('1:' || vec_id) AS h, embedding FROM kept WHERE vec_id IS NOT NULL)) USING (pos) WHERE num < {k}),
        {', '.join(steps)}
        SELECT vec_id, CAST(num AS INTEGER) AS cluster, d AS distance,
          CAST(sum(d) OVER (PARTITION BY num) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
          sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM v JOIN near{rounds} USING (pos) JOIN cent{rounds} USING (num)"""
