"""Bisector tournament against plain distances, and on odd vectors."""

import hashlib
import math

import numpy as np
import pytest
from conftest import SMALL

from tellerlake.llm import catalog, clustering


def by_force(rows, k=16, rounds=3, dims=64, scale=64):
    kept = [(i, [math.floor(scale * float(v)) for v in x]) for i, x in rows
            if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    centroids = [x for _, x in named[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda x: min(range(len(centroids)), key=lambda c: (far(x, centroids[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(near(x), []).append(x)
        for c, members in groups.items():
            centroids[c] = [sum(column) // len(members) for column in zip(*members)]
    found = [(i, near(x), far(x, centroids[near(x)])) for i, x in kept]
    total = {c: sum(d for _, g, d in found if g == c) for c in range(len(centroids))}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, total[c], sum(total.values()), names[c]) for i, c, d in found), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_given_vectors(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert rows_of(catalog.op13_bisector_clusters(spark, SMALL)) == by_force(rows)


@pytest.fixture(scope="module")
def odd_vectors():
    a, b = [0.25, -0.5, 1.0], [2.0, 0.125, -3.0]
    return [(1, a), (2, b), (2, b), (3, [v + w for v, w in zip(a, b)]), (None, a), (4, None), (5, [0.1, None, 0.2]),
            (6, [0.1, float("nan"), 0.2]), (7, [float("inf"), 0.0, 0.0]), (8, [0.0, 0.0]), (9, []), (10, [-v for v in a]),
            (11, [0.0, 0.0, 0.0]), (12, [1e12, -1e12, 3.0]), (13, [1e11, 7.0, -1e12])] + [(20 + i, a) for i in range(30)]


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, x, 3, "c", -1) for i, x in rows],
                                 f"vec_id long, embedding array<{kind}>, cluster int, centroid_sha256 string, distance long")


@pytest.mark.parametrize("k", [1, 2, 3, 16, 60])
def test_odd_vectors(spark, odd_vectors, k):
    """Ties, copies, vectors beyond exact doubles and fewer rows than centroids."""
    found = rows_of(clustering.clusters(frame(spark, odd_vectors), k, 3, 3))
    most = clustering.MOST
    want = [(i, c, min(d, most), min(t, most), min(s, most), n) for i, c, d, t, s, n in by_force(odd_vectors, k, 3, 3)]
    assert [r[:3] + r[5:] for r in found] == [r[:3] + r[5:] for r in want]
    if max(r[2] for r in want) < most:
        assert found == want


def test_huge_entries_do_not_crash(spark):
    rows = [(1, [1e300, 1.0]), (2, [-1e300, 5.0]), (3, [0.0, 0.0]), (4, [1.7e308, 0.0])]
    found = rows_of(clustering.clusters(frame(spark, rows), 2, 3, 2))
    assert len(found) == 4 and all(0 <= r[2] <= clustering.MOST for r in found)


def test_no_vectors(spark, odd_vectors):
    for rows in ([], [r for r in odd_vectors if r[0] is None or r[1] is None]):
        found = clustering.clusters(frame(spark, rows), 16, 3, 3)
        assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert found.count() == 0


def test_tournament_is_exact_on_ties():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-3, 3, (12, 4)).tolist()
    x = rng.integers(-3, 3, (500, 4)).astype(float)
    numbers, distances = clustering.Tournament(centroids).assign(x)
    far = ((x[:, None, :] - np.array(centroids)[None]) ** 2).sum(axis=2)
    assert (numbers == far.argmin(axis=1)).all() and (distances == far.min(axis=1)).all()
