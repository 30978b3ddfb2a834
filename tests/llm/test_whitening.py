"""Contour integration against a dense solver, whitening against brute force."""

import math

import numpy as np
import pytest
from conftest import SMALL

from tellerlake.llm import catalog, contour, whitening


def turned(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return q @ np.diag(values) @ q.T


MATRICES = {
    "random": np.cov(np.random.default_rng(1).standard_normal((64, 500))),
    "of few rows": np.cov(np.random.default_rng(2).standard_normal((40, 6))),
    "identity": np.eye(20), "zero": np.zeros((4, 4)), "one": np.array([[2.0]]),
    "repeated": np.diag([3.0, 3, 3, 2, 2, 1, 1, 1, 1]),
    "cut within equals": turned(np.r_[np.full(30, 1.0), np.full(34, 0.5)]),
    "close": turned(1 + 1e-9 * np.arange(64)), "closer": turned(1 + 1e-13 * np.arange(64)),
    "steep": turned(10.0 ** -np.arange(64)), "large": 1e200 * np.cov(np.random.default_rng(3).standard_normal((30, 90))),
    "indefinite": turned(np.linspace(-5, 3, 30)),
}


@pytest.mark.parametrize("name", MATRICES)
def test_leading_pairs(name):
    a = MATRICES[name]
    values, vectors = contour.leading(a, 16)
    scale = max(np.abs(a).max(), 1e-300)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:16]).max() <= 1e-13 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    assert np.abs(a / scale @ vectors - vectors * (values / scale)).max() < 1e-13


@pytest.mark.parametrize("name", ["random", "repeated", "indefinite", "steep"])
def test_inertia(name):
    values = np.linalg.eigvalsh(MATRICES[name])
    for shift in (values[:-1] + values[1:])[values[1:] - values[:-1] > 1e-6] / 2:
        assert contour.above(MATRICES[name], shift) == (values > shift).sum()


def by_force(rows, most=16):
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), float)
    n, sums = len(fit), [sum(int(v) for v in c) for c in fit.T]
    centred = fit - np.array(sums) / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    out = {}
    for i, x in kept:
        deviation = sum((n * v - s) ** 2 for v, s in zip(x, sums))
        out.setdefault(i, (deviation, (np.array(x) - np.array(sums) / n) @ vectors / np.sqrt(values)))
    return n, out, values / np.trace(covariance), len(kept)


def test_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    n, want, shares, kept = by_force(rows)
    found = catalog.op12_whitening(spark, SMALL).collect()
    assert len(found) == 16 * kept and {r.n for r in found} == {n}
    signs = {}
    for r in found:
        deviation, parts = want[r.vec_id]
        assert r.deviation == deviation
        assert r.explained == pytest.approx(shares[r.component - 1], rel=1e-9)
        assert abs(r.whitened) == pytest.approx(abs(parts[r.component - 1]), abs=1e-8)
        if abs(r.whitened) > 1e-6:
            signs.setdefault(r.component, set()).add(np.sign(r.whitened * parts[r.component - 1]))
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-10
    assert all(len(s) == 1 for s in signs.values())


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 3, "c", -1.0) for i, x in rows],
                                 "vec_id long, embedding array<double>, n int, component string, whitened double")


def test_odd_vectors(spark):
    rng = np.random.default_rng(4)
    good = [(i, [float(v) for v in rng.standard_normal(3)]) for i in range(40)]
    rows = good + good[:7] * 5 + [(None, good[0][1]), (50, None), (51, [0.1, None, 0.2]), (52, [0.1, float("nan"), 0.2]),
                                  (53, [float("inf"), 0.0, 0.0]), (54, []), (55, [1.0, 2.0]), (56, [200.0, -4e4, 1e3])]
    found = whitening.whiten(frame(spark, rows)).collect()
    n, want, shares, _ = by_force([r for r in rows if r[1] and len(r[1]) == 3])
    assert len(found) == 3 * (40 + 35 + 1 + 1) and {r.n for r in found} == {n}
    assert all(r.deviation == want[r.vec_id][0] for r in found)
    assert all(r.explained == pytest.approx(shares[r.component - 1], rel=1e-4) for r in found)
    assert {r.component for r in found if r.vec_id is None} == {1, 2, 3}


def test_flat_dimensions_and_large_entries(spark):
    flat = whitening.whiten(frame(spark, [(i, [float(i), 1.0, 2.0]) for i in range(5)])).collect()
    assert {r.component for r in flat} == {1} and flat[0].explained == 1.0
    large = whitening.whiten(frame(spark, [(1, [1e300, 0.0]), (2, [0.0, 1e17]), (3, [0.0, 0.0])])).collect()
    assert {r.vec_id for r in large} == {1, 2, 3} and all(r.deviation is None for r in large)
    assert all(math.isfinite(r.whitened) for r in large)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])]])
def test_nothing_to_whiten(spark, rows):
    found = whitening.whiten(frame(spark, rows))
    assert found.count() == 0
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_packing_keeps_rows_apart():
    x = np.array([[0, 127, -128], [0, 127, 128], [2 ** 15, 1, 0], [2 ** 40, -2 ** 60, 7]], np.int64) + whitening.SHIFT
    import pyarrow as pa

    rows = whitening._packed(x)
    assert len(set(rows)) == 4
    assert (whitening._unpacked(pa.array([b"", *rows], pa.binary())[1:], 3) == x).all()


@pytest.mark.parametrize("seed, dims", [(103, 72), (134, 102), (149, 41)])
def test_crowded_spectrum(seed, dims):
    """More eigenvalues just outside an interval than the block has vectors to spare."""
    rng = np.random.default_rng(seed)
    assert rng.integers(2, 130) == dims
    x = np.unique(np.floor(64 * rng.standard_normal((int(rng.integers(2, 3000)), dims)) / np.sqrt(dims)), axis=0)
    a = np.cov(x.T, bias=True)
    values, vectors = contour.leading(a, 16)
    scale = np.abs(a).max()
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:16]).max() <= 1e-13 * scale
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * scale
