"""Trees at scale: what moves while they grow and score, and that neither chunks nor tasks show in the result."""

import os

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from tellerlake.operators import boosting, training, trees
from tellerlake.plans import models


def train_rows(spark):
    table = models.table(spark, SMALL)
    return table.where("NOT is_test"), training.feature_names(table)


def node_rows(model):
    return sorted(map(tuple, model.nodes.collect()), key=str)


@pytest.mark.parametrize("kind, params", [("forest", {"trees": 3}), ("boosted", {"rounds": 2})])
def test_scoring_moves_no_rows(spark, kind, params):
    """Rows are not repeated per tree, joined or exchanged: they are walked where they stand."""
    scored = models.tested(spark, SMALL, kind, **params)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Generate" not in plan
    assert plan.count("ArrowEvalPython") == 1


def counted_rows(monkeypatch):
    """Numbers of rows that tasks hand on, a pass each: those of the data frame's first mapInArrow behind the stored rows."""
    from pyspark.sql.classic.dataframe import DataFrame

    seen, plain = [], DataFrame.mapInArrow

    def counting(self, func, schema, *args):
        out = plain(self, func, schema, *args)
        if "tree" in out.columns:
            seen.append(out.count())
        return out

    monkeypatch.setattr(DataFrame, "mapInArrow", counting)
    return seen


def test_a_task_hands_on_a_row_a_node(spark, monkeypatch):
    rows, names = train_rows(spark)
    seen = counted_rows(monkeypatch)
    trees.grow(rows, names, **{**training.TREE_SIZES["forest"], "trees": 3, "depth": 4})
    assert len(seen) == 4 and all(n <= 3 * 2 ** level for level, n in enumerate(seen))
    seen.clear()
    boosting.fit(rows, names, rounds=1, depth=4)
    # the lighter child of each pair, and the loss
    assert len(seen) == 5 and all(n <= 3 * max(1, 2 ** level // 2) + 1 for level, n in enumerate(seen[:4])) and seen[4] == 1


def test_chunks_and_tasks_do_not_show(spark, monkeypatch):
    rows, names = train_rows(spark)
    size = {**training.TREE_SIZES["forest"], "trees": 4, "depth": 5}
    forest, boosted = trees.grow(rows, names, **size), boosting.fit(rows, names, rounds=3)
    for name, value in (("TASK_ROWS", 9), ("CHUNK", 7), ("GROUP", 3)):
        monkeypatch.setattr(trees, name, value)
    monkeypatch.setattr(boosting, "DIRECT", 0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        dealt = rows.repartition(6)
        assert node_rows(trees.grow(dealt, names, **size)) == node_rows(forest)
        again = boosting.fit(dealt, names, rounds=3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert node_rows(again) == node_rows(boosted) and again.losses == boosted.losses


def test_odd_values_take_their_way(spark):
    """NaN goes right, a gap leaves the tree if it is asked for; a row that no tree keeps is left out."""
    nodes = spark.createDataFrame(
        [(0, 1, 0, 1.0, 0.5, 2, 2, 0), (0, 2, None, None, None, 2, 0, 0), (0, 3, None, None, None, 0, 2, 0),
         (1, 1, 1, 0.0, 0.5, 1, 0, 3), (1, 2, None, None, None, 1, 0, 0), (1, 3, None, None, None, 0, 0, 3)], trees.NODE_SCHEMA)
    model = trees.Trees(nodes, 2, 3, [1.0, 1.0, 1.0], ["a", "b"])
    rows = spark.createDataFrame(
        [(0, [0.0, -1.0]), (1, [2.0, 1.0]), (2, [float("nan"), float("nan")]), (3, [1.0, None]), (4, [None, None]),
         (5, None), (6, []), (7, [5.0]), (8, [5.0, 0.0, 9.0])], "k int, v array<double>")
    found = {r.k: tuple(r)[1:] for r in trees.predict(model, rows, F.col("v"), ["k"]).collect()}
    assert found == {0: (0, 1.0, 0.0, 0.0), 1: (1, 0.0, 0.5, 0.5), 2: (1, 0.0, 0.5, 0.5), 3: (0, 0.5, 0.0, 0.0),
                     7: (1, 0.0, 0.5, 0.0), 8: (0, 0.5, 0.5, 0.0)}
    none = trees.Trees(nodes.limit(0), 0, 3, [1.0, 1.0, 1.0], ["a", "b"])
    assert trees.predict(none, rows, F.col("v"), ["k"]).count() == 0


def test_one_child_is_the_rest_of_its_parent(spark):
    """Sums of all nodes of a level, gathered at once, are those that the fit took from parents."""
    rows, names = train_rows(spark)
    taken, plain = [], boosting._splits
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(boosting, "_splits", lambda cells, *a: taken.append(cells) or plain(cells, *a))
        model = boosting.fit(rows, names, rounds=1, depth=3)
    data = rows.collect()
    x, y = np.array([r.features.toArray() for r in data]), np.array([r.label for r in data])
    at = {(r.tree, r.node): r for r in model.nodes.collect()}
    for c in range(3):
        for node in range(4, 8):
            if (c, node) in at:
                right, half = node & 1, at[c, node >> 1]
                top = at[c, 1]
                mine = ((x[:, top.feature] > top.threshold) == bool(node >> 1 & 1)) & ((x[:, half.feature] > half.threshold) == bool(right))
                g = (1 / 3 - (y[mine] == c)).sum()
                assert taken[2][c, node - 4, 0].sum(axis=0) == pytest.approx((g, mine.sum() * 4 / 9), abs=1e-6)


def test_shared_codes_give_the_sums_of_each_feature():
    """Sums by code, flushed at any time, are those of each feature alone; rows are placed as their bins say."""
    rng, sizes = np.random.default_rng(7), [64, 1, 64, 2, 3, 64, 17, 5, 1]
    codes = boosting.Codes(sizes, 6, 10 ** 6)
    assert len(codes.groups) < len(sizes) and max(codes.widths) == boosting.JOINT
    # deep trees and few rows: no more than the bins of a feature
    assert max(boosting.Codes(sizes, 12, 10 ** 6).widths) == 64 == max(boosting.Codes(sizes, 6, 100).widths)
    bins = np.stack([rng.integers(0, n, 500) for n in sizes], axis=1).astype(np.uint8)
    label, margins = rng.integers(0, 3, 500).astype(np.int8), rng.normal(size=(3, 500))
    now = boosting.Round(3)
    for node, f, b in ((1, 0, 30), (2, 5, 12), (3, 4, 0), (5, 3, 0)):
        now.splits.feature[1, node], now.splits.bin[1, node], now.values[1, node] = f, b, 9.0
    now.values[1, 4:16] = np.arange(4, 16)
    blocks = [(codes.coded(bins[at: at + 90]), label[at: at + 90], margins[:, at: at + 90]) for at in range(0, 500, 90)]
    node = np.where(bins[:, 0] > 30, 6 + (bins[:, 4] > 0), 4 + (bins[:, 5] > 12))
    slots = [np.array([], int), np.array([1, 2]), np.array([0])]
    p = np.exp(margins) / np.exp(margins).sum(axis=0)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(boosting, "FLUSH", 200)
        sums, loss = boosting.level_sums(iter(blocks), now, codes, 2, slots)
    assert loss == 0 and not len(sums[0]) and not sums[2].any()  # the tree of class 2 has no split
    for i, n in enumerate((5, 6)):
        for f in range(len(sizes)):
            for b in range(sizes[f]):
                mine = (node == n) & (bins[:, f] == b)
                want = (p[1] - (label == 1))[mine].sum(), (2 * p[1] * (1 - p[1]))[mine].sum()
                assert sums[1][i, :, codes.starts[f] + b] / boosting.UNIT == pytest.approx(want, abs=1e-6)
    moved = np.concatenate([b[2] for b in boosting.advanced(iter(blocks), [now], codes)], axis=1)
    leaf = np.where(node == 5, 10 + (bins[:, 3] > 0), node)
    assert np.array_equal(moved, margins + np.stack([np.zeros(500), leaf, np.zeros(500)]))


def test_rows_of_many_tasks_stay_with_them(spark, monkeypatch):
    """A round plans no query of its own and leaves nothing behind; margins are stored now and then."""
    rows, names = train_rows(spark)
    one = boosting.fit(rows, names, rounds=3, depth=2)
    seen, kind = [], type(rows)
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *args: seen.append(args) or plain(self, *args))
    stored, keep = [], boosting.checkpointed
    monkeypatch.setattr(boosting, "checkpointed", lambda rdd: stored.append(keep(rdd)) or stored[-1])
    monkeypatch.setattr(trees, "TASK_ROWS", 25)
    monkeypatch.setattr(boosting, "KEEP", 2)
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    many = boosting.fit(rows.repartition(4), names, rounds=3, depth=2)
    assert len(seen) == 2 and len(stored) == 2  # bins and blocks; at the start and after round 2
    assert node_rows(many) == node_rows(one) and many.losses == one.losses
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept
    assert not any(os.path.exists(path.removeprefix("file:")) for path in stored)
