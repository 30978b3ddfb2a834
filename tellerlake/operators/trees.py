"""Classification trees as relations: grown from counts, stored as rows, walked in batches.

A tree is a set of rows (tree, node, feature, threshold, gain, class counts): node 1 is the root,
node n has the children 2n and 2n + 1, and a row without a feature is a leaf. Growing needs one
pass over the training rows a level: tasks count classes per node, feature and bin, Spark brings
the counts of a node together, and its best split is taken from their sums. Counts are whole
numbers, so the trees do not depend on how rows are dealt to tasks, and SQL can grow the very
same ones. Scoring sends the node rows, as large as the model, to the tasks that hold the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import KEY, RISK_LABELS
from ..sources.store import cut
from .quantiles import running_totals

BINS = 64
CLASSES = len(RISK_LABELS)
LEAST_GAIN = 1e-7
TASK_ROWS = 20_000  # fewer rows are not worth a task; more tasks than the source had are never made
CHUNK = 1 << 19  # rows a task counts before it hands counts on
GROUP = 400  # nodes whose best splits are found together
NODE_SCHEMA = ("tree int, node int, feature int, threshold double, gain double, "
               + ", ".join(f"n{c} long" for c in range(CLASSES)))

# Fixed values of the hash that draws rows and features: a prime and odd multipliers below 2^17, so that
# every product stays a long and SQL can repeat it.
PRIME = 2_147_483_647
MIX_A, MIX_B, MIX_C, MIX_D = 48_271, 69_621, 16_807, 8_191

# A draw stands for one copy more from each of these numbers on: a Poisson draw with mean 1 is at most 0, 1, ... 6
# with the share sum(1 / (e * k!)).
COPIES = [math.ceil(PRIME * sum(math.exp(-1) / math.factorial(k) for k in range(n + 1))) for n in range(7)]


@dataclass
class Trees:
    """Grown trees: their rows, and what scoring needs beside them."""

    nodes: DataFrame
    trees: int
    depth: int
    weights: list[float]  # per class
    names: list[str] = field(default_factory=list)  # of the features, by number


def mixed(x, y, z):
    """A number below ``PRIME`` from three whole numbers; works on numpy arrays and columns alike."""
    a = (x * MIX_A + y * MIX_B + 1) % PRIME
    b = (a * MIX_C + z) % PRIME
    return (b * b + y * MIX_D) % PRIME


def row_number_of(key: Column) -> Column:
    """28 bits of a hashed key: what draws of rows are made from."""
    return F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("long")


def copies(drawn):
    """How often a row counts in a bootstrap sample."""
    return np.searchsorted(np.array(COPIES), drawn, side="right")


def bin_edges(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """(feature, bin, upper) of training rows: a value's bin is floor(bins * share of smaller values).

    Equal values share a bin; ``upper`` is the largest value of a bin. The values of a feature
    are counted, dealt by ranges and summed slice by slice, never ordered in one task.
    """
    long = rows.select(F.posexplode(vector_to_array("features")).alias("feature", "value"))
    counted = cut(long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")), "value-counts")
    total = rows.count()
    below = running_totals(counted, "value", ["n"], by=["feature"])
    placed = below.select("feature", "value", F.floor((F.col("n_upto") - F.col("n")) * bins / total).cast("int").alias("bin"))
    return placed.groupBy("feature", "bin").agg(F.max("value").alias("upper"))


def edge_lists(edges: DataFrame, features: int) -> list[list[float]]:
    """Edges by feature, ascending; at most ``bins`` a feature."""
    out: list[list[float]] = [[] for _ in range(features)]
    for r in edges.orderBy("feature", "bin").collect():
        out[r.feature].append(r.upper)
    return out


def binned(rows: DataFrame, edges: Sequence[Sequence[float]], total: int) -> DataFrame:
    """Training rows as (number, label, bins): one byte a feature, stored in a task's worth of rows each at least."""
    tables = [np.array(e) for e in edges]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(tables))
            codes = np.stack([np.searchsorted(t[:-1], v) for t, v in zip(tables, values.T)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column("number"), batch.column("label"), pa.array([r.tobytes() for r in codes], pa.binary())],
                names=["number", "label", "bins"])

    slim = rows.select(row_number_of(F.col(KEY)).alias("number"), F.col("label").cast("int").alias("label"),
                       vector_to_array("features").alias("v"))
    return whole_if_small(cut(slim.mapInArrow(coded, "number long, label int, bins binary").coalesce(
        1 + total // TASK_ROWS), "binned-rows"), total)


def whole_if_small(work: DataFrame, total: int) -> DataFrame:
    """Rows of one task's worth are read as one partition, whose sums need no exchange."""
    return work.coalesce(1) if total < TASK_ROWS else work


class Partial:
    """Splits found so far, as arrays by tree and node; small enough to travel with tasks."""

    def __init__(self, trees: int, depth: int) -> None:
        self.feature = np.full((trees, 1 << depth), -1, np.int16)
        self.bin = np.zeros((trees, 1 << depth), np.int16)

    def place(self, tree: int, bins: np.ndarray, level: int) -> np.ndarray:
        """Node of each row at ``level``; 0 where it ended in a leaf above."""
        node = np.ones(len(bins), np.int64)
        every = np.arange(len(bins))
        for _ in range(level):
            f = self.feature[tree, node]
            right = bins[every, np.maximum(f, 0)] > self.bin[tree, node]
            node = np.where((f < 0) | (node == 0), 0, 2 * node + right)
        return node


def bins_of(rows: pa.Array, features: int) -> np.ndarray:
    """Bins by row and feature."""
    ends = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset: rows.offset + len(rows) + 1]
    return np.frombuffer(rows.buffers()[2], np.uint8)[ends[0]: ends[-1]].reshape(len(rows), features)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to as many rows as a task counts at once."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def parts(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Stretches of an array, cut at ``starts``, as bytes."""
    ends = np.append(starts, len(values)).astype(np.int32) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])


def purity(counts: np.ndarray, weights: Sequence[float]) -> np.ndarray:
    """Sum of squared class weights over their sum: the greater, the purer, and additive over nodes."""
    weighed = [counts[..., c] * w for c, w in enumerate(weights)]
    total, squares = weighed[0], weighed[0] * weighed[0]
    for p in weighed[1:]:
        total, squares = total + p, squares + p * p
    return squares / total


def best_splits(work: DataFrame, partial: Partial, level: int, features: int, weights: Sequence[float], least: int,
                sampled: bool, subset: np.ndarray | None) -> list:
    """Per tree and node at ``level``: class totals and the best split; the lower feature, then bin, among equals.

    Tasks count rows by class in each cell (node, feature, bin) and hand on the cells that are not empty, a row a
    node. These meet by node, whose cells are added and searched in one place: never more than the bins
    of its features. One row a node comes to the driver: never more than the trees can have. ``subset`` names
    the features looked at by tree and node, all if none is given.
    """
    trees, nodes = len(partial.feature), 1 << level
    per_node = features if subset is None else subset.shape[2]
    cells = per_node * BINS * CLASSES
    groups = 1 + trees * nodes // GROUP

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            bins = bins_of(chunk.column("bins"), features)
            label, number = chunk.column("label").to_numpy(), chunk.column("number").to_numpy()
            for tree in range(trees):
                times = copies(mixed(number, np.int64(tree), number)) if sampled else np.ones(len(label))
                live = np.flatnonzero(times)
                node = partial.place(tree, bins[live] if sampled else bins, level)
                live, node = live[node > 0], node[node > 0]
                if not len(live):
                    continue
                sums = np.zeros((per_node, nodes * BINS * CLASSES))
                first, weight = (node - nodes) * (BINS * CLASSES) + label[live], times[live]
                for slot in range(per_node):
                    looked = slot if subset is None else subset[tree, node, slot]
                    sums[slot] = np.bincount(first + bins[live, looked].astype(np.int64) * CLASSES, weight, sums.shape[1])
                sums = sums.reshape(per_node, nodes, -1).transpose(1, 0, 2).reshape(-1)
                at = np.flatnonzero(sums)
                found, starts = np.unique(at // cells, return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), tree), pa.int32()), pa.array(found + nodes, pa.int32()),
                     pa.array((tree * nodes + found) % groups, pa.int32()), parts((at % cells).astype(np.int32), starts),
                     parts(sums[at].astype(np.int64), starts)], names=["tree", "node", "slot", "cell", "n"])

    def searched(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        key = group.column("tree").to_numpy().astype(np.int64) * 2 * nodes + group.column("node").to_numpy()
        found, row = np.unique(key, return_inverse=True)
        tree, found = found // (2 * nodes), found % (2 * nodes)
        cell, n = (np.frombuffer(b"".join(group.column(c).to_pylist()), kind) for c, kind in (("cell", np.int32), ("n", np.int64)))
        sizes = pc.binary_length(group.column("cell")).to_numpy() // 4
        sums = np.bincount(np.repeat(row, sizes) * cells + cell, n, len(found) * cells).reshape(len(found), per_node, BINS, CLASSES)
        order = np.arange(per_node)[None, :] + 0 * found[:, None]
        if subset is not None:
            order = np.argsort(subset[tree, found], axis=1)
            sums = np.take_along_axis(sums, order[:, :, None, None], 1)
            order = np.take_along_axis(subset[tree, found].astype(np.int64), order, 1)
        left = sums.cumsum(axis=2)
        total = left[:, :, -1:, :]
        right = total - left
        with np.errstate(all="ignore"):
            score = purity(left, weights) + purity(right, weights) - purity(total, weights)
        allowed = (sums.sum(axis=3) > 0) & (left.sum(axis=3) >= least) & (right.sum(axis=3) >= least)
        score = np.where(allowed, score, -np.inf).reshape(len(found), -1)
        at = score.argmax(axis=1)  # the lower feature, then bin, among equals
        every = np.arange(len(found))
        lefts, totals = left.reshape(len(found), -1, CLASSES)[every, at], total[:, 0, 0, :]
        return pa.table([
            pa.array(tree, pa.int32()), pa.array(found, pa.int32()), pa.array(score[every, at]),
            pa.array(order[every, at // BINS], pa.int32()), pa.array(at % BINS, pa.int32()),
            *[pa.array(v[:, c].astype(np.int64)) for v in (lefts, totals) for c in range(CLASSES)]],
            names=["tree", "node", "score", "feature", "bin", *[f"{k}{c}" for k in "lt" for c in range(CLASSES)]])

    return work.mapInArrow(counted, "tree int, node int, slot int, cell binary, n binary").groupBy("slot").applyInArrow(
        searched, "tree int, node int, score double, feature int, bin int, "
        + ", ".join(f"{k}{c} long" for k in "lt" for c in range(CLASSES))).collect()


def chosen_features(trees: int, depth: int, features: int, take: int) -> np.ndarray:
    """Features looked at, by tree and node: the ``take`` of least hash."""
    tree, node, feature = np.ogrid[:trees, : 1 << depth, :features]
    drawn = mixed(tree.astype(np.int64), node.astype(np.int64), feature.astype(np.int64) * MIX_D)
    return np.argsort(drawn, axis=2, kind="stable")[:, :, :take].astype(np.int16)


def grow(rows: DataFrame, names: Sequence[str], trees: int = 1, depth: int = 8, least: int = 20,
         take: int | None = None, sampled: bool = False) -> Trees:
    """Grow ``trees`` classification trees on rows (customer, label, features).

    Classes are balanced: a class weighs rows / (classes * its rows). A node splits where the
    weighted Gini impurity falls most and either side keeps ``least`` rows. With ``sampled`` every
    tree draws its own sample with repetition, with ``take`` every node its own features, both
    by hash. A class without rows weighs nothing; a table without rows gives no nodes.
    """
    spark, features = rows.sparkSession, len(names)
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    weights = [total / (CLASSES * counts[c]) if counts.get(c) else 0.0 for c in range(CLASSES)]
    if not total:
        return Trees(spark.createDataFrame([], NODE_SCHEMA), trees, depth, weights, list(names))
    edges = edge_lists(bin_edges(rows), features)
    work = binned(rows, edges, total)
    partial = Partial(trees, depth)
    subset = chosen_features(trees, depth, features, take) if take else None
    known: dict[tuple[int, int], list] = {}
    for level in range(depth):
        split = best_splits(work, partial, level, features, weights, least, sampled, subset)
        if level == 0:
            for r in split:
                known[r.tree, 1] = [None, None, None, [r[f"t{c}"] for c in range(CLASSES)]]
        found = [r for r in split if r.score > LEAST_GAIN]
        for r in found:
            partial.feature[r.tree, r.node], partial.bin[r.tree, r.node] = r.feature, r.bin
            totals = [r[f"t{c}"] for c in range(CLASSES)]
            lefts = [r[f"l{c}"] for c in range(CLASSES)]
            known[r.tree, r.node] = [r.feature, edges[r.feature][r.bin], r.score, totals]
            known[r.tree, 2 * r.node] = [None, None, None, lefts]
            known[r.tree, 2 * r.node + 1] = [None, None, None, [t - v for t, v in zip(totals, lefts)]]
        if not found:
            break
    table = [(t, n, f, at, g, *map(int, c)) for (t, n), (f, at, g, c) in sorted(known.items())]
    nodes = cut(spark.createDataFrame(table, NODE_SCHEMA).coalesce(1), "tree-nodes")
    return Trees(nodes, trees, depth, weights, list(names))


def chances(nodes: DataFrame, weights: Sequence[float]) -> DataFrame:
    """(tree, node, q0, q1, ...): class shares of each leaf, rows counted by class weight."""
    parts = [F.col(f"n{c}") * F.lit(w) for c, w in enumerate(weights)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return nodes.where("feature IS NULL").select("tree", "node", *[(p / total).alias(f"q{c}") for c, p in enumerate(parts)])


def summed_leaves(rows: DataFrame, nodes: DataFrame, numbers: DataFrame, trees: int, depth: int, values: Column,
                  keep: Sequence[str]) -> DataFrame:
    """The ``keep`` columns and ``_sums``: sums of whole ``numbers`` (tree, node, s0, s1, ...) over the leaves of each row.

    Rows are walked where they stand, a batch and a tree at a time; nodes and numbers, as large as
    the model, travel with the tasks. As in SQL, a missing value takes its row out of the tree and NaN is greater
    than any number. A row that reaches no leaf is left out.
    """
    table = nodes.select("tree", "node", "feature", "threshold").orderBy("tree", "node").toArrow()
    tree, node = (table.column(c).to_numpy().astype(np.int64) for c in ("tree", "node"))
    inner = table.column("feature").is_valid().to_numpy()
    feature = table.column("feature").fill_null(0).to_numpy().astype(np.int64)
    threshold = table.column("threshold").fill_null(0.0).to_numpy()
    names, gone = numbers.columns[2:], len(tree)  # the last place stands for rows that are out
    span = int(node.max(initial=1)) * 2 + 2
    key = tree * span + node

    def place(wanted: np.ndarray) -> np.ndarray:
        at = np.searchsorted(key, wanted)
        return np.where((at < gone) & (np.append(key, -1)[at] == wanted), at, gone)

    child = np.tile(np.arange(gone + 1), (2, 1))
    for side in (0, 1):
        child[side, :gone][inner] = place(tree * span + 2 * node + side)[inner]
    feature, threshold = np.append(feature, 0), np.append(threshold, 0.0)
    found = numbers.toArrow()
    mine = place(found.column("tree").to_numpy().astype(np.int64) * span + found.column("node").to_numpy())
    number, real = np.zeros((gone + 1, len(names)), np.int64), np.zeros(gone + 1, bool)
    number[mine] = np.stack([found.column(c).fill_null(0).to_numpy() for c in names], axis=1) if len(mine) else 0
    real[mine] = True
    real[gone], number[gone] = False, 0
    roots, width = place(np.arange(trees) * span + 1), int(feature.max()) + 1
    child, open_ = child.T.reshape(-1).copy(), np.append(inner, False)

    def summed(vectors: pa.Array) -> pa.Array:
        n = len(vectors)
        sizes = pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = vectors.flatten()
        gaps = np.append(flat.is_null().to_numpy(zero_copy_only=False), True)
        plain = np.append(flat.fill_null(0.0).to_numpy(zero_copy_only=False), 0.0)
        cell = np.where(np.arange(width) < sizes[:, None], (np.cumsum(sizes) - sizes)[:, None] + np.arange(width), len(flat))
        x, missing, every = plain[cell].reshape(-1), gaps[cell].reshape(-1), np.arange(n) * width
        odd, lacking = bool(np.isnan(x).any()), bool(missing.any())
        sums, reached = np.zeros((n, len(names)), np.int64), np.zeros(n, bool)
        for root in roots:
            at = np.full(n, root)
            for _ in range(depth):
                look = every + feature[at]
                right = x[look] > threshold[at]
                if odd:
                    right |= np.isnan(x[look]) & ~np.isnan(threshold[at])
                below = child[2 * at + right]
                at = np.where(missing[look] & open_[at], gone, below) if lacking else below
            sums += number[at]
            reached |= real[at]
        ends = pa.array(np.arange(n + 1) * len(names), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(sums.reshape(-1)), mask=pa.array(~reached))

    # called nondeterministic so that it is evaluated once, not again for the condition
    leaves = F.arrow_udf(summed, "array<long>").asNondeterministic()
    return rows.select(*keep, leaves(values).alias("_sums")).where("_sums IS NOT NULL")


def most_likely(scores: Sequence[Column]) -> Column:
    """Number of the highest score, the lower one among equals."""
    top, found = F.greatest(*scores), F.lit(len(scores) - 1)
    for c in reversed(range(len(scores) - 1)):
        found = F.when(scores[c] == top, c).otherwise(found)
    return found.cast("int")


def predict(model: Trees, rows: DataFrame, values: Column | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``prediction`` and the class probabilities: means of the leaf shares over all trees.

    Shares are added as whole multiples of 10^-12, so that the order of trees does not matter.
    Rows need not have distinct keys. Classes equal to 12 digits: the lower one. ``keep`` names the
    columns that stay, all if not given.
    """
    values = vector_to_array("features") if values is None else values
    keep = rows.columns if keep is None else list(keep)

    shares = chances(model.nodes, model.weights).select("tree", "node", *[
        F.round(F.col(f"q{c}") * 1e12).cast("long").alias(f"s{c}") for c in range(CLASSES)])
    summed = summed_leaves(rows, model.nodes, shares, model.trees, model.depth, values, keep)
    sums = [F.get("_sums", F.lit(c)) for c in range(CLASSES)]
    scale = 1e12 * model.trees
    return summed.select(*keep, most_likely(sums).alias("prediction"),
                         *[(q / scale).alias(f"p_{v.lower()}") for q, v in zip(sums, RISK_LABELS)])


def importances(nodes: DataFrame, names: Sequence[str], spark: SparkSession, top: int | None = None) -> DataFrame:
    """(feature, importance): gains per feature as shares of a tree's, averaged over the trees that split.

    Every feature has a row, highest first, those without a gain in order of their number;
    ``top`` at most. Shares are added as whole multiples of 10^-12.
    """
    gains = nodes.where("feature IS NOT NULL").groupBy("tree", "feature").agg(
        F.sum(F.round(F.col("gain") * 1e6).cast("long")).alias("g"))
    total = gains.groupBy("tree").agg(F.sum("g").alias("all")).where("all > 0")
    share = gains.join(total, "tree").select("feature", F.round(F.col("g") / F.col("all") * 1e12).cast("long").alias("s"))
    summed = {r.feature: r.s for r in share.groupBy("feature").agg(F.sum("s").alias("s")).collect()}  # a row a feature
    whole = sum(summed.values())
    rows = sorted(((n, summed.get(i, 0) / whole if whole else 0.0, i) for i, n in enumerate(names)),
                  key=lambda r: (-r[1], r[2]))[:top]
    return spark.createDataFrame([r[:2] for r in rows], "feature string, importance double")
