"""Soft-max boosting: in every round one regression tree a class, all fitted to one joint loss.

Each level of a round is one pass over the training rows: tasks add the gradients and second
derivatives of the soft-max loss per class, node, feature and bin, the tasks' sums are added,
and splits follow from them. Of two children only the lighter one is summed, the other is the
rest of their parent. Gradients are summed as whole multiples of 2^-30, so a model does
not depend on how rows are dealt. Trees are rows as in :mod:`trees`, with a value per leaf.

Rows stand in blocks, column by column. Features whose bins are few share one code, so that one
count of codes serves them all; the sums of each feature follow from those of the codes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import RISK_LABELS
from ..sources.store import checkpointed, cut, discard, drop_checkpoint
from . import trees
from .trees import (BINS, CLASSES, Partial, bin_edges, binned, bins_of, chunks, edge_lists, most_likely, summed_leaves,
                    whole_if_small)

UNIT = float(1 << 30)
NODE_SCHEMA = "tree int, node int, feature int, threshold double, gain double, value double"
BLOCK_SCHEMA = "codes binary, label binary, margins binary"
DIRECT = 16  # tasks whose sums the driver adds itself; those of more meet by node before
KEEP = 10  # rounds before margins are stored again
JOINT = 4096  # values of a code that features share; fewer where a task has few rows or trees are deeper than six levels
BLOCK = 1 << 16  # rows of a block at most
FLUSH = 1 << 22  # rows whose sums stay below 2^53 as doubles, and rows that a task holds at most where there are cores for it

Block = tuple[np.ndarray, np.ndarray, np.ndarray]  # codes by group and row, labels, margins by class and row


@dataclass
class Boosted:
    """Trees of all rounds (tree = classes * round + class), and the mean loss before each round and at the end."""

    nodes: DataFrame
    trees: int
    depth: int
    losses: list[float]
    names: list[str] = field(default_factory=list)


class Codes:
    """Features by the code they share: a number whose digits are their bins, the first one lowest."""

    def __init__(self, sizes: Sequence[int], depth: int, rows: int) -> None:
        # neither do sums outweigh the ``rows`` of a task, nor grow with the depth
        most = max(BINS, min(JOINT, rows // 64, (16 * JOINT) >> max(depth - 2, 0)))
        self.sizes, self.groups = list(sizes), []
        for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
            for g in self.groups:
                if int(np.prod([sizes[k] for k in g])) * sizes[f] <= most:
                    g.append(f)
                    break
            else:
                self.groups.append([f])
        self.group, self.stride = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
        for i, g in enumerate(self.groups):
            for before, f in enumerate(g):
                self.group[f], self.stride[f] = i, np.prod([sizes[k] for k in g[:before]], dtype=np.int64)
        self.widths = [int(np.prod([sizes[k] for k in g])) for g in self.groups]
        self.starts = np.cumsum([0, *sizes])  # of a feature among the bins of all

    def coded(self, bins: np.ndarray) -> np.ndarray:
        """Codes by group and row, of bins by row and feature."""
        out = np.zeros((len(self.groups), len(bins)), np.uint16)
        for i, g in enumerate(self.groups):
            for f in g:
                out[i] += bins[:, f] * np.uint16(self.stride[f])
        return out

    def above(self, f: int, b: int) -> np.ndarray:
        """By code of its group: is the bin of ``f`` above ``b``?"""
        digit = np.repeat(np.arange(self.sizes[f]) > b, self.stride[f])
        return np.resize(digit, max(self.widths))

    def by_bin(self, sums: Sequence[np.ndarray]) -> np.ndarray:
        """Sums by place and bin of all features, of those by place and code of each group."""
        out = np.zeros((len(sums[0]), self.starts[-1]), np.int64)
        for g, s in zip(self.groups, sums):
            s = s.reshape(len(s), *[self.sizes[f] for f in reversed(g)])
            for i, f in enumerate(g):
                others = tuple(1 + a for a in range(len(g)) if a != len(g) - 1 - i)
                out[:, self.starts[f]: self.starts[f + 1]] = s.sum(axis=others)
        return out

    def cells(self) -> np.ndarray:
        """Place of each bin of all features among ``BINS`` a feature."""
        return np.concatenate([f * BINS + np.arange(n) for f, n in enumerate(self.sizes)])


def softmax(margins: np.ndarray) -> list[np.ndarray]:
    """Chances by class, of margins by class and row."""
    e = np.exp(margins - margins.max(axis=0))
    total = e[0]
    for x in e[1:]:
        total = total + x
    return [x / total for x in e]


class Round:
    """Trees of one round: splits and leaf values by class and node."""

    def __init__(self, depth: int) -> None:
        self.depth, self.splits = depth, Partial(CLASSES, depth + 1)
        self.values = np.zeros((CLASSES, 1 << (depth + 1)))


class Paths:
    """The trees of a round, made ready to place rows by their codes."""

    def __init__(self, round_: Round, codes: Codes) -> None:
        self.round, self.width = round_, max(codes.widths)
        feature = round_.splits.feature
        nodes = feature.shape[1]
        self.group = np.where(feature < 0, 0, codes.group[feature])
        self.child = np.repeat(np.arange(nodes), 2)[None, :].repeat(CLASSES, 0)  # a leaf leads to itself
        self.right = np.zeros((CLASSES, nodes, self.width), bool)
        for c, node in zip(*np.nonzero(feature >= 0)):
            self.right[c, node] = codes.above(feature[c, node], round_.splits.bin[c, node])
            self.child[c, 2 * node: 2 * node + 2] = 2 * node, 2 * node + 1

    def place(self, c: int, codes: np.ndarray, level: int) -> np.ndarray:
        """Node of each row at ``level``, or the leaf above it where the row ended."""
        n, flat = codes.shape[1], codes.reshape(-1)
        if not level:
            return np.ones(n, np.int64)
        child, right, starts = self.child[c], self.right[c].reshape(-1), self.group[c] * n
        node = child[2:4].take(self.right[c, 1].take(codes[self.group[c, 1]]))  # the root is one for all
        every = np.arange(n)
        for _ in range(1, level):
            code = flat.take(starts.take(node) + every)
            node = child.take(2 * node + right.take(node * self.width + code))
        return node

    def margins(self, codes: np.ndarray) -> np.ndarray:
        return np.stack([self.round.values[c].take(self.place(c, codes, self.round.depth)) for c in range(CLASSES)])


def advanced(blocks: Iterator[Block], rounds: Sequence[Round], codes: Codes) -> Iterator[Block]:
    """Blocks with the margins of ``rounds`` added, one after the other."""
    ways = [Paths(r, codes) for r in rounds]
    for code, label, margins in blocks:
        for w in ways:
            margins = margins + w.margins(code)
        yield code, label, margins


def level_sums(blocks: Iterator[Block], now: Round, codes: Codes, level: int, slots: Sequence[np.ndarray]
               ) -> tuple[list[np.ndarray], int]:
    """Sums of gradient and second derivative by class as (node, 2, bins of all features), and at the root the summed loss.

    Whole numbers, in units of 2^-30; of a class only the nodes ``slots`` of the level.
    """
    ways, nodes, loss, held = Paths(now, codes), 1 << level, 0, 0
    kind = np.uint8 if nodes < 255 else np.uint16
    slot_of = np.full((CLASSES, 2 * nodes), np.iinfo(kind).max, kind)
    for c, s in enumerate(slots):
        slot_of[c, s + nodes] = np.arange(len(s))
    empty = lambda kind: [[[np.zeros(len(s) * w, kind) for w in codes.widths] for _ in "gh"] for s in slots]
    part, out = empty(np.float64), [np.zeros((len(s), 2, codes.starts[-1]), np.int64) for s in slots]

    def flush() -> None:
        for c, s in enumerate(slots):
            for k in range(2 if len(s) else 0):
                out[c][:, k] += codes.by_bin([v.astype(np.int64).reshape(len(s), -1) for v in part[c][k]])
                for v in part[c][k]:
                    v[:] = 0

    for code, label, margins in blocks:
        p = softmax(margins)
        if level == 0:
            own = np.choose(label, p)
            loss += int(np.rint(-np.log(np.maximum(own, 1e-300)) * UNIT).astype(np.int64).sum())
        if held + len(label) > FLUSH:
            flush()
            held = 0
        held += len(label)
        for c, s in enumerate(slots):
            if not len(s):
                continue
            numbers = [np.rint(v * UNIT) for v in (p[c] - (label == c), 2 * p[c] * (1 - p[c]))]
            if level:
                slot = slot_of[c].take(ways.place(c, code, level))
                # ordered by node, so that what is added to stays near
                live = np.argsort(slot, kind="stable")[: np.count_nonzero(slot < len(s))]
                first, numbers = slot.take(live).astype(np.int64), [v.take(live) for v in numbers]
            for i, w in enumerate(codes.widths):
                cell = code[i].take(live) + first * w if level else code[i].astype(np.int64)
                for k, v in enumerate(numbers):  # below 2^53, so exact
                    part[c][k][i] += np.bincount(cell, v, len(s) * w)
    if held:
        flush()
    return out, loss


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks as they are stored: one row each."""
    for batch in batches:
        for code, label, margins in zip(*(batch.column(c) for c in ("codes", "label", "margins"))):
            yield _block(code.as_buffer(), label.as_buffer(), margins.as_buffer())


def _block(code, label, margins) -> Block:
    y = np.frombuffer(label, np.int8)
    return (np.frombuffer(code, np.uint16).reshape(-1, len(y)), y, np.frombuffer(margins, np.float64).reshape(CLASSES, -1))


def _stored(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
    for block in blocks:
        yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in block],
                                         names=["codes", "label", "margins"])


def _first_blocks(rows: DataFrame, codes: Codes, features: int, size: int) -> DataFrame:
    """Binned rows as blocks of ``size`` rows at most, with margins of zero."""
    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        for chunk in chunks(batches):
            bins, label = bins_of(chunk.column("bins"), features), chunk.column("label").to_numpy().astype(np.int8)
            for at in range(0, len(label), size):
                y = label[at: at + size]
                yield codes.coded(bins[at: at + size]), y, np.zeros((CLASSES, len(y)))

    return rows.select("label", "bins").mapInArrow(lambda batches: _stored(gathered(batches)), BLOCK_SCHEMA)


def _joined(blocks: Iterator[Block]) -> Iterator[Block]:
    """Small blocks put together."""
    held, n = [], 0
    for block in blocks:
        if held and n + len(block[1]) > BLOCK:
            yield tuple(np.concatenate(x, axis=-1) for x in zip(*held))
            held, n = [], 0
        held.append(block)
        n += len(block[1])
    if held:
        yield tuple(np.concatenate(x, axis=-1) for x in zip(*held))


class Few:
    """Training rows of one task: a stored table, with the trees of up to ``KEEP`` rounds since."""

    def __init__(self, rows: DataFrame, codes: Codes, features: int, total: int) -> None:
        self.codes, self.total, self.since = codes, total, []
        self.work = self._cut(_first_blocks(rows, codes, features, BLOCK))

    def _cut(self, blocks: DataFrame) -> DataFrame:
        return whole_if_small(cut(blocks, "boosting-rows"), self.total)

    def advance(self, done: Round) -> None:
        self.since.append(done)
        if len(self.since) == KEEP:
            old, since, codes = self.work, self.since, self.codes
            self.work = self._cut(old.mapInArrow(lambda b: _stored(advanced(_blocks(b), since, codes)), BLOCK_SCHEMA))
            discard(old)
            self.since = []

    def sums(self, now: Round, level: int, slots: Sequence[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
        since, codes = self.since, self.codes

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, loss = level_sums(advanced(_blocks(batches), since, codes), now, codes, level, slots)
            out = [(c, int(n), v.tobytes()) for c, s in enumerate(slots) for n, v in zip(s, sums[c])]
            out.append((-1, 0, np.array([loss], np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))],
                                             names=["tree", "node", "part"])

        table = self.work.mapInArrow(summed, "tree int, node int, part binary").toArrow()
        for c, n, part in zip(*(table.column(k).to_pylist() for k in ("tree", "node", "part"))):
            yield c, n, np.frombuffer(part, np.int64)

    def close(self) -> None:
        discard(self.work)


class Many:
    """Training rows of several tasks: kept by them with their margins, which are stored every ``KEEP`` rounds.

    A pass over what is kept costs a third of what planning a query for it and moving its rows would.
    """

    def __init__(self, rows: DataFrame, codes: Codes, features: int, total: int, tasks: int) -> None:
        self.spark, self.codes, self.tasks, self.rounds = rows.sparkSession, codes, tasks, 0
        dealt = _first_blocks(rows, codes, features, max(1, min(BLOCK, total // (32 * self.tasks)))).repartition(self.tasks)
        self.now = dealt.rdd.mapPartitions(lambda found: _joined(_block(r.codes, r.label, r.margins) for r in found))
        self.old: list[RDD] = []
        self.file = self._keep(True)

    def _keep(self, store: bool) -> str | None:
        """Keep the rows in the tasks' memory, or on their disks; ``store`` them for all as well, which ends their lineage."""
        self.now.persist(StorageLevel.MEMORY_AND_DISK_DESER)
        return checkpointed(self.now) if store else None

    def advance(self, done: Round) -> None:
        codes = self.codes
        self.old.append(self.now)
        self.now = self.now.mapPartitions(lambda blocks: advanced(blocks, [done], codes))
        self.rounds += 1
        file = self._keep(self.rounds % KEEP == 0)
        if file:
            drop_checkpoint(self.spark, self.file)
            self.file = file

    def sums(self, now: Round, level: int, slots: Sequence[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
        codes = self.codes

        def summed(blocks: Iterator[Block]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
            sums, loss = level_sums(blocks, now, codes, level, slots)
            for c, s in enumerate(slots):
                for n, v in zip(s, sums[c]):
                    yield (c, int(n)), v.reshape(-1)
            yield (-1, 0), np.array([loss], np.int64)

        sums = self.now.mapPartitions(summed)
        if self.tasks > DIRECT:
            sums = sums.reduceByKey(np.add, min(self.tasks, 1 + sum(map(len, slots))))
        found = sums.collect()
        for old in self.old:  # what followed from them is kept now
            old.unpersist()
        self.old = []
        for (c, n), part in found:
            yield c, n, part

    def close(self) -> None:
        self.now.unpersist()
        drop_checkpoint(self.spark, self.file)


def _sums(work: Few | Many, now: Round, level: int, wanted: np.ndarray) -> tuple[np.ndarray, int]:
    """Sums of gradient and second derivative as (class, node, feature, bin, 2), and at the root the summed loss.

    Whole numbers, in units of 2^-30. Only ``wanted`` (class, node) are summed. As many cells as a
    level can have, whatever the rows.
    """
    codes, nodes = work.codes, 1 << level
    features, at = len(codes.sizes), codes.cells()
    cells, loss = np.zeros((CLASSES, nodes, 2, features * BINS), np.int64), 0
    for c, n, part in work.sums(now, level, [np.flatnonzero(w) for w in wanted]):
        if c < 0:
            loss += int(part[0])
        else:
            cells[c, n][:, at] += part.reshape(2, -1)
    return np.moveaxis(cells.reshape(CLASSES, nodes, 2, features, BINS), 2, 4), loss


def _splits(cells: np.ndarray, shrink: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best (gain, feature, bin) by class and node, and sums left of every split."""
    left = cells.cumsum(axis=3)
    total = left[:, :, :, -1:, :]
    right = total - left
    worth = lambda s: s[..., 0] ** 2 / (s[..., 1] + shrink)
    gain = worth(left) + worth(right) - worth(total)
    gain[(left[..., 1] < least) | (right[..., 1] < least)] = -np.inf
    flat = gain.reshape(*gain.shape[:2], -1)
    at = flat.argmax(axis=2)  # the lower feature, then bin, among equals
    return np.take_along_axis(flat, at[..., None], 2)[..., 0], at // BINS, at % BINS, left


def fit(rows: DataFrame, names: Sequence[str], rounds: int = 200, depth: int = 6, rate: float = 0.1,
        shrink: float = 1.0, least: float = 1.0) -> Boosted:
    """Fit ``rounds`` rounds on rows (customer, label, features); rows count once whatever their class.

    A split must lower the loss and leave second derivatives of ``least`` on either side; leaf
    values are Newton steps, damped by ``shrink``, times ``rate``. Rounds that find no split
    give constant trees. A table without rows gives no nodes.
    """
    spark, features = rows.sparkSession, len(names)
    total = rows.count()
    if not total:
        return Boosted(spark.createDataFrame([], NODE_SCHEMA), 0, depth, [], list(names))
    edges = edge_lists(bin_edges(rows), features)
    coded = binned(rows, edges, total)
    tasks = min(1 + total // trees.TASK_ROWS, max(spark.sparkContext.defaultParallelism, 1 + total // FLUSH))
    codes = Codes([len(e) for e in edges], depth, total // tasks)
    work = (Few(coded, codes, features, total) if total < trees.TASK_ROWS else
            Many(coded, codes, features, total, tasks))
    discard(coded)
    table, losses, root = [], [], np.ones((CLASSES, 1), bool)
    for number in range(rounds):
        now = Round(depth)
        open_, lighter, whole = {(c, 1) for c in range(CLASSES)}, set(), None
        for level in range(depth):
            wanted = root
            if level:
                wanted = np.zeros((CLASSES, 1 << level), bool)
                for c, node in lighter:
                    wanted[c, node - (1 << level)] = True
            parents, (whole, loss) = whole, _sums(work, now, level, wanted)
            if level:
                for c, node in lighter:
                    n = node - (1 << level)
                    whole[c, n ^ 1] = parents[c, n >> 1] - whole[c, n]
            cells = whole / UNIT
            gains, best, bins, left = _splits(cells, shrink, least)
            if level == 0:
                losses.append(loss / UNIT / total)
                for c in range(CLASSES):
                    g, h = cells[c, 0, 0].sum(axis=0)
                    now.values[c, 1] = -rate * g / (h + shrink)
                    table.append([CLASSES * number + c, 1, None, None, None, now.values[c, 1]])
            at = {(r[0] - CLASSES * number, r[1]): r for r in table[-CLASSES * 2 ** (depth + 1):] if r[0] >= CLASSES * number}
            grown, lighter = set(), set()
            for c, node in sorted(open_):
                n = node - (1 << level)
                if not gains[c, n] > 1e-9:
                    continue
                f, b = int(best[c, n]), int(bins[c, n])
                now.splits.feature[c, node], now.splits.bin[c, node] = f, b
                at[c, node][2:5] = [f, edges[f][b], float(gains[c, n])]
                for child, s in ((2 * node, left[c, n, f, b]), (2 * node + 1, left[c, n, f, -1] - left[c, n, f, b])):
                    now.values[c, child] = -rate * s[0] / (s[1] + shrink)
                    table.append([CLASSES * number + c, child, None, None, None, float(now.values[c, child])])
                    grown.add((c, child))
                lighter.add((c, 2 * node + (left[c, n, f, b, 1] > left[c, n, f, -1, 1] / 2)))
            open_ = grown
            if not grown:
                break
        work.advance(now)
    losses.append(_sums(work, Round(depth), 0, root & False)[1] / UNIT / total)
    work.close()
    rows_ = [(t, n, f, x, g, float(v)) for t, n, f, x, g, v in sorted(table, key=lambda r: r[:2])]
    nodes = cut(spark.createDataFrame(rows_, NODE_SCHEMA).coalesce(1), "boosted-nodes")
    return Boosted(nodes, CLASSES * rounds, depth, losses, list(names))


def predict(model: Boosted, rows: DataFrame, values: Column | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``prediction`` and the class probabilities: the soft-max of the summed leaf values.

    Values are added as whole multiples of 10^-12, in any order; the lower class among equals.
    ``keep`` names the columns that stay, all if not given.
    """
    values = vector_to_array("features") if values is None else values
    keep = rows.columns if keep is None else list(keep)

    value = F.round(F.col("value") * 1e12).cast("long")
    leaves = model.nodes.select("tree", "node", *[
        F.when(F.col("tree") % CLASSES == c, value).otherwise(0).alias(f"s{c}") for c in range(CLASSES)])
    summed = summed_leaves(rows, model.nodes, leaves, model.trees, model.depth, values, keep)
    scores = [F.get("_sums", F.lit(c)) for c in range(CLASSES)]
    odds = [F.exp((s - F.greatest(*scores)) / 1e12) for s in scores]
    total = odds[0] + odds[1] + odds[2]
    return summed.select(*keep, most_likely(scores).alias("prediction"),
                         *[(o / total).alias(f"p_{v.lower()}") for o, v in zip(odds, RISK_LABELS)])
