"""Exact quantiles and ordered running totals that no single task has to hold.

``percentile`` keeps every distinct value of a group in one buffer. Here a
mergeable sketch first brackets each wanted rank, brackets that still hold many
values are narrowed by further sketches of what is inside, and only the few values
left are counted, ordered and searched.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import cut

ACCURACY = 20_000  # rank error of the sketch is at most rows / ACCURACY
HELD = 1_000  # a bracket with more values between its ends is narrowed
GRID = 256  # parts a bracket is narrowed by; the sketch is far finer


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    by: Sequence[str] = (), accuracy: int = ACCURACY, held: int = HELD) -> DataFrame:
    """Interpolated quantiles: one row per group, column and probability.

    Returns ``by..., column, prob, value``; nulls are left out and a column
    without values gets a null. Columns become rows first, so one small plan
    serves any number of them. ``df`` is read three times (sketch, rows below
    each bracket, values inside), so pass a stored table rather than a long plan.

    The bracket of a rank reaches ``6 / accuracy`` of the rows and two rows more to either
    side, at any number of rows. Should a rank lie outside all the same, all brackets are
    widened eightfold and counted again. A bracket with more than ``held`` values between its
    ends is sketched by itself and cut to the few parts of it around the rank, again and again: each
    turn, two more reads, leaves about a fiftieth. So the last search sees ``held`` values a rank
    at most beside the two ends, whatever the number of rows.

    Building the frame runs these jobs. Without groups their results are a row per column, kept
    by the driver, and the values come last to it; with groups they are stored tables.
    """
    by, groups = list(by), [f"_g{i}" for i in range(len(by))]
    ranks = range(len(probs))
    plain = df.select(
        *[F.col(b).alias(g) for b, g in zip(by, groups)],
        *[F.col(c).cast("double").alias(c) for c in columns],
    ).unpivot(groups, list(columns), "_c", "_v")

    pad, misses = 6.0 / accuracy, True
    while misses:
        brackets = _kept(plain.groupBy(*groups, "_c").agg(
            F.expr(_brackets(probs, pad, accuracy)).alias("_b")), groups, "quantile-brackets")
        data, counts = _counted(plain, brackets, groups, probs)
        position = lambda j: f"(_n - 1) * {float(probs[j])}D"
        misses = pad < 1 and not counts.where("_n > 0 AND (" + " OR ".join(
            f"_under[{j}] > floor({position(j)}) OR _under[{j}] + _in[{j}] <= ceil({position(j)})"
            for j in ranks) + ")").isEmpty()
        pad *= 8
    full = " OR ".join(f"_between[{j}] > {held}" for j in ranks)
    while not counts.where(full).isEmpty():
        brackets = _kept(_narrowed(data, brackets, counts, groups, probs, accuracy, held), groups, "quantile-brackets")
        data, counts = _counted(plain, brackets, groups, probs)

    inside = " OR ".join(_within(j) for j in ranks)
    values = data.where(inside).groupBy(*groups, "_c", "_v").agg(F.expr("count(1) AS _m"))
    if not groups:
        return _looked_up(df, columns, probs, counts, brackets, values)
    hits = ", ".join(f"if({_within(j)}, {j}, NULL)" for j in ranks)
    values = _same_group(values, brackets, groups, "_c").select(
        *groups, "_c", "_v", "_m", F.expr(f"explode(array_compact(array({hits}))) AS _t"))
    wanted = _by_rank(counts, groups, probs)
    upto = Window.partitionBy(*groups, "_c", "_t").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ranked = _same_group(wanted, values, groups, "_c", "_t").withColumn(
        "_cum", F.col("_below") + F.sum("_m").over(upto))
    found = ranked.groupBy(*groups, "_c", "_t", "prob", "_n", "_pos", "_below").agg(
        F.expr("min(if(_cum > floor(_pos), _v, NULL)) AS _v0"),
        F.expr("min(if(_cum > ceil(_pos), _v, NULL)) AS _v1"))
    return found.select(
        *[F.col(g).alias(b) for b, g in zip(by, groups)], F.col("_c").alias("column"), "prob",
        F.expr("_v0 + (_v1 - _v0) * (_pos - floor(_pos)) AS value"))


def _within(j: int) -> str:
    return f"_v BETWEEN _b[{2 * j}] AND _b[{2 * j + 1}]"


def _kept(state: DataFrame, groups: Sequence[str], name: str) -> DataFrame:
    """A row per column as a constant of the plan; with groups, a stored table.

    Either way its true size decides between broadcast and shuffle join.
    """
    return cut(state, name) if groups else _constant(state.sparkSession, state.collect(), state.schema.simpleString())


def _constant(spark, rows: Sequence, kind: str) -> DataFrame:
    """A few rows as part of the plan, so that Spark knows how few they are."""
    def literal(value):
        if isinstance(value, (list, tuple)):
            return F.array(*[literal(v) for v in value])
        return F.lit(value)

    names = [f.split(":")[0] for f in kind.removeprefix("struct<").removesuffix(">").split(",")]
    items = [F.struct(*[literal(v).alias(n) for n, v in zip(names, r)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*items).cast(f"array<{kind}>")))


def _counted(plain: DataFrame, brackets: DataFrame, groups: Sequence[str], probs: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """The values beside their brackets, and per column: values, those below, inside and between the ends of each bracket."""
    ranks = range(len(probs))
    data = _same_group(plain, brackets, groups, "_c")
    return data, _kept(data.groupBy(*groups, "_c").agg(
        F.expr("count(_v) AS _n"),
        F.expr("array(" + ", ".join(f"count_if(_v < _b[{2 * j}])" for j in ranks) + ") AS _under"),
        F.expr("array(" + ", ".join(f"count_if({_within(j)})" for j in ranks) + ") AS _in"),
        F.expr("array(" + ", ".join(f"count_if(_v > _b[{2 * j}] AND _v < _b[{2 * j + 1}])" for j in ranks) + ") AS _between")),
        groups, "quantile-counts")


def _by_rank(counts: DataFrame, groups: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """A row per column and rank, with the rank's position."""
    probabilities = ", ".join(f"{float(p)}D" for p in probs)
    return counts.select(*groups, "_c", "_n", "_in", "_between", F.expr("posexplode(_under) AS (_t, _below)")).withColumn(
        "prob", F.expr(f"array({probabilities})[_t]")).withColumn("_pos", F.expr("(_n - 1) * prob"))


def _narrowed(data: DataFrame, brackets: DataFrame, counts: DataFrame, groups: Sequence[str],
              probs: Sequence[float], accuracy: int, held: int) -> DataFrame:
    """Brackets around the same ranks, those of many values cut to a few of ``GRID`` parts of what they hold."""
    hits = ", ".join(f"if({_within(j)} AND _b[{2 * j}] < _b[{2 * j + 1}], {j}, NULL)" for j in range(len(probs)))
    # many equal values end up as an end of a bracket, so that what is between its ends always shrinks
    parts = ", ".join(f"{k / GRID}D" for k in range(GRID + 1))
    grid = data.select(*groups, "_c", "_v", F.expr(f"explode(array_compact(array({hits}))) AS _t")).groupBy(
        *groups, "_c", "_t").agg(F.expr(f"percentile_approx(_v, array({parts}), {max(accuracy, 8 * GRID)}) AS _grid"))
    wanted = _same_group(_by_rank(counts, groups, probs), brackets, groups, "_c")
    wanted = _same_group(wanted, grid, groups, "_c", "_t")
    # a part more to either side than the rank needs: the sketch errs by far less
    low = f"_grid[CAST(greatest(floor((floor(_pos) - _below) / _in[_t] * {GRID}) - 1, 0) AS INT)]"
    high = f"_grid[CAST(least(ceil((ceil(_pos) - _below + 1) / _in[_t] * {GRID}) + 1, {GRID}) AS INT)]"
    many = f"_grid IS NOT NULL AND _between[_t] > {held}"
    ends = wanted.select(*groups, "_c", "_t", F.expr(f"if({many}, {low}, _b[2 * _t]) AS _low"),
                         F.expr(f"if({many}, {high}, _b[2 * _t + 1]) AS _high"))
    return ends.groupBy(*groups, "_c").agg(F.expr(
        "flatten(transform(array_sort(collect_list(struct(_t, _low, _high))), x -> array(x._low, x._high))) AS _b"))


def _looked_up(df: DataFrame, columns: Sequence[str], probs: Sequence[float], counts: DataFrame, brackets: DataFrame,
               values: DataFrame) -> DataFrame:
    """The quantiles of whole columns: a few values per column and rank are searched by the driver."""
    sizes = {r["_c"]: r for r in counts.collect()}
    ends = {r["_c"]: r["_b"] for r in brackets.collect()}
    held: dict[str, list] = {}
    for r in values.collect():
        held.setdefault(r["_c"], []).append((r["_v"], r["_m"]))
    rows = []
    for c in dict.fromkeys(columns):
        found = sorted(held.get(c, []), key=lambda r: (math.isnan(r[0]), r[0]))
        for j, p in enumerate(probs):
            n = sizes[c]["_n"] if c in sizes else 0
            if not n:
                rows.append((c, float(p), None))
                continue
            at, seen, picked = (n - 1) * float(p), sizes[c]["_under"][j], [None, None]
            for value, times in found:
                if not (ends[c][2 * j] <= value <= ends[c][2 * j + 1] or math.isnan(value)):
                    continue
                seen += times
                for k, place in enumerate((math.floor(at), math.ceil(at))):
                    if picked[k] is None and seen > place:
                        picked[k] = value
            rows.append((c, float(p), picked[0] + (picked[1] - picked[0]) * (at - math.floor(at))))
    return _constant(df.sparkSession, rows, "struct<column:string,prob:double,value:double>")


def _brackets(probs: Sequence[float], pad: float, accuracy: int) -> str:
    """Low and high end per rank: the sketch's values ``pad`` and two rows to either side.

    A sketch wants its fractions fixed, so it is asked for pads that double, and the first
    that is wide enough for the count is taken; the last reaches from end to end.
    """
    pads = [pad]
    while pads[-1] < 1:
        pads.append(pads[-1] * 2)
    ends = ", ".join(str(min(max(p + s * w, 0.0), 1.0)) + "D" for w in pads for p in probs for s in (-1, 1))
    size = 2 * len(probs)
    which = "CASE " + " ".join(
        f"WHEN {w - pad}D * count(_v) >= 2 THEN {k}" for k, w in enumerate(pads)) + f" ELSE {len(pads) - 1} END"
    return f"slice(percentile_approx(_v, array({ends}), {accuracy}), {size} * ({which}) + 1, {size})"


def _same_group(left: DataFrame, right: DataFrame, groups: Sequence[str],
                *keys: str) -> DataFrame:
    """Left join on group columns, nulls being equal, and on plain keys."""
    names = {k: f"_r{k}" for k in (*groups, *keys)}
    other = right.withColumnsRenamed(names)
    match = [left[g].eqNullSafe(other[names[g]]) for g in groups]
    match += [left[k] == other[names[k]] for k in keys]
    return left.join(other, match, "left").drop(*names.values())


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact median per column, as plain numbers (one per column)."""
    rows = exact_quantiles(df, columns, [0.5]).collect()
    return {r["column"]: r["value"] for r in rows}


def running_totals(df: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = (),
                   descending: bool = False) -> DataFrame:
    """Add ``<name>_upto``, the total from the first row up to this one, and ``<name>_next``.

    Rows must be unique per ``by`` and ``order``; ``_next`` is null on the last row of a
    group. Spark deals the rows by ranges of ``by`` and ``order`` taken from a sample, so the
    slices are even within every group and their number follows the size and the shuffle
    partitions. Each slice is summed by itself, and what crosses a border (one row per group
    and slice) is carried over. ``df`` is sampled before it is dealt: pass a stored table.
    """
    by = list(by)
    # stored, because a slice is named by the task that wrote it
    sliced = cut(df.repartitionByRange(*by, order).withColumn("_slice", F.spark_partition_id()),
                 "ordered-slices")
    direction, first_by = (F.desc, F.max_by) if descending else (F.asc, F.min_by)
    total = sliced.groupBy(*by, "_slice").agg(
        *[F.sum(s).alias(f"_all_{s}") for s in sums],
        *[first_by(s, order).alias(f"_first_{s}") for s in sums])
    along = Window.partitionBy(*by).orderBy(direction("_slice"))
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = total.select(
        *[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("_slice").alias("_slice_of"),
        *[F.coalesce(F.sum(f"_all_{s}").over(before), F.lit(0)).alias(f"_before_{s}")
          for s in sums],
        *[F.lead(f"_first_{s}").over(along).alias(f"_after_{s}") for s in sums])
    match = [sliced[b].eqNullSafe(carried[f"_by{i}"]) for i, b in enumerate(by)]
    joined = sliced.join(carried, [*match, sliced["_slice"] == carried["_slice_of"]])
    within = Window.partitionBy(*by, "_slice").orderBy(direction(order))
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.select(
        *df.columns,
        *[(F.col(f"_before_{s}") + F.sum(s).over(upto)).alias(f"{s}_upto") for s in sums],
        *[F.coalesce(F.lead(s).over(within), f"_after_{s}").alias(f"{s}_next") for s in sums])
