"""Counts, cross tables, histograms and summaries, parameterised by column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import share
from ..functions.text import rupees
from ..schema import CORRELATED_COLUMNS
from .quantiles import exact_quantiles


def value_counts(df: DataFrame, column: str, name: str | None = None, top: int | None = None,
                 order: str = "count") -> DataFrame:
    """Rows per value, missing values left out, most frequent (or lowest key) first."""
    name = name or column
    counts = (df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(name))
              .agg(F.count(F.lit(1)).alias("Count")))
    keys = [F.col(name)] if order == "key" else [F.desc("Count"), F.col(name)]
    counts = counts.orderBy(*keys)
    return counts if top is None else counts.limit(top)


def counts_in_order(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows per listed value, in list order; a value that never occurs has a null count."""
    hits = [F.count_if(F.col(column) == v) for v in values]
    row = df.agg(*[F.when(h > 0, h).alias(v) for v, h in zip(values, hits)])
    position = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))
    return row.unpivot([], list(values), column, "Count").orderBy(position)


def crosstab_long(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    known = df.dropna(subset=list(keys))
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("Count")).orderBy(*keys)


def crosstab_wide(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """One row per ``row`` value, one count column per listed ``column`` value."""
    return (df.where(F.col(row).isNotNull()).groupBy(row).pivot(column, list(values))
            .agg(F.count(F.lit(1))).fillna(0, subset=list(values)))


def group_mean(df: DataFrame, key: str, value: str, scale: float = 1.0,
               name: str | None = None, digits: int | None = None) -> DataFrame:
    """Mean of ``value`` times ``scale`` per key, highest first.

    ``digits`` rounds away the last bits of a sum of fractions, which depend on
    the order of addition.
    """
    name = name or value
    mean = F.avg(value) * scale
    mean = mean if digits is None else F.round(mean, digits)
    return (df.where(F.col(key).isNotNull()).groupBy(key)
            .agg(mean.alias(name)).orderBy(F.desc(name), key))


def group_share(df: DataFrame, keys: Sequence[str], predicate: Column,
                name: str = "Pct") -> DataFrame:
    """Percentage of rows per key for which ``predicate`` holds."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(share(predicate).alias(name))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed; empty bins are kept.

    A constant column gets a range of one around its value, an empty one [0, 1].
    """
    x = F.col(column).cast("double")
    rows = df.where(x.isNotNull()).select(x.alias("x"))
    lo, hi = F.min("x"), F.max("x")
    span = rows.agg(
        F.coalesce(F.when(lo == hi, lo - 0.5).otherwise(lo), F.lit(0.0)).alias("lo"),
        F.coalesce(F.when(lo == hi, hi + 0.5).otherwise(hi), F.lit(1.0)).alias("hi"),
    ).select(F.struct("lo", "hi").alias("span"))
    low = span.scalar()["lo"]
    width = (span.scalar()["hi"] - low) / F.lit(float(bins))
    slot = F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1).cast("bigint"))
    counts = rows.groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("Count"))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(counts, "bin", "left").select(
        "bin", (low + F.col("bin") * width).alias("bin_start"),
        (low + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("Count", F.lit(0).cast("bigint")).alias("Count"))


def five_numbers(df: DataFrame, key: str, value: str) -> DataFrame:
    """Minimum, quartiles, maximum and the 1.5 IQR fences of ``value`` per key."""
    rows = df.where(F.col(key).isNotNull())
    ends = rows.groupBy(key).agg(F.min(value).cast("double").alias("min"),
                                 F.max(value).cast("double").alias("max"))
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("value")))
    quartiles = exact_quantiles(rows, [value], [0.25, 0.5, 0.75], by=[key]).groupBy(key).agg(
        at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"))
    spread = F.col("q3") - F.col("q1")
    return ends.join(quartiles, key).select(
        key, "min", "q1", "median", "q3", "max",
        (F.col("q1") - spread * 1.5).alias("lower_fence"),
        (F.col("q3") + spread * 1.5).alias("upper_fence"))


def describe(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 2) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles per numeric column.

    Columns become rows first: one small plan for any number of columns, with all
    aggregation done map-side before the exchange.
    """
    numeric = ("bigint", "int", "double", "float", "smallint", "tinyint")
    columns = list(columns) if columns else [c for c, t in df.dtypes if t in numeric]
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "column", "value")
    basics = long.groupBy("column").agg(
        F.count("value").cast("double").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("value")))
    quartiles = (exact_quantiles(df, columns, [0.25, 0.5, 0.75]).groupBy("column")
                 .agg(at(0.25).alias("q25"), at(0.5).alias("q50"), at(0.75).alias("q75")))
    joined = basics.join(quartiles, "column")
    names = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    return joined.select("column", *[F.round(n, digits).alias(n) for n in names])


def describe_rupees(df: DataFrame, column: str) -> DataFrame:
    """The figures of :func:`describe` for one column as rows, with rupee text."""
    row = describe(df, [column], digits=6)
    names = [c for c in row.columns if c != "column"]
    return row.select(*names).unpivot([], names, "statistic", "value").withColumn(
        "text", rupees(F.col("value")))


def describe_date(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, extremes and quartiles of a date column, as text to the second."""
    seconds = F.unix_date(column).cast("double") * 86400
    row = describe(df.select(seconds.alias(column)), [column], digits=0)
    moment = lambda c: F.date_format(
        F.timestamp_seconds(F.col(c)).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")
    return row.select("column", F.col("count").cast("bigint").alias("count"),
                      *[moment(c).alias(c) for c in ("mean", "min", "q25", "q50", "q75", "max")])


def correlation_matrix(df: DataFrame, columns: Sequence[str] = tuple(CORRELATED_COLUMNS),
                       digits: int = 9) -> DataFrame:
    """Pearson correlation of every ordered pair (a, b, r), pairwise complete.

    A column without spread has no correlation (null); the built-in ``corr`` would
    fail on it. Pairs become rows, so one scan and one small map-side aggregate
    serve any number of columns.
    """
    columns = list(columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    x, y = {}, {}
    for a, b in pairs:
        one, two = F.col(a).cast("double"), F.col(b).cast("double")
        x[a, b], y[a, b] = F.when(two.isNotNull(), one), F.when(one.isNotNull(), two)
    rows = df.select(F.posexplode(F.array(*[
        F.struct(x[p].alias("x"), y[p].alias("y")) for p in pairs])).alias("id", "v"))
    found = rows.select("id", "v.x", "v.y").groupBy("id").agg(F.round(F.try_divide(
        F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")), digits).alias("r"))
    # every pair has its rows, also where the table has none
    every = df.sparkSession.range(len(pairs)).withColumn("id", F.col("id").cast("int"))
    a, b = (F.get(F.array(*[F.lit(p[k]) for p in pairs]), F.col("id")) for k in (0, 1))
    both = F.array_distinct(F.array(F.struct(a.alias("a"), b.alias("b")),
                                    F.struct(b.alias("a"), a.alias("b"))))
    return every.join(found, "id", "left").select(F.explode(both).alias("s"), "r").select("s.*", "r")


def select_customers(df: DataFrame, age=None, genders=None, states=None, accounts=None,
                     score=None) -> DataFrame:
    """Customers inside every given filter; ranges include both ends, None means no filter."""
    tests = []
    for column, bounds in (("Age", age), ("Credit_Score", score)):
        if bounds is not None:
            tests.append(F.col(column).between(*bounds))
    for column, chosen in (("Gender", genders), ("State", states), ("Account_Type", accounts)):
        if chosen is not None:
            tests.append(F.col(column).isin(list(chosen)))
    for test in tests:
        df = df.where(test)
    return df
