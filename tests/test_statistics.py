"""Quantiles, running totals, histograms, evaluation and the split against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tellerlake.operators import evaluation, features, quantiles, stats


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, heavy ties, and a long tail of large values."""
    rng = random.Random(7)
    rows = []
    for i in range(30_000):
        group = "hot" if i % 3 == 0 else rng.choice("abcd")
        value = 5.0 if rng.random() < 0.3 else rng.lognormvariate(0, 6)
        rows.append((group, None if rng.random() < 0.05 else value, float(i % 10)))
    rows += [(None, 1.5, 0.0), (None, 2.5, 0.0), ("empty", None, 1.0)]
    pdf = pd.DataFrame(rows, columns=["g", "x", "y"])
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(16).cache()
    return df, pdf


@pytest.mark.parametrize("accuracy", [200, 20_000])
def test_quantiles_match_numpy(skewed, accuracy):
    df, pdf = skewed
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r["column"], r["prob"]): r["value"]
           for r in quantiles.exact_quantiles(df, ["x", "y"], probs, accuracy=accuracy).collect()}
    for c in ("x", "y"):
        for p in probs:
            assert got[c, p] == pytest.approx(pdf[c].quantile(p), rel=1e-12), (c, p)


@pytest.mark.parametrize("accuracy", [200, 2_500])
def test_grouped_quantiles_match_pandas(skewed, accuracy):
    df, pdf = skewed
    got = {(r["g"], r["prob"]): r["value"]
           for r in quantiles.exact_quantiles(df, ["x"], [0.25, 0.5], by=["g"], accuracy=accuracy).collect()}
    assert len(got) == 2 * 7
    for g, part in pdf.groupby("g", dropna=False):
        for p in (0.25, 0.5):
            want = part["x"].quantile(p)
            key = (None if isinstance(g, float) else g, p)
            assert got[key] == (None if np.isnan(want) else pytest.approx(want, rel=1e-12))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 999, 1000, 1001, 1500])
def test_median_of_every_size(spark, n):
    df = spark.range(n).select((F.col("id") * F.col("id") % 101).cast("double").alias("v"))
    want = float(np.median([i * i % 101 for i in range(n)]))
    assert quantiles.medians(df, ["v"]) == {"v": want}
    assert quantiles.exact_quantiles(df, ["v"], [0.5], accuracy=50).first()["value"] == want


def test_ranks_outside_their_brackets_are_searched_again(spark, monkeypatch):
    """A sketch that answers with one value brackets nothing at first."""
    whole = quantiles._brackets
    monkeypatch.setattr(quantiles, "_brackets", lambda probs, pad, accuracy: whole(
        probs, pad, accuracy) if pad > 0.1 else f"array_repeat(min(_v), {2 * len(probs)})")
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    got = [r["value"] for r in quantiles.exact_quantiles(df, ["v"], [0.25, 0.5], accuracy=200).collect()]
    assert sorted(got) == [250.0, 500.0]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_full_brackets_are_narrowed(skewed, by):
    """A coarse sketch leaves hundreds of values in a bracket; equal ones cannot be told apart and need not."""
    df, pdf = skewed
    probs = [0.0, 0.1, 0.25, 0.5, 0.97, 1.0]
    got = quantiles.exact_quantiles(df, ["x", "y"], probs, by=by, accuracy=100, held=5).collect()
    for r in got:
        part = pdf if not by else pdf[pdf["g"].isna()] if r["g"] is None else pdf[pdf["g"] == r["g"]]
        want = part[r["column"]].quantile(r["prob"])
        assert r["value"] == (None if np.isnan(want) else pytest.approx(want, rel=1e-12)), r
    assert len(got) == 12 * (7 if by else 1)


def test_ten_million_distinct_values(spark, monkeypatch):
    """What is searched in the end does not grow with the rows."""
    df = spark.range(10_000_000).select(((F.col("id") * 7_654_321 + 5) % 10_000_019).cast("double").alias("v"))
    seen, search = [], quantiles._looked_up
    monkeypatch.setattr(quantiles, "_looked_up", lambda *a: seen.append(a[-1].count()) or search(*a))
    got = {r["prob"]: r["value"] for r in quantiles.exact_quantiles(df, ["v"], [0.25, 0.5, 0.999]).collect()}
    values = np.sort((np.arange(10_000_000) * 7_654_321 + 5) % 10_000_019)
    assert got == {p: pytest.approx(np.quantile(values, p), rel=1e-12) for p in got} and len(got) == 3
    assert seen[0] <= 3 * (quantiles.HELD + 2)


def test_slices_are_even_in_a_narrow_group(spark):
    """A group whose values lie close together is cut like any other."""
    df = spark.range(20_000).select(
        (F.col("id") % 2).alias("g"), F.lit(1).alias("m"),
        F.when(F.col("id") % 2 == 0, F.col("id") * 1e-9).otherwise(F.col("id")).cast("double").alias("k"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = quantiles.running_totals(df, "k", ["m"], by=["g"])
        totals = {r.g: r.top for r in out.groupBy("g").agg(F.max("m_upto").alias("top")).collect()}
        assert totals == {0: 10_000, 1: 10_000}
        stored = [r[1] for r in quantiles.cut(df.repartitionByRange("g", "k").withColumn(
            "s", F.spark_partition_id()), "even").groupBy("s").count().collect()]
        assert len(stored) == 8 and max(stored) < 4_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    rng = random.Random(3)
    keys = {g: rng.sample(range(10_000), n) for g, n in (("a", 1), ("b", 900), ("c", 40))}
    rows = [(g, float(k), rng.randint(0, 5)) for g, ks in keys.items() for k in ks]
    df = spark.createDataFrame(rows, "g string, k double, m int").repartition(8).cache()
    got = {(r.g, r.k): (r.m_upto, r.m_next) for r in quantiles.running_totals(
        df, "k", ["m"], by=["g"], descending=descending).collect()}
    assert len(got) == len(rows)
    for g in keys:
        part = sorted((r for r in rows if r[0] == g), key=lambda r: r[1], reverse=descending)
        total = 0
        for i, (_, k, m) in enumerate(part):
            total += m
            assert got[g, k] == (total, part[i + 1][2] if i + 1 < len(part) else None)


def bins_of(df, column, bins):
    return [r.Count for r in stats.histogram(df, column, bins).orderBy("bin").collect()]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(i), 5, None) for i in range(5)], "x double, c int, n int")
    assert bins_of(df, "x", 4) == [1, 1, 1, 2]
    assert bins_of(df, "c", 4) == np.histogram([5] * 5, bins=4)[0].tolist()
    assert bins_of(df, "n", 3) == [0, 0, 0]


def test_histogram_counts_everything(bank):
    for column, bins in (("Age", 30), ("Debt_to_Income_Ratio", 40), ("Account_Balance", 50)):
        assert sum(bins_of(bank, column, bins)) == bank.count()


def test_counts_leave_nulls_out(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), (None, "x"), ("b", "x")], "k string, l string")
    assert [tuple(r) for r in stats.value_counts(df, "k").collect()] == [("a", 2), ("b", 1)]
    assert {tuple(r) for r in stats.crosstab_long(df, ["k", "l"]).collect()} == {("a", "x", 1), ("b", "x", 1)}
    listed = stats.counts_in_order(df, "k", ["z", "b", "a"]).collect()
    assert [tuple(r) for r in listed] == [("z", None), ("b", 1), ("a", 2)]
    wide = {r.k: (r.x, r.y) for r in stats.crosstab_wide(df, "k", "l", ["x", "y"]).collect()}
    assert wide == {"a": (1, 0), "b": (1, 0)}


def test_correlation_is_pairwise_complete(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 3, 4, None], "b": [2.0, 1, 4, None, 5], "c": [1.0] * 5})
    df = spark.createDataFrame(pdf).select(*[F.nanvl(c, F.lit(None)).alias(c) for c in pdf])
    got = {(r.a, r.b): r.r for r in stats.correlation_matrix(df, list(pdf)).collect()}
    assert len(got) == 9 and got["a", "b"] == got["b", "a"]
    assert got["a", "b"] == pytest.approx(pdf["a"].corr(pdf["b"]), abs=1e-9)
    assert got["a", "c"] is None
    empty = stats.correlation_matrix(df.limit(0), list(pdf)).collect()
    assert len(empty) == 9 and {r.r for r in empty} == {None}


def test_empty_filter(bank):
    none = stats.select_customers(bank, age=(200, 300), genders=["Male"])
    assert none.count() == 0
    assert stats.select_customers(bank).count() == bank.count()


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, s0 double, s1 double, s2 double")


def brute_auc(label, score):
    pos = [s for y, s in zip(label, score) if y]
    neg = [s for y, s in zip(label, score) if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0, 0, 0, 1, 2]), *[rng.randint(0, 30) / 7 for _ in range(3)]) for _ in range(500)]
    labels = [r[0] for r in rows]
    want = sum(
        brute_auc([y == c for y in labels], [r[1 + c] for r in rows]) * labels.count(c) / len(rows)
        for c in range(3))
    df = scored(spark, rows).repartition(8)
    assert evaluation.auc_weighted(df, "label", ["s0", "s1", "s2"]).first()[0] == pytest.approx(want, abs=1e-9)


def test_auc_extremes(spark):
    rows = [(0, 2.0, 0.0, 0.0), (1, 1.0, 1.0, 0.0), (2, 0.0, 2.0, 0.0)]
    points = evaluation._auc(evaluation.roc_points(scored(spark, rows), "label", ["s0", "s1", "s2"]))
    assert {r["class"]: r.AUC for r in points.collect()} == {0: 1.0, 1: 0.5, 2: 0.5}
    one = scored(spark, [(0, 1.0, 1.0, 1.0), (0, 2.0, 1.0, 1.0)])
    assert all(r.AUC is None for r in evaluation._auc(
        evaluation.roc_points(one, "label", ["s0", "s1", "s2"])).collect())


def test_auc_of_reversed_scores(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), rng.random(), 0.0, 0.0) for _ in range(200)]
    df = scored(spark, rows).select("label", "s0", (-F.col("s0")).alias("neg"))
    area = lambda c: evaluation._auc(evaluation.roc_points(df, "label", [c])).first().AUC
    assert area("s0") + area("neg") == pytest.approx(1.0)


def test_confusion_and_scores(spark):
    rows = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(2, 0)]
    df = spark.createDataFrame(rows, "label int, p int")
    matrix = {r.Actual: (r.Low, r.Medium, r.High) for r in
              evaluation.confusion_matrix(df, "label", "p").collect()}
    assert matrix == {"Low": (5, 2, 0), "Medium": (0, 3, 0), "High": (1, 0, 0)}
    got = evaluation.weighted_scores(df, "label", "p").first()
    assert got.Recall == round(8 / 11, 4)
    assert got.Precision == round((7 * 5 / 6 + 3 * 3 / 5 + 0) / 11, 4)
    assert got.F1_Weighted == round((7 * 10 / 13 + 3 * 6 / 8) / 11, 4)


def test_split_is_exact_and_stable(spark):
    df = spark.range(9_001).select(
        F.format_string("CUST%06d", "id").alias("Customer_ID"),
        F.when(F.col("id") < 6_000, 0).when(F.col("id") < 9_000, 1).otherwise(2).alias("label"))
    split = features.stratified_split(df)
    counts = {(r.label, r.is_test): r["count"] for r in split.groupBy("label", "is_test").count().collect()}
    assert counts == {(0, True): 1200, (0, False): 4800, (1, True): 600, (1, False): 2400, (2, False): 1}
    other = features.stratified_split(df.repartition(13))
    assert split.exceptAll(other).count() == 0
    assert features.stratified_split(df, seed=1).exceptAll(split).count() > 0
