"""Classifier evaluation: AUC, ROC curves, confusion matrix, weighted scores, comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RISK_LABELS
from ..sources.files import METRICS_SCHEMA
from ..sources.store import cut
from .quantiles import running_totals

CLASSES = list(range(len(RISK_LABELS)))


def _tally(df: DataFrame, label: str, scores: Sequence[str]) -> DataFrame:
    """Positives and negatives per class and distinct score, stored.

    Equal scores collapse map-side, so all that follows grows with the number of
    distinct scores only.
    """
    cells = F.array(*[
        F.struct(F.lit(c).alias("class"), F.col(s).cast("double").alias("score"),
                 F.when(F.col(label) == c, 1).otherwise(0).alias("hit"))
        for c, s in enumerate(scores)
    ])
    long = df.select(F.explode(cells).alias("e")).select("e.*")
    return cut(long.groupBy("class", "score").agg(
        F.sum("hit").alias("pos"), F.sum(1 - F.col("hit")).alias("neg")), "score-tally")


def roc_points(df: DataFrame, label: str, scores: Sequence[str]) -> DataFrame:
    """Running positives and negatives per class from the highest score down."""
    return running_totals(_tally(df, label, scores), "score", ["pos", "neg"], by=["class"],
                          descending=True)


def _auc(points: DataFrame) -> DataFrame:
    """Area per class: a positive beats every negative below it and half of those level."""
    above = F.col("pos_upto") - F.col("pos") / 2
    return points.groupBy("class").agg(
        F.sum(F.col("neg") * above).alias("wins"), F.sum("pos").alias("P"), F.sum("neg").alias("N"),
    ).withColumn("AUC", F.try_divide(F.col("wins"), (F.col("P") * F.col("N")).cast("double")))


def auc_weighted(df: DataFrame, label: str, scores: Sequence[str], digits: int = 9) -> DataFrame:
    """One-vs-rest AUC, weighted by how many rows each class has."""
    per_class = _auc(roc_points(df, label, scores))
    return per_class.agg(F.round(
        F.sum(F.col("AUC") * F.col("P")) / F.sum("P"), digits).alias("ROC_AUC"))


def roc_curve(df: DataFrame, label: str, scores: Sequence[str]) -> DataFrame:
    """Per class: corner points of the curve (fpr, tpr, threshold) and the class AUC.

    Points on a straight piece are left out; each curve starts at (0, 0) with an
    infinite threshold.
    """
    points = cut(roc_points(df, label, scores), "roc-points")
    area = _auc(points).select(F.col("class").alias("_class"), "P", "N",
                               F.round("AUC", 9).alias("AUC"))
    total = points.join(area, F.col("class") == F.col("_class"))
    first = (F.col("pos_upto") == F.col("pos")) & (F.col("neg_upto") == F.col("neg"))
    last = F.col("pos_next").isNull()
    corner = (F.col("pos") != F.col("pos_next")) | (F.col("neg") != F.col("neg_next"))
    fpr = F.try_divide(F.col("neg_upto").cast("double"), F.col("N").cast("double"))
    tpr = F.try_divide(F.col("pos_upto").cast("double"), F.col("P").cast("double"))
    curve = total.where(first | last | corner).select(
        "class", fpr.alias("fpr"), tpr.alias("tpr"), F.col("score").alias("threshold"), "AUC")
    start = area.select(
        F.col("_class").alias("class"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
        F.lit(float("inf")).alias("threshold"), "AUC")
    return curve.unionByName(start)


def _cells(label: str, prediction: str) -> list[Column]:
    return [F.count_if((F.col(label) == a) & (F.col(prediction) == p)).alias(f"c{a}{p}")
            for a in CLASSES for p in CLASSES]


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows are actual classes, columns predicted ones; empty cells are 0. One pass."""
    row = df.agg(*_cells(label, prediction))
    lines = F.array(*[
        F.struct(F.lit(RISK_LABELS[a]).alias("Actual"),
                 *[F.col(f"c{a}{p}").alias(RISK_LABELS[p]) for p in CLASSES]) for a in CLASSES])
    return row.select(F.explode(lines).alias("s")).select("s.*")


def weighted_scores(df: DataFrame, label: str, prediction: str, digits: int = 4) -> DataFrame:
    """Support-weighted F1, precision and recall; a division by zero counts as 0."""
    row = df.agg(*_cells(label, prediction))
    cell = lambda a, p: F.col(f"c{a}{p}").cast("double")
    n = sum((cell(a, p) for a in CLASSES for p in CLASSES), F.lit(0.0))
    safe = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    out = {"F1_Weighted": F.lit(0.0), "Precision": F.lit(0.0), "Recall": F.lit(0.0)}
    for c in CLASSES:
        hit = cell(c, c)
        said = sum((cell(a, c) for a in CLASSES), F.lit(0.0))
        real = sum((cell(c, p) for p in CLASSES), F.lit(0.0))
        out["F1_Weighted"] = out["F1_Weighted"] + real * safe(2 * hit, said + real)
        out["Precision"] = out["Precision"] + real * safe(hit, said)
        out["Recall"] = out["Recall"] + hit
    return row.select(*[F.round(safe(v, n), digits).alias(k) for k, v in out.items()])


def evaluate(scored: DataFrame, name: str) -> tuple:
    """(model, ROC AUC, F1, precision, recall) of scored test rows, four digits each."""
    auc = auc_weighted(scored, "label", ["p_low", "p_medium", "p_high"], 4).first()[0]
    rest = weighted_scores(scored, "label", "prediction").first()
    return (name, auc, rest["F1_Weighted"], rest["Precision"], rest["Recall"])


def comparison(spark: SparkSession, results: Sequence[tuple]) -> DataFrame:
    """One row per model; the first with the highest AUC carries the mark."""
    best = max(results, key=lambda r: r[1])[0]
    rows = [(*r, "✓" if r[0] == best else "") for r in results]
    return spark.createDataFrame(rows, METRICS_SCHEMA)
