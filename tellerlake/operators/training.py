"""Risk models: train, predict, explain, store and load.

Logistic regression is fitted by :mod:`logistic`; trees, forests and boosted trees are relations grown
by :mod:`trees` and :mod:`boosting`. Every kind can be stored as plain rows and applied to a customer
table from these rows alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import StandardScaler, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FEATURE_COLUMNS, RISK_LABELS
from . import boosting, logistic, trees
from .boosting import Boosted
from .trees import Trees

VERSION = 1
WEIGHT_SCHEMA = "class int, feature int, weight double"
RESULTS = ["prediction", *(f"p_{v.lower()}" for v in RISK_LABELS)]

# Display names in report order.
MODEL_NAMES = {
    "logistic": "Logistic Regression",
    "tree": "Decision Tree",
    "forest": "Random Forest",
    "boosted": "Boosted Trees",
}

# Sizes of the tree models.
TREE_SIZES = {
    "tree": {"trees": 1, "depth": 8, "least": 20},
    "forest": {"trees": 200, "depth": 10, "least": 10, "take": 5, "sampled": True},  # 5 of 29: the square root
}


@dataclass
class Linear:
    """Weights by class and feature on raw values: rows (class, feature, weight), feature -1 being the constant."""

    rows: DataFrame
    names: list[str] = field(default_factory=list)


Model = Trees | Boosted | Linear


def train(table: DataFrame, kind: str, **params) -> Model:
    """Fit one model on the training rows of a stored model table; ``params`` replace sizes."""
    rows = table.where(~F.col("is_test"))
    names = feature_names(table)
    if kind == "logistic":
        return Linear(table.sparkSession.createDataFrame(logistic.fit(rows), WEIGHT_SCHEMA), names)
    if kind in TREE_SIZES:
        return trees.grow(rows, names, **{**TREE_SIZES[kind], **params})
    if kind == "boosted":  # unweighted on purpose
        return boosting.fit(rows, names, **params)
    raise ValueError(f"unknown model kind {kind!r}")


def predict(model: Model, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``prediction`` and the class probabilities ``p_low``, ``p_medium``, ``p_high``.

    ``df`` has the vector ``features``; a loaded model also takes a table of its input columns.
    ``keep`` names the columns of ``df`` that stay: all if not given.
    """
    values = vector_to_array("features") if "features" in df.columns else None
    if isinstance(model, Loaded):
        model, values = model.model, model.values(df) if values is None else values
    if isinstance(model, Trees):
        return trees.predict(model, df, values, keep)
    if isinstance(model, Boosted):
        return boosting.predict(model, df, values, keep)
    return _linear(model, df, values).select(*(keep or df.columns), *RESULTS)


def _linear(model: Linear, df: DataFrame, values: Column) -> DataFrame:
    """Soft-max of weighted sums; one small array of weights a class."""
    found = {(r["class"], r.feature): r.weight for r in model.rows.collect()}  # classes * features rows
    size = len(model.names)
    kept = df.withColumn("_v", values)
    margins = {}
    for c in range(len(RISK_LABELS)):
        weights = F.array(*[F.lit(found.get((c, i), 0.0)) for i in range(size)])
        products = F.zip_with("_v", weights, lambda x, w: x * w)
        margins[f"_m{c}"] = F.aggregate(products, F.lit(found.get((c, -1), 0.0)), lambda a, x: a + x)
    kept = kept.withColumns(margins)
    scores = [F.col(m) for m in margins]
    odds = [F.exp(m - F.greatest(*scores)) for m in scores]
    total = odds[0] + odds[1] + odds[2]
    return kept.select(*df.columns, trees.most_likely(scores).alias("prediction"),
                       *[(o / total).alias(p) for o, p in zip(odds, RESULTS[1:])])


def linear_rows(model: Linear) -> list[tuple[int, int, float]]:
    """(class, feature, weight) on raw values; classes * features rows."""
    return [tuple(r) for r in model.rows.select("class", "feature", "weight").collect()]


def logistic_gradient(model: Linear, table: DataFrame) -> DataFrame:
    """(class, feature, gradient) of the penalised, weighted loss at the fitted weights.

    The loss has one minimum, so a gradient of nothing but zeros shows that it was found.
    One pass over the training rows; sums are made map-side, per feature.
    """
    rows = table.where(~F.col("is_test"))
    names = feature_names(table)
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(rows)
    weights = {(c, i): float(w * scaler.std[i]) for c, i, w in linear_rows(model) if i >= 0}
    scored = predict(model, scaler.transform(rows), ["label", "weight", "scaled"]).select(
        "label", "weight", F.array(*RESULTS[1:]).alias("p"), vector_to_array("scaled").alias("x"))
    miss = [F.col("weight") * (F.get("p", F.lit(c)) - (F.col("label") == c).cast("double"))
            for c in range(len(RISK_LABELS))]
    # the constant is the feature behind the last, with value 1 and without a penalty
    long = scored.select(*[m.alias(f"r{c}") for c, m in enumerate(miss)], "weight",
                         F.posexplode(F.concat("x", F.array(F.lit(1.0)))).alias("at", "v"))
    sums = long.groupBy("at").agg(F.sum("weight").alias("all"), *[
        F.sum(F.col(f"r{c}") * F.col("v")).alias(f"g{c}") for c in range(len(RISK_LABELS))])
    penalty = F.create_map(*[F.lit(v) for c in range(len(RISK_LABELS)) for i in range(len(names) + 1) for v in (
        c * 1000 + i, weights.get((c, i), 0.0))])
    titles = F.array(*[F.lit(n) for n in [*names, "constant"]])
    cells = F.array(*[F.struct(
        F.lit(c).alias("class"), F.get(titles, F.col("at")).alias("feature"),
        # the penalty of a feature is its weight over the summed row weights
        ((F.col(f"g{c}") + F.try_element_at(penalty, F.lit(c * 1000) + F.col("at"))) / F.col("all")).alias("gradient"))
        for c in range(len(RISK_LABELS))])
    return sums.select(F.explode(cells).alias("s")).select("s.*")


def feature_names(table: DataFrame) -> list[str]:
    """Names of the entries of the assembled vector, in order, as the column itself tells."""
    kinds = table.schema["features"].metadata["ml_attr"]["attrs"]
    return [a["name"] for a in sorted((a for k in kinds.values() for a in k),
                                      key=lambda a: a["idx"])]


def importances(model: Model, spark: SparkSession, names: Sequence[str],
                top: int | None = None) -> DataFrame:
    """(feature, importance) of the fitted vector's ``names``, highest first, ``top`` at most.

    Sums of split gains from the node rows. Empty for models that have none.
    """
    model = model.model if isinstance(model, Loaded) else model
    if not isinstance(model, Trees | Boosted):
        return spark.createDataFrame([], "feature string, importance double")
    if len(names) != len(model.names):
        raise ValueError(f"{len(model.names)} importances for {len(names)} features")
    return trees.importances(model.nodes, names, spark, top)


# -- stored models ---------------------------------------------------------------

@dataclass
class Loaded:
    """A stored model with the codes of its categories: scores tables of input columns."""

    model: Trees | Boosted | Linear
    name: str
    codes: dict[str, list[str]]

    def values(self, df: DataFrame) -> Column:
        """The feature values of a customer table, in order; a gap counts as 0, an unknown category fails."""
        return F.array(*[self._value(df, n) for n in self.model.names])

    def _value(self, df: DataFrame, name: str) -> Column:
        source = name.removesuffix("_enc")
        if name in df.columns or source not in self.codes:
            return F.expr(f"coalesce(nanvl(CAST({name} AS DOUBLE), NULL), 0D)")
        known = F.array(*[F.lit(v) for v in self.codes[source]])
        at = F.array_position(known, F.col(source))
        return F.when(at > 0, (at - 1).cast("double")).otherwise(F.raise_error(
            F.concat(F.lit(f"{source}: unknown value "), F.coalesce(F.col(source), F.lit("null")))).cast("double"))


def codes_of(encoders: StringIndexerModel) -> dict[str, list[str]]:
    return dict(zip(encoders.getInputCols(), map(list, encoders.labelsArray)))


def input_columns(names: Sequence[str], codes: dict[str, list[str]]) -> list[str]:
    """Columns of a customer table that the features come from."""
    return [n.removesuffix("_enc") if n.removesuffix("_enc") in codes else n for n in names]


def _hash(*parts) -> str:
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def save_model(model: Model, codes: dict[str, list[str]], name: str, path: str,
               names: Sequence[str] = tuple(FEATURE_COLUMNS)) -> None:
    """Store a model as rows: ``manifest``, ``features``, ``codes`` and ``model``.

    The manifest is written last and holds the version, the hash of the input columns and
    codes, and the number of model rows, so that a folder that was not written to its end, or
    whose parts do not belong together, is not taken for a model.
    """
    spark = SparkSession.active()
    model = model.model if isinstance(model, Loaded) else model
    names = model.names or list(names)
    kind = type(model).__name__
    rows = model.rows if isinstance(model, Linear) else model.nodes
    sizes = (0, 0, []) if isinstance(model, Linear) else (
        model.trees, model.depth, model.weights if isinstance(model, Trees) else [])
    _fs(spark, path)[0].delete(_fs(spark, f"{path}/manifest")[1], True)
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    spark.createDataFrame([(name, i, f) for i, f in enumerate(names)], "best_name string, position int, feature string"
                          ).coalesce(1).write.mode("overwrite").parquet(f"{path}/features")
    spark.createDataFrame([(c, v, i) for c, vs in codes.items() for i, v in enumerate(vs)],
                          "column string, value string, code int").coalesce(1).write.mode("overwrite").parquet(f"{path}/codes")
    manifest = [(VERSION, name, kind, *sizes, _hash(VERSION, *names, sorted(codes.items())), rows.count())]
    spark.createDataFrame(manifest, "version int, best_name string, kind string, trees int, depth int, "
                          "weights array<double>, inputs string, rows long").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/manifest")


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def load_model(spark: SparkSession, path: str, columns: Sequence[str] | None = None
               ) -> tuple[Loaded | None, DataFrame | None, str | None]:
    """(model, features, None), or (None, None, reason) when there is no usable model.

    Refused are folders without a manifest, another version, parts that do not belong to the
    manifest, and, where ``columns`` of the table to score are given, a table that lacks an input.
    """
    try:
        head = spark.read.parquet(f"{path}/manifest").first()
        features = spark.read.parquet(f"{path}/features")
        rows = spark.read.parquet(f"{path}/model")
        names = [r.feature for r in features.orderBy("position").collect()]
        codes: dict[str, list[str]] = {}
        for r in spark.read.parquet(f"{path}/codes").orderBy("column", "code").collect():
            codes.setdefault(r.column, []).append(r.value)
        found = rows.count()
    except Exception as ex:  # any unreadable artifact is reported, not raised
        return None, None, f"model not found at {path}: {type(ex).__name__}"
    if head is None or head.version != VERSION:
        return None, None, f"model at {path} has version {head and head.version}, not {VERSION}"
    if head.inputs != _hash(VERSION, *names, sorted(codes.items())):
        return None, None, f"model at {path}: features or categories are not those it was stored with"
    if head.rows != found:
        return None, None, f"model at {path} has {found} of {head.rows} rows"
    if columns is not None:
        lacking = [c for c in input_columns(names, codes) if c not in columns]
        if lacking:
            return None, None, f"model at {path} needs columns that the table lacks: {', '.join(lacking)}"
    if head.kind == "Linear":
        model: Trees | Boosted | Linear = Linear(rows, names)
    elif head.kind == "Trees":
        model = Trees(rows, head.trees, head.depth, list(head.weights), names)
    else:
        model = Boosted(rows, head.trees, head.depth, [], names)
    return Loaded(model, head.best_name, codes), features, None
