"""Model table and fitted models of one star schema, prepared once per session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import evaluation, features, training
from ..schema import KEY
from ..sources import store

DEFAULT_KINDS = ("logistic", "tree", "forest")


def encoders(spark: SparkSession, sf_dir: str):
    """Category codes over the whole table, before any split."""
    return store.once(spark, sf_dir, "encoders",
                      lambda: features.fit_encoders(store.customers_of(spark, sf_dir)))


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.once(spark, sf_dir, "table", lambda: store.cut(
        features.model_table(store.customers_of(spark, sf_dir), encoders(spark, sf_dir)),
        "model-table"))


def fitted(spark: SparkSession, sf_dir: str, kind: str, **params) -> training.Model:
    return store.once(spark, sf_dir, f"{kind}{params}",
                      lambda: training.train(table(spark, sf_dir), kind, **params))


def tested(spark: SparkSession, sf_dir: str, kind: str, **params) -> DataFrame:
    """Scored test rows of one model."""
    rows = table(spark, sf_dir).where("is_test")
    return training.predict(fitted(spark, sf_dir, kind, **params), rows, [KEY, "label"])


def results(spark: SparkSession, sf_dir: str) -> dict[str, tuple]:
    def run():
        # stored, as two figures read the scores
        return {k: evaluation.evaluate(store.cut(tested(spark, sf_dir, k), "scored"), training.MODEL_NAMES[k])
                for k in DEFAULT_KINDS}
    return store.once(spark, sf_dir, "results", run)


def best_kind(spark: SparkSession, sf_dir: str) -> str:
    scores = results(spark, sf_dir)
    return max(scores, key=lambda k: scores[k][1])


def loaded(spark: SparkSession, sf_dir: str) -> training.Loaded:
    """The stored best model, read back and held against the customer table."""
    model, _features, error = training.load_model(
        spark, saved(spark, sf_dir), store.customers_of(spark, sf_dir).columns)
    if error:
        raise ValueError(error)
    return model


def saved(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the stored best model."""
    def save():
        kind, path = best_kind(spark, sf_dir), store.new_path(spark, "risk-model")
        codes = training.codes_of(encoders(spark, sf_dir))
        training.save_model(fitted(spark, sf_dir, kind), codes, training.MODEL_NAMES[kind], path)
        return path
    return store.once(spark, sf_dir, "saved", save)
