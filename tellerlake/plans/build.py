"""The whole batch run: raw file to clean files, tables, models and reports.

    spark-submit tellerlake/plans/build.py <raw csv folder> <output folder>
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tellerlake.operators import cleaning, evaluation, features, training
from tellerlake.sources import files, store

KINDS = ("logistic", "tree", "forest")
SCORES = ["p_low", "p_medium", "p_high"]


def build_all(raw: DataFrame, out: str, kinds: Sequence[str] = KINDS,
              params: dict[str, dict] | None = None) -> DataFrame:
    """Run every step and return the model comparison.

    Below ``out``: ``processed`` (CSV), ``database`` (four tables),
    ``models`` (stored best model, comparison) and ``reports`` (feature
    importance, confusion matrix and ROC curve of the best model).
    """
    spark, out = raw.sparkSession, out.rstrip("/")
    clean = store.cut(cleaning.clean_customers(raw), "clean-customers")
    files.write_csv(clean, f"{out}/processed/customers_clean")
    store.build_tables(clean, f"{out}/database")

    encoders = features.fit_encoders(clean)
    table = store.cut(features.model_table(clean, encoders), "model-table")
    fitted, scored, results = {}, {}, []
    for kind in kinds:
        name = training.MODEL_NAMES[kind]
        fitted[name] = training.train(table, kind, **(params or {}).get(kind, {}))
        scored[name] = store.cut(
            training.predict(fitted[name], table.where("is_test"), ["label"])
            .select("label", "prediction", *SCORES), "scored")
        results.append(evaluation.evaluate(scored[name], name))
    report = evaluation.comparison(spark, results)
    best = max(results, key=lambda r: r[1])[0]

    training.save_model(fitted[best], training.codes_of(encoders), best, f"{out}/models/risk_model",
                        training.feature_names(table))
    files.write_report(report, f"{out}/models/model_metrics")
    files.write_report(training.importances(fitted[best], spark, training.feature_names(table)),
                       f"{out}/reports/feature_importance")
    files.write_report(evaluation.confusion_matrix(scored[best], "label", "prediction"),
                       f"{out}/reports/confusion_matrix")
    files.write_parquet(evaluation.roc_curve(scored[best], "label", SCORES),
                        f"{out}/reports/roc_curve")
    return report


if __name__ == "__main__":
    import sys

    from pyspark.sql import SparkSession

    session = SparkSession.builder.appName("tellerlake-build").getOrCreate()
    build_all(files.read_raw_csv(session, sys.argv[1]), sys.argv[2]).show(truncate=False)
