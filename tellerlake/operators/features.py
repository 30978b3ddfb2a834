"""Model inputs: category codes, the feature vector, the target, the split, the weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title_case
from ..schema import ENCODED_COLUMNS, FEATURE_COLUMNS, KEY, RISK_LABELS

# The categories an applicant can choose from, in clean spelling.
APPLICANT_CATEGORIES = {
    "Gender": ["Female", "Male", "Other"],
    "Occupation": ["Business Owner", "Freelancer", "Homemaker", "Professional", "Retired",
                   "Salaried", "Self-Employed", "Student"],
    "Account_Type": ["Current", "Nri", "Salary", "Savings"],
}


def fit_encoders(df: DataFrame, columns: Sequence[str] = tuple(ENCODED_COLUMNS)
                 ) -> StringIndexerModel:
    """Codes from 0 in alphabetical order of the values that occur."""
    return StringIndexer(
        inputCols=list(columns), outputCols=[f"{c}_enc" for c in columns],
        stringOrderType="alphabetAsc", handleInvalid="error").fit(df)


def applicant_encoders() -> StringIndexerModel:
    """Codes of the fixed applicant categories, whether or not each occurs in the data."""
    columns = list(APPLICANT_CATEGORIES)
    return StringIndexerModel.from_arrays_of_labels(
        [APPLICANT_CATEGORIES[c] for c in columns], inputCols=columns,
        outputCols=[f"{c}_enc" for c in columns], handleInvalid="error")


def tidy_categories(df: DataFrame) -> DataFrame:
    return df.withColumns({c: title_case(c) for c in ENCODED_COLUMNS})


def feature_inputs(df: DataFrame) -> DataFrame:
    """The model input columns as doubles without gaps; a missing recency counts as 0."""
    if "Days_Since_Transaction" not in df.columns:
        df = df.withColumn("Days_Since_Transaction", F.lit(0))
    known = set(df.columns)
    return df.withColumns({c: F.expr(f"coalesce(nanvl(CAST({c} AS DOUBLE), NULL), 0D)")
                           for c in FEATURE_COLUMNS if c in known})


def assembler(columns: Sequence[str]) -> VectorAssembler:
    """Vector of the known features, in order; features the table lacks are skipped."""
    return VectorAssembler(inputCols=[c for c in FEATURE_COLUMNS if c in columns],
                           outputCol="features", handleInvalid="error")


def target(label: Column) -> Column:
    """Low 0, Medium 1, High 2; anything else counts as Medium."""
    code = F.array_position(F.array(*[F.lit(v) for v in RISK_LABELS]), label) - 1
    return F.when(code >= 0, code).otherwise(1).cast("int")


def class_counts(df: DataFrame) -> DataFrame:
    return (df.groupBy(target(F.col("Risk_Label")).alias("label"))
            .agg(F.count(F.lit(1)).alias("Count"))
            .select("label", F.get(F.array(*[F.lit(v) for v in RISK_LABELS]), F.col("label"))
                    .alias("Risk_Label"), "Count"))


def stratified_split(df: DataFrame, label: str = "label", key: str = KEY,
                     test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``: exactly ``round(test_share * n)`` rows of each class, by hashed key.

    Rows are binned by the head of their hash. All bins below a class's border
    bin are test rows outright; only the border bin itself (1/65536 of the class)
    has to be ordered. The borders are one small map from a scalar subquery.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key)))
    rows = df.withColumn("_hash", digest).withColumn(
        "_bin", F.conv(F.substring("_hash", 1, 4), 16, 10).cast("int"))
    bins = rows.groupBy(label, "_bin").agg(F.count(F.lit(1)).alias("_m"))
    along = Window.partitionBy(label).orderBy("_bin")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = bins.select(
        label, "_bin", "_m", F.sum("_m").over(upto).alias("_upto"),
        F.round(F.sum("_m").over(Window.partitionBy(label)) * test_share).alias("_want"))
    border = placed.where((F.col("_upto") - F.col("_m") < F.col("_want"))
                          & (F.col("_upto") >= F.col("_want")))
    # one entry per class
    borders = border.agg(F.map_from_entries(F.collect_list(F.struct(
        F.col(label), F.struct(F.col("_bin").alias("bin"),
                               (F.col("_want") - F.col("_upto") + F.col("_m")).alias("take")),
    )))).scalar()
    mine = F.try_element_at(borders, F.col(label))
    rows = rows.withColumns({"_border": F.coalesce(mine["bin"], F.lit(-1)), "_take": mine["take"]})
    sure = rows.where(F.col("_bin") != F.col("_border")).withColumn(
        "is_test", F.col("_bin") < F.col("_border"))
    order = Window.partitionBy(label, "_bin").orderBy("_hash", key)
    edge = rows.where(F.col("_bin") == F.col("_border")).withColumn(
        "is_test", F.row_number().over(order) <= F.col("_take"))
    return sure.unionByName(edge).drop("_hash", "_bin", "_border", "_take")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("Count"))
    every = Window.partitionBy()  # over one row per class
    weight = F.sum("Count").over(every) / (F.count(F.lit(1)).over(every) * F.col("Count"))
    return counts.withColumn("Weight", weight)


def with_weights(df: DataFrame, train: DataFrame, label: str = "label") -> DataFrame:
    """Attach the weight that each row's class has in ``train``."""
    weights = class_weights(train, label).agg(F.map_from_entries(
        F.collect_list(F.struct(label, "Weight")))).scalar()
    return df.withColumn("weight", F.try_element_at(weights, F.col(label)))


def model_table(df: DataFrame, encoders: StringIndexerModel) -> DataFrame:
    """Key, features, label, test flag and class weight, ready to store and train on."""
    coded = feature_inputs(encoders.transform(df))
    vectors = assembler(coded.columns).transform(coded).select(
        KEY, target(F.col("Risk_Label")).alias("label"), "features")
    split = stratified_split(vectors)
    return with_weights(split, split.where(~F.col("is_test")))
