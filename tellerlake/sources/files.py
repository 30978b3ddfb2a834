"""Customer files and report files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import parse_date, parse_number
from ..schema import CLEAN_SCHEMA, ORDINAL, RAW_SCHEMA, struct

# Columns of the model comparison and feature importance reports.
METRICS_SCHEMA = struct(
    "Model string, ROC_AUC double, F1_Weighted double, Precision double, "
    "Recall double, Best string")
IMPORTANCE_SCHEMA = struct("feature string, importance double")


def _text_rows(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """All columns of CSV files with header, as text; last, the whole record where it is malformed.

    Every plan over the result reads a real column too: Spark refuses one of the last alone.

    Fails when one of ``columns`` is missing, or when files below ``path`` differ in their headers.
    """
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in columns if c not in header]
    if missing:
        raise ValueError(f"{path}: missing columns: {', '.join(missing)}")
    mark = "_malformed"
    while mark in header:
        mark += "_"
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, mark]])
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option(
        "mode", "PERMISSIVE").option("columnNameOfCorruptRecord", mark).option("columnPruning", False).csv(path)
    return rows.where(F.xxhash64(F.col(f"`{header[0]}`")) >= F.lit(-(1 << 63)))  # holds for every row


def read_by_name(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The named columns of CSV files with header, as text, wherever they stand in the files.

    Records with fewer or more fields than the header are left out, neither padded nor cut: see
    :func:`read_malformed`. Fails when a column is missing, or when files below ``path`` differ
    in their headers.
    """
    rows = _text_rows(spark, path, columns)
    return rows.where(F.col(rows.columns[-1]).isNull()).select(*columns)


def read_malformed(spark: SparkSession, path: str) -> DataFrame:
    """(file, record): the text of every record that has fewer or more fields than the header."""
    rows = _text_rows(spark, path, [])
    return rows.where(F.col(rows.columns[-1]).isNotNull()).select(
        F.col("_metadata.file_path").alias("file"), F.col(rows.columns[-1]).alias("record"))


def malformed_counts(spark: SparkSession, path: str) -> DataFrame:
    """(file, records): how many malformed records each file holds, if any."""
    return read_malformed(spark, path).groupBy("file").agg(F.count(F.lit(1)).alias("records"))


def typed_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns in the types of ``schema``.

    A whole number may be written ``12.0``. A date that does not parse and a NaN become null;
    any other text that does not fit its column fails the plan, naming the column.
    """
    def typed(field: T.StructField) -> Column:
        name, kind = field.name, field.dataType.simpleString()
        if kind == "string":
            return F.col(name)
        if kind == "date":
            return parse_date(name).alias(name)
        number = parse_number(name)
        fits = number if kind == "double" else F.when(
            number == F.floor(number), number).try_cast(kind)
        blank = F.col(name).isNull() | (F.lower(F.trim(name)) == "nan")
        return F.when(blank, None).when(fits.isNotNull(), fits).otherwise(F.raise_error(
            F.concat(F.lit(f"{name}: not a {kind}: "), F.col(name))).cast(kind)).alias(name)

    return df.select(*[typed(f) for f in schema])


def read_customers_csv(spark: SparkSession, path: str) -> DataFrame:
    """Clean customer CSV with header, columns by name; see :func:`typed_columns`."""
    return typed_columns(read_by_name(spark, path, CLEAN_SCHEMA.names), CLEAN_SCHEMA)


def load_customers(spark: SparkSession, path: str) -> tuple[DataFrame | None, str | None]:
    """(customers, None), or (None, reason) when there is no readable file at ``path``."""
    try:
        return read_customers_csv(spark, path), None
    except AnalysisException as ex:
        return None, f"customers not found at {path}: {ex.getCondition()}"
    except ValueError as ex:
        return None, str(ex)


def read_raw_csv(spark: SparkSession, path: str, ordinal: bool = False) -> DataFrame:
    """Raw customer CSV, all text, with the ``_seq`` file order.

    ``ordinal=True``: the files carry ``_seq`` as their first column, which is
    what :func:`write_csv` leaves behind. Otherwise ``_seq`` grows with file
    split and row, so it follows file order for one file or for part files that
    sort by name.
    """
    if ordinal:
        df = read_by_name(spark, path, [ORDINAL, *RAW_SCHEMA.names])
        return df.withColumn(ORDINAL, F.col(ORDINAL).cast("long"))
    df = read_by_name(spark, path, RAW_SCHEMA.names)
    meta = F.col("_metadata")
    # name, then block start, then row within the block: the order of the text itself
    return df.select(
        F.struct(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"),
                 F.monotonically_increasing_id().alias("row")).alias(ORDINAL),
        *RAW_SCHEMA.names)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header, one file per partition, replacing what is there."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report of a few rows as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return typed_columns(read_by_name(spark, path, METRICS_SCHEMA.names), METRICS_SCHEMA)


def read_importance(spark: SparkSession, path: str) -> DataFrame:
    return typed_columns(read_by_name(spark, path, IMPORTANCE_SCHEMA.names), IMPORTANCE_SCHEMA)
