"""From raw text rows to the clean customer table.

Each rule is a function from DataFrame to DataFrame; :func:`clean_customers`
chains them. Their order matters: medians are taken after repeated customers are
gone and before rows outside the valid ranges are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import debt_ratio
from ..functions.text import parse_date, parse_number, parse_whole, title_case
from ..schema import (CLEAN_SCHEMA, FLAG_COLUMNS, IMPUTED_COLUMNS, KEY, NUMERIC_COLUMNS, ORDINAL,
                      RAW_COLUMNS, RISK_LABELS, TEXT_COLUMNS, require)
from ..sources.store import cut
from .quantiles import medians

AS_OF = "2024-12-31"
FALLBACK_DATE = "2024-01-01"


def drop_repeats(df: DataFrame, key: str = KEY, order: str = ORDINAL) -> DataFrame:
    """Keep the first row of every key.

    ``row_number() = 1`` is also applied before the exchange, so a key with very
    many copies sends at most one row per task.
    """
    first = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def coerce_numbers(df: DataFrame) -> DataFrame:
    """Numeric columns as doubles; a number too large for its column is as good as unreadable."""
    kinds = {f.name: f.dataType.simpleString() for f in CLEAN_SCHEMA}
    return df.withColumns({
        c: parse_number(c) if kinds[c] == "double" else parse_whole(c, kinds[c])
        for c in NUMERIC_COLUMNS})


def coerce_flags(df: DataFrame) -> DataFrame:
    """0/1 columns as whole numbers; unreadable, too large or missing means 0."""
    return df.withColumns({
        c: F.coalesce(parse_number(c).try_cast("int"), F.lit(0)) for c in FLAG_COLUMNS})


def parse_dates(df: DataFrame) -> DataFrame:
    return df.withColumn("Last_Transaction_Date", parse_date("Last_Transaction_Date"))


def impute_medians(df: DataFrame, columns=tuple(IMPUTED_COLUMNS)) -> DataFrame:
    """Fill gaps with the exact column median; runs small jobs over ``df`` to find them."""
    return df.fillna({c: m for c, m in medians(df, columns).items() if m is not None})


def valid() -> Column:
    """Whether a row lies inside the valid ranges; null where a value is missing."""
    c = F.col
    return (c("Age").between(18, 100) & c("Credit_Score").between(300, 900)
            & (c("Monthly_Income") > 0) & (c("Account_Balance") >= 0)
            & (c("Transaction_Amount") >= 0))


def keep_valid(df: DataFrame) -> DataFrame:
    """Rows inside the valid ranges; a missing value is outside."""
    return df.where(valid())


def fill_zero(df: DataFrame) -> DataFrame:
    return df.fillna(0.0, subset=NUMERIC_COLUMNS)


def tidy_text(df: DataFrame) -> DataFrame:
    """Trim and title-case; a missing category becomes the text ``Nan``."""
    return df.withColumns({
        c: F.coalesce(title_case(c), F.lit("Nan")) for c in TEXT_COLUMNS})


def add_recency(df: DataFrame, as_of: str = AS_OF, fallback: str = FALLBACK_DATE) -> DataFrame:
    date = F.coalesce("Last_Transaction_Date", F.lit(fallback).cast("date"))
    days = F.greatest(F.datediff(F.lit(as_of).cast("date"), date), F.lit(0))
    return df.withColumns({"Last_Transaction_Date": date, "Days_Since_Transaction": days})


def recompute_ratio(df: DataFrame) -> DataFrame:
    return df.withColumn("Debt_to_Income_Ratio",
                         debt_ratio(F.col("EMI"), F.col("Monthly_Income")))


def fix_labels(df: DataFrame) -> DataFrame:
    label = F.col("Risk_Label")
    return df.withColumn("Risk_Label",
                         F.when(label.isin(RISK_LABELS), label).otherwise("Medium"))


def conform(df: DataFrame) -> DataFrame:
    """Columns and types of the clean table: money keeps its fraction, counts drop theirs."""
    return df.select(*[F.col(f.name).cast(f.dataType) for f in CLEAN_SCHEMA])


def typed(raw: DataFrame) -> DataFrame:
    """First row per customer with numbers, flags and dates parsed."""
    require(raw, [ORDINAL, *RAW_COLUMNS])
    return parsed(drop_repeats(raw))


def parsed(df: DataFrame) -> DataFrame:
    return df.transform(coerce_numbers).transform(coerce_flags).transform(parse_dates)


def first_rows_counted(df: DataFrame, copies: str, key: str = KEY, order: str = ORDINAL) -> DataFrame:
    """The rows of :func:`drop_repeats` with the number of rows that each stands for.

    Both come from one aggregation, made map-side first: a key with very many copies sends one
    row a task. As the count is part of the result, a repeated task cannot raise it.
    """
    return df.groupBy(F.col(key).alias("_key")).agg(
        F.min_by(F.struct(*df.columns), order).alias("_row"), F.count(F.lit(1)).alias(copies)).select("_row.*", copies)


def finish(df: DataFrame) -> DataFrame:
    """The rules that follow the medians."""
    for rule in (keep_valid, fill_zero, tidy_text, add_recency, recompute_ratio, fix_labels,
                 conform):
        df = df.transform(rule)
    return df


def clean_customers(raw: DataFrame) -> DataFrame:
    """All rules in order. The typed rows are stored once: medians and result both read them."""
    stored = cut(typed(raw), "typed-customers")
    return finish(impute_medians(stored))


def stage_report(raw: DataFrame) -> DataFrame:
    """Row counts of the raw input, after dropping repeats, and of the clean table.

    The raw rows are read once: every stored row says how many it stands for. Of the rules after
    the medians only the valid ranges drop rows, so one pass over the stored rows counts all three.
    """
    require(raw, [ORDINAL, *RAW_COLUMNS])
    copies = "_copies"
    while copies in raw.columns:
        copies += "_"
    stored = cut(parsed(first_rows_counted(raw, copies)), "counted-customers")
    rows = F.count(F.lit(1))
    counts = impute_medians(stored).agg(
        F.coalesce(F.sum(copies), F.lit(0)).alias("raw"), rows.alias("dedup"), F.count_if(valid()).alias("final")).unpivot(
        [], ["raw", "dedup", "final"], "stage", "rows")
    step = F.array_position(F.array(*[F.lit(s) for s in ("raw", "dedup", "final")]), F.col("stage"))
    return counts.select(step.cast("int").alias("step"), "stage", "rows")


def null_census(df: DataFrame) -> DataFrame:
    """Null count of every column that has any, from one pass."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return row.unpivot([], list(df.columns), "column", "nulls").where("nulls > 0")


def column_types(df: DataFrame) -> DataFrame:
    """Name and type of every column, in order."""
    schema = T.StructType([T.StructField("position", T.IntegerType()),
                           T.StructField("column", T.StringType()),
                           T.StructField("type", T.StringType())])
    rows = [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes, 1)]
    return df.sparkSession.createDataFrame(rows, schema)
