"""Corpus pipeline: quality rules, near-duplicates, decontamination, surrogates and packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns what
it keeps, with the columns of ``documents``; the last returns packed pieces. :func:`run` writes
each result as Parquet below the folder the cluster shares and reads it for the next stage, so
a lost executor costs a few tasks only.

Rows with nulls, empty or repeated texts and extra columns pass as the operators say: texts
without words fail the quality rules. Near-duplicates and benchmark passages are judged row by row,
whatever the ids, and columns keep their values, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellerlake.llm import decontaminate, minhash, packing, quality, scratch, surrogates


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` with a number of its own for each row, and the column's name.

    The id is the number where no row lacks it or shares it, which the ids alone tell; else rows are
    stored with numbers, as a number drawn anew at each reading could change.
    """
    number = scratch.unused(docs.columns, "row_number")
    own = docs.where("doc_id IS NULL").isEmpty() and docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    if own:
        return docs.withColumn(number, F.col("doc_id").cast("long")), number
    return scratch.cut(docs.withColumn(number, F.monotonically_increasing_id()), name), number


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; only the verdict comes from them."""
    # columns travel under names that the rules do not make
    others = {c: f"in_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    judged = quality.rules(docs.withColumnsRenamed(others), _table(spark, sf_dir, "labels")).where("kept")
    return judged.select(*[F.col(others.get(c, c)).alias(c) for c in docs.columns])


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the least doc_id, null ids last.

    Rows are told apart by a stored number, so that copies go whose ids are null or repeated.
    """
    rows, number = _numbered(docs, "numbered")
    judged = minhash.near_duplicates(rows.select(F.col(number).alias("doc_id"), "text")).select(
        F.col("doc_id").alias("n"), "component_id")
    ids = rows.select(F.col(number).alias("n"), F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", F.col(number).alias("n")).alias("rank"))
    first = judged.join(ids, "n").groupBy("component_id").agg(F.min("rank").alias("rank"))
    return rows.join(first.select(F.col("rank.n").alias(number)), number, "left_semi").select(*docs.columns)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    rows, number = _numbered(docs, "numbered")
    found = decontaminate.contaminated(rows.select(F.col(number).alias("doc_id"), "text"), _table(spark, sf_dir, "benchmark"))
    hit = found.select(F.col("doc_id").alias(number)).distinct()
    return rows.join(hit, number, "left_anti").select(*docs.columns)


def with_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with surrogates in place of personal data; n_chars follows the new text."""
    replaced = surrogates.pseudonymise(docs)
    length = F.when(F.col("n_replaced") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return replaced.withColumn("n_chars", length).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("minhash near-dedup", keep_first_copies),
    ("benchmark decontamination", keep_uncontaminated),
    ("pii surrogates", with_surrogates),
    ("best-fit packing", packed),
]

#: Trained models, minima of hashes and best-fit search are beyond SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
