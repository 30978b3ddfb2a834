"""Labelled training rows: folds by hash of the id, and a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 6_000  # labelled documents a model is fitted on, about


def fold(doc_id: Column, folds: int) -> Column:
    """Remainder of crc32 of the id as text."""
    return F.crc32(doc_id.cast("string")) % folds


def sample(docs: DataFrame, labels: DataFrame, target: str, usable: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, y): about ``rows`` labelled documents, chosen by hash of the id.

    Only rows with ``usable`` and a label of 0 or 1 count; ids labelled twice take the larger
    label. The sample's size is bounded by ``rows`` plus chance, so it is broadcast.
    """
    rated = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull()).where(usable).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(target).cast("int").alias("y"))
    total = rated.count()
    if total > rows:
        place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
        rated = rated.where(place < int(rows / total * (1 << 30)))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return text.join(F.broadcast(rated), "doc_id").select("doc_id", "text", "y")
