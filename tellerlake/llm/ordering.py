"""Global order of a table without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut


def running(df: DataFrame, order: Sequence[str], weight: Column | None = None) -> DataFrame:
    """``df`` with ``before``: the weights (1 each, if none is given) of all rows ordered before.

    Rows go to ranges of ``order``, nulls first; every range is summed by its own task, and
    only one row per range is ordered by itself. The ranges are stored, so that both passes
    see the same ones.
    """
    weight = F.lit(1).cast("long") if weight is None else weight.cast("long")
    ranged = cut(df.withColumn("_weight", weight).repartitionByRange(*order).withColumn(
        "_range", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_range").agg(F.sum("_weight").alias("_total"))  # a row per range
    earlier = totals.select(F.col("_range").alias("_of"), F.coalesce(F.sum("_total").over(
        Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(earlier), F.col("_range") == F.col("_of"))
    return joined.withColumn("before", F.col("_base") + F.coalesce(F.sum("_weight").over(within), F.lit(0))).drop(
        "_weight", "_range", "_of", "_base")
