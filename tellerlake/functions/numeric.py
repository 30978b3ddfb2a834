"""Rounding, ratios and shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CRORE = 1e7


def half_even(col: Column, digits: int) -> Column:
    """Round ties to the even neighbour after scaling, as array libraries do."""
    scale = F.lit(float(10**digits))
    return F.rint(col * scale) / scale


def ratio(num: Column, den: Column) -> Column:
    """Double division; null when the divisor is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def percent(num: Column, den: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(num.cast("double") * F.lit(100.0), den.cast("double")), digits)


def crore(col: Column, digits: int = 2) -> Column:
    return F.round(col.cast("double") / F.lit(CRORE), digits)


def count_where(predicate: Column) -> Column:
    """Rows for which ``predicate`` holds (0, not null, when there are none)."""
    return F.count_if(predicate)


def mean_where(value: Column, predicate: Column) -> Column:
    """Average of ``value`` over the rows for which ``predicate`` holds."""
    return F.avg(F.when(predicate, value))


def share(predicate: Column, within: Column | None = None) -> Column:
    """Percentage of rows (or of the rows in ``within``) for which ``predicate`` holds."""
    hit = F.when(predicate, 1.0).otherwise(0.0)
    if within is not None:
        hit = F.when(within, hit)
    return F.avg(hit) * 100.0


def clip(col: Column, low, high) -> Column:
    return F.least(F.greatest(col, F.lit(low)), F.lit(high))
