"""Bucket labels. Each rule comes in the variants its users expect."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(rules: list[tuple[Column, str]], otherwise: str | None) -> Column:
    """Label of the first rule that holds; ``otherwise`` when none does."""
    head, *rest = rules
    chain = reduce(lambda acc, r: acc.when(r[0], r[1]), rest, F.when(head[0], head[1]))
    return chain.otherwise(F.lit(otherwise))


def _below(col: Column, edges, last: str) -> Column:
    return first_match([(col < edge, label) for edge, label in edges], last)


def _upto(col: Column, edges, last: str) -> Column:
    return first_match([(col <= edge, label) for edge, label in edges], last)


# Credit score limits and labels.
_CREDIT = [(500, "Very Poor"), (600, "Poor"), (700, "Fair"), (750, "Good")]
_CREDIT_RANGES = [
    (500, "Very Poor (<500)"), (600, "Poor (500-599)"),
    (700, "Fair (600-699)"), (750, "Good (700-749)"),
]


def credit_category(score: Column, style: str = "plain") -> Column:
    """``plain`` labels, or ``ranged`` labels that spell the limits out."""
    if style == "plain":
        return _below(score, _CREDIT, "Excellent")
    if style == "ranged":
        return _below(score, _CREDIT_RANGES, "Excellent (750+)")
    raise ValueError(f"unknown style {style!r}")


# Age groups.
_AGES = [(18, 25), (26, 35), (36, 45), (46, 55)]


def age_group(age: Column, style: str = "upto") -> Column:
    """``upto`` closes each group on its upper age; ``between`` wants whole years.

    With ``between`` an age that falls between two groups (25.5, say) or below
    18 lands in ``56+``.
    """
    if style == "upto":
        return _upto(age, [(hi, f"{lo}-{hi}") for lo, hi in _AGES], "56+")
    if style == "between":
        return first_match([(age.between(lo, hi), f"{lo}-{hi}") for lo, hi in _AGES], "56+")
    raise ValueError(f"unknown style {style!r}")


def missed_bucket(missed: Column, style: str = "between") -> Column:
    """Missed-payment buckets.

    ``between``: whole numbers, everything else in ``6+``. ``upto``: same limits
    as upper bounds, labels end in ``Missed``. ``cut``: half-open intervals over
    (-1, 100]; values outside, and nulls, have no bucket.
    """
    if style == "between":
        return first_match(
            [(missed == 0, "0"), (missed.between(1, 2), "1-2"), (missed.between(3, 5), "3-5")],
            "6+",
        )
    if style == "upto":
        return first_match(
            [(missed == 0, "0 Missed"), (missed <= 2, "1-2 Missed"), (missed <= 5, "3-5 Missed")],
            "6+ Missed",
        )
    if style == "cut":
        inside = (missed > -1) & (missed <= 100)
        return F.when(inside, _upto(missed, [(0, "0"), (2, "1-2"), (5, "3-5")], "6+"))
    raise ValueError(f"unknown style {style!r}")


def atm_bucket(usage: Column) -> Column:
    return first_match(
        [(usage == 0, "0"), (usage <= 3, "1-3"), (usage <= 6, "4-6"), (usage <= 10, "7-10")],
        "10+",
    )
