"""Rule-based risk, default and churn scores, and the indicators behind a score.

Points are whole numbers so that a sum is exact and its order does not matter.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from .buckets import first_match
from .numeric import clip, half_even, ratio
from .text import fixed


def _points(rules: list[tuple[Column, int]]) -> Column:
    return reduce(add, [F.when(p, n).otherwise(0) for p, n in rules])


def risk_points() -> Column:
    """Additive risk score in tenths."""
    c = F.col
    return _points([  # fixed values: limits and points
        (c("Credit_Score") < 600, 25),
        (c("Debt_to_Income_Ratio") > 0.4, 20),
        (c("Missed_Payments") > 2, 18),
        (c("Default_Status") == 1, 30),
        (c("Loan_Amount") > c("Monthly_Income") * 18, 15),
        (c("Monthly_Income") < 25_000, 10),
        (c("Late_Payments") > 2, 12),
        (c("Existing_Loans") > 2, 8),
        (c("Complaints") > 2, 5),
    ])


def risk_score() -> Column:
    return risk_points() / F.lit(10.0)


def risk_label(points: Column | None = None) -> Column:
    points = risk_points() if points is None else points
    return first_match([(points >= 50, "High"), (points >= 20, "Medium")], "Low")


def default_percent() -> Column:
    """Probability of default in whole percent, held inside [0, 100]."""
    c = F.col
    return clip(
        F.lit(2) + _points([  # fixed values: limits and points
            (c("Credit_Score") < 550, 25),
            (c("Debt_to_Income_Ratio") > 0.5, 15),
            (c("Missed_Payments") > 3, 12),
            (c("Loan_Status") == "Npa", 8),
            (c("Monthly_Income") < 20_000, 5),
        ]), 0, 100)


def churn_percent() -> Column:
    """Probability of churn in whole percent."""
    c = F.col
    return F.lit(5) + _points([  # fixed values: limits and points
        (c("Customer_Satisfaction") < 2.5, 15),
        (c("Days_Since_Transaction") > 60, 10),
        (c("Complaints") > 2, 10),
        (c("Number_of_Products") == 1, 10),
        (c("Tenure_Years") < 2, 5),
    ])


# Indicator codes, the last one standing for "none applies".
INDICATORS = ["LOW_CREDIT_SCORE", "HIGH_DTI", "MISSED_PAYMENTS", "HIGH_LOAN_BURDEN",
              "MANY_LOANS"]
NO_INDICATOR = "NO_INDICATOR"


def risk_indicators() -> Column:
    """Array of the indicator codes a customer triggers, never empty."""
    c = F.col
    tests = [
        c("Credit_Score") < 600,
        c("Debt_to_Income_Ratio") > 0.4,
        c("Missed_Payments") > 2,
        c("Loan_Amount") > c("Monthly_Income") * 18,
        c("Existing_Loans") > 2,
    ]
    hits = F.array_compact(F.array(*[F.when(t, code) for t, code in zip(tests, INDICATORS)]))
    return F.when(F.size(hits) == 0, F.array(F.lit(NO_INDICATOR))).otherwise(hits)


def indicator_text(code: Column) -> Column:
    """Sentence for one indicator code, with the customer's own numbers in it."""
    c = F.col
    times = ratio(c("Loan_Amount"), c("Monthly_Income"))

    def say(before: str, number: Column, after: str) -> Column:
        return F.concat(F.lit(before), number, F.lit(after))

    return (
        F.when(code == "LOW_CREDIT_SCORE",
               say("Credit score ", fixed(c("Credit_Score"), 0), " is under 600."))
        .when(code == "HIGH_DTI",
              say("Debt-to-income ratio ", fixed(c("Debt_to_Income_Ratio"), 2), " is over 0.4."))
        .when(code == "MISSED_PAYMENTS",
              say("", fixed(c("Missed_Payments"), 0), " payments were missed."))
        .when(code == "HIGH_LOAN_BURDEN",
              say("The loan is ", fixed(times, 0), " times the monthly income."))
        .when(code == "MANY_LOANS",
              say("There are ", fixed(c("Existing_Loans"), 0), " loans already."))
        .otherwise(F.lit("No major risk indicator found."))
    )


def instalment(amount: Column, tenure: Column) -> Column:
    """Whole monthly instalment; a tenure of zero counts as one month."""
    return F.floor(amount / F.greatest(tenure, F.lit(1)).cast("double"))


def average_ticket(amount: Column, count: Column) -> Column:
    """Whole average transaction value; a count of zero counts as one."""
    return F.floor(amount / F.greatest(count, F.lit(1)).cast("double"))


def debt_ratio(emi: Column, income: Column, low: float = 0.0, high: float = 2.0) -> Column:
    """EMI over income, three digits, zero without income, held inside [low, high]."""
    value = F.when(income > 0, half_even(ratio(emi, income), 3)).otherwise(0.0)
    return clip(value, low, high)


def applicant_ratio(emi: Column, income: Column) -> Column:
    """Ratio used when scoring an applicant: income of at least 1, zero without EMI."""
    floor_income = F.greatest(income.cast("double"), F.lit(1.0))
    return F.when(emi > 0, F.round(emi.cast("double") / floor_income, 3)).otherwise(0.0)
