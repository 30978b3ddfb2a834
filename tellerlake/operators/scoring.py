"""Score applicants in bulk and explain the scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..schema import KEY
from .features import applicant_encoders, assembler, feature_inputs, tidy_categories
from .training import Model, predict

# What an applicant states, and the input bounds of each number.
APPLICANT_COLUMNS = [
    "Age", "Monthly_Income", "Credit_Score", "Account_Balance", "Tenure_Years", "Loan_Amount",
    "EMI", "Monthly_Expenses", "Missed_Payments", "Late_Payments", "Transaction_Count",
    "Transaction_Amount", "Number_of_Products", "Complaints", "Customer_Satisfaction",
    "Existing_Loans", "Online_Banking_Usage", "Mobile_Banking_Usage", "ATM_Usage",
    "Branch_Visits", "Gender", "Occupation", "Account_Type",
]


def applicant_inputs(applicants: DataFrame) -> DataFrame:
    """Complete applicant rows: derived ratios, and defaults for what is not asked."""
    c = F.col
    return applicants.select(
        KEY, *APPLICANT_COLUMNS,
        scores.average_ticket(c("Transaction_Amount"), c("Transaction_Count"))
        .alias("Average_Transaction_Value"),
        scores.applicant_ratio(c("EMI"), c("Monthly_Income")).alias("Debt_to_Income_Ratio"),
        (c("Complaints") + 1).alias("Support_Calls"),
        F.lit(1).alias("Credit_Card_Usage"), F.lit(1).alias("Debit_Card_Usage"),
        F.lit(7).alias("Days_Since_Transaction"))


def score_applicants(model: Model, applicants: DataFrame) -> DataFrame:
    """Risk class, its probability and all class probabilities in percent, per applicant.

    ``model`` is the fitted model without input stages: categories are coded by
    the fixed applicant lists, after the spelling is tidied.
    """
    rows = tidy_categories(applicant_inputs(applicants))
    coded = feature_inputs(applicant_encoders().transform(rows))
    ready = assembler(coded.columns).transform(coded)
    scored = predict(model, ready, [KEY, "Debt_to_Income_Ratio"])
    names = F.array(*[F.lit(v) for v in ("LOW RISK", "MEDIUM RISK", "HIGH RISK")])
    chances = F.array("p_low", "p_medium", "p_high")
    return scored.select(
        KEY, "Debt_to_Income_Ratio",
        F.coalesce(F.get(names, F.col("prediction")), F.lit("UNKNOWN")).alias("Risk_Category"),
        F.round(F.get(chances, F.col("prediction")) * 100, 1).alias("Risk_Probability_Pct"),
        *[F.round(F.col(f"p_{v}") * 100, 2).alias(f"{v.title()}_Risk_Pct")
          for v in ("low", "medium", "high")])


def explanations(df: DataFrame) -> DataFrame:
    """One row per customer and triggered indicator, or the one that none was triggered."""
    return (df.withColumn("Indicator", F.explode(scores.risk_indicators()))
            .select(KEY, "Indicator", scores.indicator_text(F.col("Indicator")).alias("Text")))
