"""Customer segments. Three rule sets exist on purpose and must not be merged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .buckets import first_match


def segment(rules: str = "dashboard") -> Column:
    """First matching segment of a customer row.

    ``detail``     digital by amount, at risk also after 90 idle days, low by amount
    ``summary``    digital by both channels, at risk also after 90 idle days
    ``dashboard``  digital by both channels, at risk by churn only
    """
    if rules not in ("detail", "summary", "dashboard"):
        raise ValueError(f"unknown rule set {rules!r}")
    c = F.col
    balance, score = c("Account_Balance"), c("Credit_Score")
    online = c("Online_Banking_Usage") == 1
    churned, idle = c("Churn_Status") == 1, c("Days_Since_Transaction") > 90
    if rules == "detail":
        digital = (c("Transaction_Amount") >= 100_000) & online
        low = (c("Transaction_Amount") < 20_000) & (c("Branch_Visits") <= 1)
    else:
        digital = online & (c("Mobile_Banking_Usage") == 1)
        low = c("Transaction_Count") < 5
    return first_match(
        [  # fixed values: limits and names
            ((balance >= 500_000) & (score >= 750) & (c("Number_of_Products") >= 3), "Premium"),
            ((balance >= 200_000) & (score >= 650), "High Value"),
            (digital, "Digital First"),
            ((c("Loan_Amount") > 0) & (c("Debt_to_Income_Ratio") > 0.35), "Loan Dependent"),
            (churned if rules == "dashboard" else churned | idle, "At Risk"),
            (low, "Low Engagement"),
        ],
        "Regular",
    )
