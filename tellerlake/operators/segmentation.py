"""Customer segments over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.segments import segment
from .portfolio import Tables, mean, rate


def _with_loans_and_activity(tables: Tables) -> DataFrame:
    """Customers with their loan and activity columns; one bucketed join each."""
    loans = tables["loans"].select("Customer_ID", "Loan_Amount", "Debt_to_Income_Ratio")
    activity = tables["transactions"].select(
        "Customer_ID", "Transaction_Count", "Transaction_Amount")
    return (tables["customers"].join(loans, "Customer_ID", "left")
            .join(activity, "Customer_ID", "left"))


def customer_segments(tables: Tables) -> DataFrame:
    return _with_loans_and_activity(tables).select(
        "Customer_ID", "Account_Balance", "Monthly_Income", "Credit_Score",
        "Number_of_Products", "Transaction_Amount", "Online_Banking_Usage",
        "Mobile_Banking_Usage", "Churn_Status", "Risk_Label",
        segment("detail").alias("Customer_Segment"))


def segment_summary(tables: Tables) -> DataFrame:
    return (_with_loans_and_activity(tables).groupBy(segment("summary").alias("Segment"))
            .agg(F.count(F.lit(1)).alias("Count"),
                 mean("Monthly_Income", 0).alias("Avg_Income"),
                 mean("Account_Balance", 0).alias("Avg_Balance"),
                 mean("Credit_Score", 1).alias("Avg_Credit_Score"),
                 rate("Churn_Status").alias("Churn_Rate_Pct"))
            .orderBy(F.desc("Count")))
