"""Loan portfolio analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import missed_bucket
from ..functions.numeric import crore, percent
from .geography import loans_with_state
from .portfolio import Tables, mean


def loan_totals(tables: Tables) -> DataFrame:
    return tables["loans"].where(F.col("Loan_Amount") > 0).agg(
        F.count(F.lit(1)).alias("Total_Loan_Customers"),
        crore(F.sum("Loan_Amount")).alias("Total_Loan_Crore"),
        mean("Loan_Amount", 0).alias("Avg_Loan_Amount"),
        mean("Debt_to_Income_Ratio", 3).alias("Avg_DTI"))


def by_status(tables: Tables) -> DataFrame:
    return (tables["loans"].groupBy("Loan_Status")
            .agg(F.count(F.lit(1)).alias("Count"),
                 crore(F.sum("Loan_Amount")).alias("Total_Crore"),
                 mean("Loan_Amount", 0).alias("Avg_Amount"))
            .orderBy(F.desc("Count"), "Loan_Status"))


def by_default(tables: Tables) -> DataFrame:
    return tables["loans"].groupBy("Default_Status").agg(
        F.count(F.lit(1)).alias("Count"),
        mean("Loan_Amount", 0).alias("Avg_Loan"),
        mean("Missed_Payments", 2).alias("Avg_Missed_Payments"),
        mean("Debt_to_Income_Ratio", 3).alias("Avg_DTI"))


def by_state(tables: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    return (loans_with_state(tables).groupBy("State")
            .agg(n.alias("Loan_Customers"),
                 crore(F.sum("Loan_Amount")).alias("Total_Loans_Crore"),
                 mean("Loan_Amount", 0).alias("Avg_Loan"),
                 percent(F.sum("Default_Status"), n).alias("Default_Rate_Pct"))
            .orderBy(F.desc("Total_Loans_Crore"), "State"))


def missed_distribution(tables: Tables) -> DataFrame:
    bucket = missed_bucket(F.col("Missed_Payments"), "between")
    n = F.count(F.lit(1))
    return (tables["loans"].groupBy(bucket.alias("Missed_Bucket"))
            .agg(n.alias("Count"), percent(F.sum("Default_Status"), n).alias("Default_Rate"))
            .orderBy(F.desc("Default_Rate"), "Missed_Bucket"))


def strained_borrowers(tables: Tables, ratio: float = 0.5, k: int = 20) -> DataFrame:
    """Borrowers with the highest debt-to-income ratios above ``ratio``."""
    dti = F.col("Debt_to_Income_Ratio")
    loans = tables["loans"].where((dti > ratio) & (F.col("Loan_Amount") > 0)).select(
        "Customer_ID", "Loan_Amount", "EMI", "Debt_to_Income_Ratio", "Missed_Payments")
    people = tables["customers"].select("Customer_ID", "Monthly_Income", "Risk_Label")
    return (loans.join(people, "Customer_ID")
            .select("Customer_ID", "Monthly_Income", "Loan_Amount", "EMI",
                    "Debt_to_Income_Ratio", "Missed_Payments", "Risk_Label")
            .orderBy(dti.desc(), "Customer_ID").limit(k))


def by_tenure(tables: Tables) -> DataFrame:
    return (tables["loans"].where(F.col("Loan_Tenure") > 0).groupBy("Loan_Tenure")
            .agg(F.count(F.lit(1)).alias("Count"), mean("Loan_Amount", 0).alias("Avg_Amount"),
                 mean("EMI", 0).alias("Avg_EMI"))
            .orderBy("Loan_Tenure"))
