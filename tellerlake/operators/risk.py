"""Risk analyses over ``risk_analysis``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import credit_category, missed_bucket
from ..functions.numeric import count_where, percent
from .portfolio import Tables, label_shares


def distribution(tables: Tables) -> DataFrame:
    return label_shares(tables["risk_analysis"])


def worst_payers(tables: Tables, k: int = 20) -> DataFrame:
    """High-risk customers with the most missed payments."""
    risk = tables["risk_analysis"].where(F.col("Risk_Label") == "High").select(
        "Customer_ID", "Missed_Payments", "Debt_to_Income_Ratio", "Default_Status", "Risk_Label")
    people = tables["customers"].select("Customer_ID", "Age", "Monthly_Income", "Credit_Score")
    return (risk.join(people, "Customer_ID")
            .select("Customer_ID", "Age", "Monthly_Income", "Credit_Score", "Missed_Payments",
                    "Debt_to_Income_Ratio", "Default_Status", "Risk_Label")
            .orderBy(F.desc("Missed_Payments"), "Customer_ID").limit(k))


def high_share(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Rows, high-risk rows and their percentage per key."""
    n, high = F.count(F.lit(1)), count_where(F.col("Risk_Label") == "High")
    return (df.groupBy(key.alias(name))
            .agg(n.alias("Total"), high.alias("High_Risk"),
                 percent(high, n).alias("High_Risk_Pct"))
            .orderBy(F.desc("High_Risk_Pct"), name))


def by_credit_category(tables: Tables) -> DataFrame:
    return high_share(tables["risk_analysis"],
                      credit_category(F.col("Credit_Score"), "ranged"), "Credit_Category")


def by_missed_bucket(tables: Tables) -> DataFrame:
    return high_share(tables["risk_analysis"],
                      missed_bucket(F.col("Missed_Payments"), "upto"), "Missed_Bucket")


def high_ratio(tables: Tables, ratio: float = 0.5, k: int = 20) -> DataFrame:
    dti = F.col("Debt_to_Income_Ratio")
    risk = tables["risk_analysis"].where(dti > ratio).select(
        "Customer_ID", "Debt_to_Income_Ratio", "Missed_Payments", "Risk_Label")
    income = tables["customers"].select("Customer_ID", "Monthly_Income")
    return (risk.join(income, "Customer_ID")
            .select("Customer_ID", "Monthly_Income", "Debt_to_Income_Ratio", "Missed_Payments",
                    "Risk_Label")
            .orderBy(dti.desc(), "Customer_ID").limit(k))


def by_state(tables: Tables) -> DataFrame:
    risk = tables["risk_analysis"].select("Customer_ID", "Risk_Label")
    states = tables["customers"].select("Customer_ID", "State")
    return high_share(risk.join(states, "Customer_ID"), F.col("State"), "State")


def defaults_by_label(tables: Tables) -> DataFrame:
    n, bad = F.count(F.lit(1)), F.sum("Default_Status")
    return tables["risk_analysis"].groupBy("Risk_Label").agg(
        n.alias("Total"), bad.alias("Defaults"), percent(bad, n).alias("Default_Rate_Pct"))
