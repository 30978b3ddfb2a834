"""State and city analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import count_where, crore, percent
from .portfolio import Tables, mean


def customers_by_state(tables: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    return (tables["customers"].groupBy("State")
            .agg(n.alias("Total_Customers"),
                 mean("Monthly_Income", 0).alias("Avg_Income"),
                 mean("Account_Balance", 0).alias("Avg_Balance"),
                 mean("Credit_Score", 1).alias("Avg_Credit_Score"),
                 percent(F.sum("Churn_Status"), n).alias("Churn_Rate_Pct"),
                 percent(F.sum("Default_Status"), n).alias("Default_Rate_Pct"))
            .orderBy(F.desc("Total_Customers"), "State"))


def risk_mix_by_state(tables: Tables) -> DataFrame:
    label, n = F.col("Risk_Label"), F.count(F.lit(1))
    return (tables["customers"].groupBy("State")
            .agg(n.alias("Total"),
                 *[count_where(label == v).alias(f"{v}_Risk") for v in ("High", "Medium", "Low")],
                 percent(count_where(label == "High"), n).alias("High_Risk_Pct"))
            .orderBy(F.desc("High_Risk_Pct"), "State"))


def top_cities(tables: Tables, min_customers: int = 50, k: int = 15) -> DataFrame:
    return (tables["customers"].groupBy("City", "State")
            .agg(F.count(F.lit(1)).alias("Customers"),
                 mean("Account_Balance", 0).alias("Avg_Balance"),
                 mean("Monthly_Income", 0).alias("Avg_Income"))
            .where(F.col("Customers") >= min_customers)
            .orderBy(F.desc("Avg_Balance"), "City", "State").limit(k))


def loans_with_state(tables: Tables) -> DataFrame:
    """Open loans with the customer's state; the amount filter reaches the loan scan."""
    loans = tables["loans"].where(F.col("Loan_Amount") > 0)
    return loans.join(tables["customers"].select("Customer_ID", "State"), "Customer_ID")


def loan_performance(tables: Tables) -> DataFrame:
    n = F.count("Customer_ID")
    return (loans_with_state(tables).groupBy("State")
            .agg(n.alias("Loan_Customers"),
                 crore(F.sum("Loan_Amount")).alias("Total_Loans_Crore"),
                 percent(F.sum("Default_Status"), n).alias("Default_Rate_Pct"))
            .orderBy(F.desc("Default_Rate_Pct"), "State"))


def income_rank(tables: Tables) -> DataFrame:
    """States ranked by average income; the window sees one row per state."""
    by_state = tables["customers"].groupBy("State").agg(
        mean("Monthly_Income", 0).alias("Avg_Income"))
    rank = F.rank().over(Window.orderBy(F.desc("Avg_Income")))
    return by_state.withColumn("Income_Rank", rank.cast("bigint"))
