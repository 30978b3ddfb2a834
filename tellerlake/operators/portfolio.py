"""Customer-base figures over the ``customers`` table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.buckets import age_group, first_match
from ..functions.numeric import count_where, crore, percent

Tables = dict[str, DataFrame]


def single(table: str, **figures: Callable[[], Column]) -> Callable[[Tables], DataFrame]:
    """An operator that returns one row of ``figures`` over one table."""
    def run(tables: Tables) -> DataFrame:
        return tables[table].agg(*[make().alias(name) for name, make in figures.items()])
    return run


def mean(col: str, digits: int) -> Column:
    return F.round(F.avg(col), digits)


def rate(flag: str) -> Column:
    return F.round(F.avg(flag) * 100, 2)


total_customers = single("customers", Total_Customers=lambda: F.count(F.lit(1)))
avg_balance = single("customers", Avg_Account_Balance=lambda: mean("Account_Balance", 2))
avg_income = single("customers", Avg_Monthly_Income=lambda: mean("Monthly_Income", 2))
total_deposits = single("customers",
                        Total_Deposits_Crore=lambda: crore(F.sum("Account_Balance")))
default_rate = single("customers", Default_Rate_Pct=lambda: rate("Default_Status"))
churn_rate = single("customers", Churn_Rate_Pct=lambda: rate("Churn_Status"))
avg_products = single("customers", Avg_Products=lambda: mean("Number_of_Products", 2))
avg_credit_score = single("customers", Avg_Credit_Score=lambda: mean("Credit_Score", 1))
complaint_rate = single(
    "customers",
    Complaint_Rate_Pct=lambda: percent(count_where(F.col("Complaints") > 0),
                                       F.count(F.lit(1))))
active_inactive = single(
    "customers",
    Active_Customers=lambda: count_where(F.col("Churn_Status") == 0),
    Inactive_Customers=lambda: count_where(F.col("Churn_Status") == 1))


def label_shares(df: DataFrame) -> DataFrame:
    """Count and percentage per risk label; the total comes from the counts themselves."""
    counts = df.groupBy("Risk_Label").agg(F.count(F.lit(1)).alias("Count"))
    return counts.withColumn(
        "Pct", percent(F.col("Count"), F.sum("Count").over(Window.partitionBy())))


def risk_distribution(tables: Tables) -> DataFrame:
    order = first_match([(F.col("Risk_Label") == "High", 1),
                         (F.col("Risk_Label") == "Medium", 2)], 3)
    return label_shares(tables["customers"]).orderBy(order)


def by_account_type(tables: Tables) -> DataFrame:
    return (tables["customers"].groupBy("Account_Type")
            .agg(F.count(F.lit(1)).alias("Total"), mean("Account_Balance", 2).alias("Avg_Balance"))
            .orderBy(F.desc("Total")))


def by_age_group(tables: Tables) -> DataFrame:
    return (tables["customers"].groupBy(age_group(F.col("Age"), "between").alias("Age_Group"))
            .agg(F.count(F.lit(1)).alias("Count"), mean("Monthly_Income", 2).alias("Avg_Income"))
            .orderBy("Age_Group"))


def top_balances(tables: Tables, k: int = 10) -> DataFrame:
    return (tables["customers"]
            .select("Customer_ID", "Age", "Occupation", "Account_Balance", "Credit_Score",
                    "Risk_Label")
            .orderBy(F.desc("Account_Balance"), "Customer_ID").limit(k))


def tenure_by_account_type(tables: Tables) -> DataFrame:
    return tables["customers"].groupBy("Account_Type").agg(
        mean("Tenure_Years", 1).alias("Avg_Tenure_Years"))
