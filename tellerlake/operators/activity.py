"""Transaction analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import atm_bucket
from ..functions.numeric import count_where, crore, percent
from .portfolio import Tables, mean, single

totals = single(
    "transactions",
    Total_Transactions=lambda: F.sum("Transaction_Count"),
    Total_Transaction_Crore=lambda: crore(F.sum("Transaction_Amount")),
    Avg_Txn_Value=lambda: mean("Average_Transaction_Value", 2))


def top_spenders(tables: Tables, k: int = 10) -> DataFrame:
    top = (tables["transactions"]
           .select("Customer_ID", "Transaction_Count", "Transaction_Amount",
                   "Average_Transaction_Value")
           .join(tables["customers"].select("Customer_ID", "Occupation", "State"),
                 "Customer_ID"))
    return top.orderBy(F.desc("Transaction_Amount"), "Customer_ID").limit(k)


def digital_adoption(tables: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    online, mobile = F.sum("Online_Banking_Usage"), F.sum("Mobile_Banking_Usage")
    both = (F.col("Online_Banking_Usage") == 1) & (F.col("Mobile_Banking_Usage") == 1)
    return tables["customers"].agg(
        online.alias("Online_Users"), mobile.alias("Mobile_Users"),
        count_where(both).alias("Both_Digital"), n.alias("Total"),
        percent(online, n).alias("Online_Pct"), percent(mobile, n).alias("Mobile_Pct"))


def atm_distribution(tables: Tables) -> DataFrame:
    return (tables["customers"].groupBy(atm_bucket(F.col("ATM_Usage")).alias("ATM_Bucket"))
            .agg(F.count(F.lit(1)).alias("Count")).orderBy("ATM_Bucket"))


def _joined(tables: Tables, column: str) -> DataFrame:
    activity = tables["transactions"].select(
        "Customer_ID", "Transaction_Amount", "Transaction_Count")
    return activity.join(tables["customers"].select("Customer_ID", column), "Customer_ID")


def by_occupation(tables: Tables) -> DataFrame:
    return (_joined(tables, "Occupation").groupBy("Occupation")
            .agg(F.count(F.lit(1)).alias("Customers"),
                 mean("Transaction_Amount", 0).alias("Avg_Txn_Amount"),
                 mean("Transaction_Count", 1).alias("Avg_Txn_Count"))
            .orderBy(F.desc("Avg_Txn_Amount"), "Occupation"))


def by_risk(tables: Tables) -> DataFrame:
    return _joined(tables, "Risk_Label").groupBy("Risk_Label").agg(
        mean("Transaction_Amount", 0).alias("Avg_Txn_Amount"),
        mean("Transaction_Count", 1).alias("Avg_Txn_Count"))
