"""KPI packs: many figures from one pass over the customer table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import count_where, crore, mean_where, share
from ..functions.text import fixed, format_inr, percent_text, rupees
from .portfolio import mean

_c = F.col


def _n() -> Column:
    return F.count(F.lit(1))


def _label(value: str) -> Column:
    return _c("Risk_Label") == value


def kpi_pack(df: DataFrame) -> DataFrame:
    """The 20 headline figures in one row. The default rate is over all customers."""
    return df.agg(
        _n().alias("Total_Customers"),
        count_where(_c("Churn_Status") == 0).alias("Active_Customers"),
        (_n() - count_where(_c("Churn_Status") == 0)).alias("Inactive_Customers"),
        mean("Age", 1).alias("Average_Age"),
        mean("Monthly_Income", 0).alias("Average_Income"),
        mean("Account_Balance", 0).alias("Average_Account_Balance"),
        crore(F.sum("Account_Balance")).alias("Total_Deposits_Crore"),
        crore(F.sum("Loan_Amount")).alias("Total_Loan_Amount_Crore"),
        mean("Credit_Score", 1).alias("Average_Credit_Score"),
        mean("Transaction_Amount", 0).alias("Average_Transaction_Amount"),
        F.sum("Transaction_Count").alias("Total_Transactions"),
        mean("Number_of_Products", 2).alias("Avg_Products_per_Customer"),
        count_where(_c("Loan_Amount") > 0).alias("Loan_Customers"),
        F.round(F.avg("Default_Status") * 100, 2).alias("Loan_Default_Rate_Pct"),
        F.round(F.avg("Churn_Status") * 100, 2).alias("Customer_Churn_Rate_Pct"),
        *[count_where(_label(v)).alias(f"{v}_Risk_Customers") for v in ("High", "Medium", "Low")],
        F.round(share(_c("Complaints") > 0), 2).alias("Complaint_Rate_Pct"),
        mean("Debt_to_Income_Ratio", 3).alias("Avg_Debt_to_Income_Ratio"),
    )


def executive(df: DataFrame) -> DataFrame:
    return df.agg(
        _n().alias("Total_Customers"),
        count_where(_c("Churn_Status") == 0).alias("Active_Customers"),
        F.sum("Account_Balance").alias("Total_Deposits"),
        format_inr(F.sum("Account_Balance")).alias("Total_Deposits_Text"),
        F.sum("Loan_Amount").alias("Total_Loans"),
        format_inr(F.sum("Loan_Amount")).alias("Total_Loans_Text"),
        mean("Credit_Score", 0).alias("Avg_Credit_Score"),
        F.round(F.avg("Default_Status") * 100, 1).alias("Default_Rate_Pct"),
        F.round(F.avg("Churn_Status") * 100, 1).alias("Churn_Rate_Pct"),
        count_where(_label("High")).alias("High_Risk_Customers"),
        F.round(share(_label("High")), 1).alias("High_Risk_Pct"),
        mean("Monthly_Income", 2).alias("Avg_Monthly_Income"),
        format_inr(F.avg("Monthly_Income")).alias("Avg_Monthly_Income_Text"),
    )


def transactions(df: DataFrame) -> DataFrame:
    return df.agg(
        F.sum("Transaction_Count").alias("Total_Transactions"),
        F.sum("Transaction_Amount").alias("Total_Volume"),
        format_inr(F.sum("Transaction_Amount")).alias("Total_Volume_Text"),
        mean("Average_Transaction_Value", 2).alias("Avg_Txn_Value"),
        F.sum("Online_Banking_Usage").alias("Online_Users"),
        F.round(F.avg("Online_Banking_Usage") * 100, 0).alias("Online_Pct"),
    )


def loans(df: DataFrame) -> DataFrame:
    """Loan page figures. The default rate is over customers with a loan only."""
    open_loan = _c("Loan_Amount") > 0
    return df.agg(
        count_where(open_loan).alias("Loan_Customers"),
        F.round(share(open_loan), 0).alias("Loan_Customer_Pct"),
        F.sum(F.when(open_loan, _c("Loan_Amount"))).alias("Loan_Portfolio"),
        F.round(mean_where(_c("Loan_Amount"), open_loan), 2).alias("Avg_Loan"),
        F.round(mean_where(_c("Default_Status"), open_loan) * 100, 2).alias("Loan_Default_Pct"),
        F.round(mean_where(_c("Debt_to_Income_Ratio"), open_loan), 3).alias("Avg_Loan_DTI"),
    )


def risk(df: DataFrame) -> DataFrame:
    figures = []
    for v in ("High", "Medium", "Low"):
        figures += [count_where(_label(v)).alias(f"{v}_Risk"),
                    F.round(share(_label(v)), 1).alias(f"{v}_Risk_Pct")]
    dti = F.round(mean_where(_c("Debt_to_Income_Ratio"), _label("High")), 3)
    return df.agg(*figures, dti.alias("Avg_High_Risk_DTI"))


def eda_summary(df: DataFrame) -> DataFrame:
    """Eleven summary rows: position, metric, value and display text, from one pass."""
    whole = lambda c: fixed(c, 0, grouped=True)
    figures = [
        ("Total Customers", _n(), whole),
        ("Active Customers", count_where(_c("Churn_Status") == 0), whole),
        ("Churn Rate", F.avg("Churn_Status") * 100, percent_text),
        ("Avg Monthly Income", F.avg("Monthly_Income"), rupees),
        ("Avg Account Balance", F.avg("Account_Balance"), rupees),
        ("Avg Credit Score", F.avg("Credit_Score"), lambda c: fixed(c, 0)),
        ("Loan Customers", count_where(_c("Loan_Amount") > 0), whole),
        ("Default Rate", F.avg("Default_Status") * 100, percent_text),
        *[(f"{v} Risk %", share(_label(v)), percent_text) for v in ("High", "Medium", "Low")],
    ]
    row = df.agg(*[value.cast("double").alias(f"_{i}") for i, (_, value, _t) in enumerate(figures)])
    cells = F.array(*[
        F.struct(F.lit(i + 1).alias("Position"), F.lit(name).alias("Metric"),
                 F.round(f"_{i}", 6).alias("Value"), text(_c(f"_{i}")).alias("Text"))
        for i, (name, _v, text) in enumerate(figures)
    ])
    return row.select(F.explode(cells).alias("s")).select("s.*")
