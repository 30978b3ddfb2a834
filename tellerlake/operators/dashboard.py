"""Result tables behind the dashboard pages and the exploratory report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.buckets import age_group, credit_category, missed_bucket
from ..functions.numeric import CRORE, count_where, share
from ..functions.segments import segment
from ..functions.text import fixed, format_inr, percent_text, rupees
from ..schema import CREDIT_CATEGORIES
from . import stats

_c = F.col


def with_groups(df: DataFrame) -> DataFrame:
    """Add ``Segment``, ``Credit_Category`` and ``Age_Group`` unless present."""
    groups = {
        "Segment": lambda: segment("dashboard"),
        "Credit_Category": lambda: credit_category(_c("Credit_Score")),
        "Age_Group": lambda: age_group(_c("Age")),
    }
    return df.withColumns({n: make() for n, make in groups.items() if n not in df.columns})


def high() -> Column:
    return _c("Risk_Label") == "High"


# -- customers -----------------------------------------------------------------

def customer_page(df: DataFrame, age=(18, 75), score=(300, 900), **chosen) -> DataFrame:
    """Customers the page shows; the defaults are its initial slider positions."""
    return stats.select_customers(df, age=age, score=score, **chosen)


def filtered_count(df: DataFrame, **filters) -> DataFrame:
    return customer_page(df, **filters).agg(F.count(F.lit(1)).alias("Customers"))


def gender_shares(df: DataFrame) -> DataFrame:
    """Counts per gender and their percentage; the total is the sum of the few counts."""
    counts = stats.value_counts(df, "Gender")
    total = F.sum("Count").over(Window.partitionBy())
    return counts.withColumn("Pct", F.round(_c("Count") * 100.0 / total, 1))


def credit_score_histogram(df: DataFrame, bins: int = 40) -> DataFrame:
    """Histogram with the mean score beside every bin, for the mean line."""
    mean = df.agg(F.round(F.avg("Credit_Score"), 6)).scalar()
    return stats.histogram(df, "Credit_Score", bins).withColumn("mean", mean)


# -- transactions --------------------------------------------------------------

def channel_adoption(df: DataFrame) -> DataFrame:
    online, mobile = _c("Online_Banking_Usage"), _c("Mobile_Banking_Usage")
    channels = {
        "Online Banking": F.sum(online), "Mobile Banking": F.sum(mobile),
        "Both": count_where((online == 1) & (mobile == 1)),
        "Neither": count_where((online == 0) & (mobile == 0)),
    }
    row = df.agg(*[v.alias(n) for n, v in channels.items()])
    return row.unpivot([], list(channels), "Channel", "Users")


def mean_with_text(df: DataFrame, key: str, value: str) -> DataFrame:
    return stats.group_mean(df, key, value).withColumn("Text", format_inr(_c(value)))


# -- loans ---------------------------------------------------------------------

def open_loans(df: DataFrame) -> DataFrame:
    return df.where(_c("Loan_Amount") > 0)


def top_loan_states(df: DataFrame, k: int = 10) -> DataFrame:
    crores = _c("Loan_Amount") / F.lit(CRORE)
    return (open_loans(df).where(_c("State").isNotNull()).groupBy("State")
            .agg(F.sum("Loan_Amount").alias("Loan_Amount"))
            .orderBy(F.desc("Loan_Amount"), "State").limit(k)
            .withColumns({"Loan_Cr": crores,
                          "Text": F.concat(F.lit("₹"), fixed(crores, 1), F.lit("Cr"))}))


def missed_default(df: DataFrame) -> DataFrame:
    """Default rate per missed-payment bucket of customers with a loan."""
    bucket = missed_bucket(_c("Missed_Payments"), "cut")
    return (open_loans(df).withColumn("Missed_Bucket", bucket)
            .where(_c("Missed_Bucket").isNotNull()).groupBy("Missed_Bucket")
            .agg(F.count("Default_Status").alias("Count"),
                 F.avg("Default_Status").alias("Default_Rate"))
            .withColumn("Default_Rate_Pct", _c("Default_Rate") * 100).orderBy("Missed_Bucket"))


# -- risk ----------------------------------------------------------------------

def risk_view(df: DataFrame, label: str | None = None) -> DataFrame:
    """All customers with groups, or those of one risk label."""
    return with_groups(df if label is None else df.where(_c("Risk_Label") == label))


def age_risk(df: DataFrame, label: str | None = None) -> DataFrame:
    return stats.crosstab_long(risk_view(df, label), ["Age_Group", "Risk_Label"])


def credit_risk(df: DataFrame, label: str | None = None) -> DataFrame:
    counts = risk_view(df, label).groupBy("Credit_Category", "Risk_Label").agg(
        F.count(F.lit(1)).alias("Count"))
    order = F.array_position(F.array(*[F.lit(v) for v in CREDIT_CATEGORIES]),
                             _c("Credit_Category"))
    return counts.orderBy(order, "Risk_Label")


def missed_risk(df: DataFrame, label: str | None = None) -> DataFrame:
    bucket = missed_bucket(_c("Missed_Payments"), "cut")
    return stats.crosstab_long(risk_view(df, label).withColumn("Missed_Bucket", bucket),
                               ["Missed_Bucket", "Risk_Label"])


def ratio_spread(df: DataFrame, label: str | None = None) -> DataFrame:
    return stats.five_numbers(risk_view(df, label), "Risk_Label", "Debt_to_Income_Ratio")


def state_credit_heatmap(df: DataFrame, label: str | None = None) -> DataFrame:
    """Percentage of high-risk customers, states by credit categories; 0 where empty."""
    return (risk_view(df, label).where(_c("State").isNotNull()).groupBy("State")
            .pivot("Credit_Category", CREDIT_CATEGORIES).agg(share(high()))
            .fillna(0.0, subset=CREDIT_CATEGORIES).orderBy("State"))


def high_risk_sample(df: DataFrame, k: int = 20) -> DataFrame:
    """The first ``k`` high-risk customers in customer order."""
    return (df.where(high())
            .select("Customer_ID", "Age", "Monthly_Income", "Credit_Score", "Missed_Payments",
                    "Debt_to_Income_Ratio", "Default_Status", "State")
            .orderBy("Customer_ID").limit(k))


# -- segments ------------------------------------------------------------------

def segment_summary(df: DataFrame) -> DataFrame:
    return (with_groups(df).groupBy("Segment")
            .agg(F.count("Customer_ID").alias("Count"),
                 F.avg("Monthly_Income").alias("Avg_Income"),
                 F.avg("Account_Balance").alias("Avg_Balance"),
                 F.avg("Credit_Score").alias("Avg_Credit_Score"),
                 F.avg("Transaction_Amount").alias("Avg_Txn_Amount"),
                 F.avg("Churn_Status").alias("Churn_Rate"),
                 share(high()).alias("High_Risk_Pct"))
            .orderBy(F.desc("Count"), "Segment"))


def segment_summary_text(df: DataFrame) -> DataFrame:
    return segment_summary(df).select(
        "Segment", "Count", *[rupees(_c(n)).alias(n) for n in ("Avg_Income", "Avg_Balance")],
        fixed(_c("Avg_Credit_Score"), 0).alias("Avg_Credit_Score"),
        rupees(_c("Avg_Txn_Amount")).alias("Avg_Txn_Amount"),
        percent_text(_c("Churn_Rate") * 100).alias("Churn_Rate"),
        percent_text(_c("High_Risk_Pct")).alias("High_Risk_Pct"))


def segment_risk(df: DataFrame) -> DataFrame:
    return stats.crosstab_long(with_groups(df), ["Segment", "Risk_Label"])


# -- exploratory report --------------------------------------------------------

def credit_counts(df: DataFrame) -> DataFrame:
    return stats.counts_in_order(with_groups(df), "Credit_Category", CREDIT_CATEGORIES)


def credit_risk_wide(df: DataFrame) -> DataFrame:
    """Credit categories by risk label, in category order."""
    order = F.array_position(F.array(*[F.lit(v) for v in CREDIT_CATEGORIES]),
                             _c("Credit_Category"))
    return stats.crosstab_wide(with_groups(df), "Credit_Category", "Risk_Label",
                               ["High", "Low", "Medium"]).orderBy(order)
