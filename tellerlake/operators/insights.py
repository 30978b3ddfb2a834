"""Findings and recommendations computed from the customer table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.buckets import missed_bucket
from ..functions.numeric import mean_where, share
from ..functions.text import fixed, percent_text
from .dashboard import high, with_groups

_c = F.col


def _top(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    return (df.where(_c(key).isNotNull()).groupBy(key).agg(value.alias(name))
            .orderBy(F.desc(name), key).limit(1))


def riskiest_segment(df: DataFrame) -> DataFrame:
    return _top(with_groups(df), "Segment", share(high()), "High_Risk_Pct")


def top_default_state(df: DataFrame) -> DataFrame:
    return _top(df, "State", F.avg("Default_Status") * 100, "Default_Rate_Pct")


def top_account_type(df: DataFrame) -> DataFrame:
    return _top(df, "Account_Type", F.avg("Account_Balance"), "Avg_Balance")


def _digital(flag: int) -> Column:
    return (_c("Online_Banking_Usage") == flag) & (_c("Mobile_Banking_Usage") == flag)


def _contrasts() -> dict[str, tuple[str, Column, str, Column]]:
    """Per finding: the two compared figures and their column names."""
    bucket = missed_bucket(_c("Missed_Payments"), "cut")
    dti, score = _c("Debt_to_Income_Ratio"), _c("Credit_Score")
    churn = lambda n: F.coalesce(
        mean_where(_c("Churn_Status"), _c("Number_of_Products") == n) * 100, F.lit(0.0))
    missed = lambda b: F.coalesce(share(high(), bucket == b), F.lit(0.0))
    return {
        "Credit Score & Risk": ("Below_600_Pct", share(high(), score < 600),
                                "From_700_Pct", share(high(), score >= 700)),
        "Debt-to-Income Impact": ("Over_Half_Pct", share(high(), dti > 0.5),
                                  "Up_To_0_3_Pct", share(high(), dti <= 0.3)),
        "Missed Payments": ("Six_Or_More_Pct", missed("6+"), "None_Missed_Pct", missed("0")),
        "Products & Churn": ("One_Product_Pct", churn(1), "Five_Products_Pct", churn(5)),
        "Digital Banking & Risk": ("Digital_Pct", share(high(), _digital(1)),
                                   "Non_Digital_Pct", share(high(), _digital(0))),
    }


def contrast(df: DataFrame, finding: str) -> DataFrame:
    """One finding that compares two groups, as one row."""
    name_a, a, name_b, b = _contrasts()[finding]
    return df.agg(a.alias(name_a), b.alias(name_b))


def default_by_state(df: DataFrame) -> DataFrame:
    return (df.where(_c("State").isNotNull()).groupBy("State")
            .agg((F.avg("Default_Status") * 100).alias("Default_Rate"))
            .orderBy(F.desc("Default_Rate"), "State"))


def churn_by_segment(df: DataFrame) -> DataFrame:
    return (with_groups(df).groupBy("Segment")
            .agg((F.avg("Churn_Status") * 100).alias("Churn_Rate"))
            .orderBy(F.desc("Churn_Rate"), "Segment"))


# Findings in the order they are reported.
FINDINGS = ["Riskiest Segment", "Highest Default State", "Credit Score & Risk",
            "Debt-to-Income Impact", "Missed Payments", "Products & Churn",
            "Account Type Balances", "Digital Banking & Risk"]


def all_findings(df: DataFrame) -> DataFrame:
    """All eight findings (position, insight, subject, value_a, value_b) from one scan.

    Grouping sets give one row per segment, state and account type and one for
    the whole table; the best row of each set is picked from those few.
    """
    contrasts = _contrasts()
    keys = ["Segment", "State", "Account_Type"]
    # Keys are copied so that the totals see the original columns, not the nulled keys.
    base = with_groups(df).withColumns({f"_{k}": _c(k) for k in keys})
    sets = [[_c(f"_{k}")] for k in keys] + [[]]
    rows = base.groupingSets(sets, *[_c(f"_{k}") for k in keys]).agg(
        *[F.grouping(f"_{k}").alias(f"_out_{k}") for k in keys],
        share(high()).alias("_high"),
        (F.avg("Default_Status") * 100).alias("_default"),
        F.avg("Account_Balance").alias("_balance"),
        *[F.struct(a.alias("a"), b.alias("b")).alias(f"_c{i}")
          for i, (_na, a, _nb, b) in enumerate(contrasts.values())],
    )

    def cell(name: str, subject: Column, a: Column, b: Column) -> Column:
        return F.struct(F.lit(FINDINGS.index(name) + 1).alias("position"),
                        F.lit(name).alias("insight"), subject.alias("subject"),
                        a.alias("value_a"), b.alias("value_b"))

    none, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    best = [("Riskiest Segment", "Segment", "_high"), ("Highest Default State", "State", "_default"),
            ("Account Type Balances", "Account_Type", "_balance")]
    totals = F.array(*[cell(name, no_text, _c(f"_c{i}")["a"], _c(f"_c{i}")["b"])
                       for i, name in enumerate(contrasts)])
    cells = totals
    for name, key, value in best:
        cells = F.when(_c(f"_out_{key}") == 0,
                       F.array(cell(name, _c(f"_{key}"), _c(value), none))).otherwise(cells)
    order = Window.partitionBy("position").orderBy(F.desc("value_a"), "subject")
    found = rows.select(F.explode(cells).alias("s")).select("s.*")
    grouped = [FINDINGS.index(name) + 1 for name, _k, _v in best]
    return (found.where(~(_c("position").isin(grouped) & _c("subject").isNull()))
            .withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")
            .orderBy("position"))


def recommendations(df: DataFrame) -> DataFrame:
    """Rules whose threshold is passed, from one pass; one ``healthy`` row when none is."""
    online, mobile = _c("Online_Banking_Usage") == 1, _c("Mobile_Banking_Usage") == 1
    # Thresholds of the six rules.
    rules = [
        ("risk mitigation", share(high()), lambda v: v > 15, percent_text),
        ("retention", F.avg("Churn_Status") * 100, lambda v: v > 15, percent_text),
        ("cross-sell", F.avg("Number_of_Products"), lambda v: v < 2.5, lambda v: fixed(v, 2)),
        ("digital adoption", share(online | mobile), lambda v: v < 80, percent_text),
        ("debt monitoring", share(_c("Debt_to_Income_Ratio") > 0.5), lambda v: v > 10,
         percent_text),
        ("credit health", share(_c("Credit_Score") < 600), lambda v: v > 15, percent_text),
    ]
    row = df.agg(*[value.alias(f"_{i}") for i, (_n, value, _f, _t) in enumerate(rules)])
    fired = F.array_compact(F.array(*[
        F.when(test(_c(f"_{i}")), F.struct(
            F.lit(i + 1).alias("position"), F.lit(name).alias("rule"),
            F.round(f"_{i}", 6).alias("metric"), text(_c(f"_{i}")).alias("metric_text")))
        for i, (name, _v, test, text) in enumerate(rules)
    ]))
    healthy = F.array(F.struct(
        F.lit(len(rules) + 1).alias("position"), F.lit("healthy").alias("rule"),
        F.lit(None).cast("double").alias("metric"), F.lit("").alias("metric_text")))
    cells = F.when(F.size(fired) == 0, healthy).otherwise(fired)
    return row.select(F.explode(cells).alias("s")).select("s.*")
