"""Derive the customer table from a sales star schema, and a raw, dirty copy of it.

Money is drawn in whole numbers and every share is computed from whole numbers, so
the result does not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.buckets import first_match
from ..schema import CLEAN_SCHEMA, MONEY_COLUMNS, ORDINAL, RAW_COLUMNS

AS_OF = "2024-12-31"


def read_star(spark: SparkSession, path: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{path.rstrip('/')}/{n}.parquet") for n in names]


def activity(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Per-customer totals over orders and their line items.

    Line items move once: four narrow columns meet the order's customer and date, and what
    the join gives is summed per customer map-side before the next exchange. An order with
    very many lines is split by the adaptive skew join. Totals that need no lines come from
    a second scan of the orders, so a column read for them never travels with the lines.
    Both sums end up dealt by customer, and joining them needs no further exchange.
    """
    flag = F.col("l_returnflag")
    lines = lineitem.select(
        "l_orderkey", F.when(flag == "A", F.col("l_shipdate")).alias("a_ship"),
        (flag == "R").alias("ret"),
        ((flag == "R") & (F.col("l_linestatus") == "F")).alias("retf"))
    owner = orders.select("o_orderkey", F.col("o_custkey").alias("owner"), "o_orderdate")
    by_lines = owner.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("owner").agg(
        F.count(F.lit(1)).alias("n_li"), F.count_if("ret").alias("n_ret"),
        F.count_if("retf").alias("n_retf"),
        F.count_if(F.col("a_ship") > F.col("o_orderdate")).alias("n_late"))
    priority = F.col("o_orderpriority")
    day = F.col("o_orderdate").cast("date")
    by_orders = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_ord"),
        F.sum(F.floor("o_totalprice")).alias("amt"),
        F.min(day).alias("first_dt"),
        F.max(day).alias("last_dt"),
        F.count_if(priority == "1-URGENT").alias("n_urgent"),
        F.count_if(priority == "2-HIGH").alias("n_high"),
        F.count_if(priority == "3-MEDIUM").alias("n_medium"),
        F.count_if(priority == "4-NOT SPECIFIED").alias("n_nospec"),
        F.count_if(priority == "5-LOW").alias("n_low"),
        F.count_if(F.col("o_orderstatus") == "P").alias("n_p"),
    )
    return by_orders.join(by_lines, F.col("o_custkey") == F.col("owner"), "left").drop("owner")


def _floor_div(col: Column, by: float) -> Column:
    return F.floor(col / F.lit(by))


def customer_table(spark: SparkSession, path: str) -> DataFrame:
    """One row per customer with every column of the clean schema."""
    customer, nation, orders, lineitem = read_star(
        spark, path, "customer", "nation", "orders", "lineitem")
    c, k = F.col, F.col("k")
    counts = ["n_ord", "amt", "n_urgent", "n_high", "n_medium", "n_nospec", "n_low",
              "n_p", "n_li", "n_ret", "n_retf", "n_late"]
    base = (
        customer.join(nation, c("c_nationkey") == c("n_nationkey"))
        .join(activity(orders, lineitem), c("c_custkey") == c("o_custkey"), "left")
        .select(
            c("c_custkey").alias("k"), c("c_acctbal").alias("bal"),
            c("c_mktsegment").alias("mkt"), c("n_name").alias("State"),
            "first_dt", "last_dt",
            *[F.coalesce(c(n), F.lit(0)).cast("bigint").alias(n) for n in counts],
        )
    )
    tenures = F.array(*[F.lit(t) for t in (12, 24, 36, 48, 60, 84, 120, 180, 240)])
    has_loan = c("n_p") >= 4
    flag = lambda p: p.cast("int")
    df = base.select(
        "*",
        F.format_string("CUST%06d", k).alias("Customer_ID"),
        (F.lit(18) + k * 37 % 58).cast("double").alias("Age"),
        first_match([(k * 11 % 100 < 54, "Male"), (k * 11 % 100 < 98, "Female")],
                    "Other").alias("Gender"),
        F.concat("State", F.when(k % 10 < 9, "_C0").otherwise("_C1")).alias("City"),
        first_match([(k * 17 % 100 < top, name) for top, name in (
            (40, "Salaried"), (60, "Self-Employed"), (72, "Business Owner"),
            (82, "Professional"), (89, "Retired"), (94, "Freelancer"), (98, "Homemaker"),
        )], "Student").alias("Occupation"),
        first_match([(c("mkt") == "MACHINERY", "Current"), (c("mkt") == "HOUSEHOLD", "Salary"),
                     (c("mkt") == "AUTOMOBILE", "Nri")], "Savings").alias("Account_Type"),
        F.floor(F.abs("bal") * 100).alias("Account_Balance"),
        (F.lit(8000) + _floor_div(c("amt"), 48.0)).alias("inc"),
        (F.lit(300) + (k * 7919 + c("n_ord") * 13) % 601).alias("cs"),
        F.coalesce(F.year("last_dt") - F.year("first_dt"), F.lit(0)).cast("bigint")
        .alias("Tenure_Years"),
        (F.lit(1) + c("n_urgent") % 5).alias("Number_of_Products"),
        F.when(~has_loan, "None").otherwise(first_match(
            [(k % 20 < 13, "Active"), (k % 20 < 18, "Closed")], "Npa")).alias("Loan_Status"),
        F.when(has_loan, _floor_div(c("amt") * (1 + k % 8), 16.0)).otherwise(0)
        .alias("Loan_Amount"),
        F.when(has_loan, F.get(tenures, (k % 9).cast("int"))).otherwise(0).cast("bigint")
        .alias("Loan_Tenure"),
        c("n_ord").alias("Transaction_Count"),
        _floor_div(c("amt"), 20.0).alias("Transaction_Amount"),
        flag(c("n_high") >= 2).alias("Online_Banking_Usage"),
        flag(c("n_medium") >= 2).alias("Mobile_Banking_Usage"),
        (c("n_ret") % 20).alias("ATM_Usage"),
        (c("n_late") % 10).alias("Branch_Visits"),
        flag(c("n_low") >= 2).alias("Credit_Card_Usage"),
        flag(c("n_nospec") >= 1).alias("Debit_Card_Usage"),
        F.when(has_loan, F.lit(1) + c("n_p") % 4).otherwise(0).cast("bigint")
        .alias("Existing_Loans"),
        (F.lit(1.0) + (k * 29 % 41) / F.lit(10.0)).alias("Customer_Satisfaction"),
        F.date_add("last_dt", 8553).alias("Last_Transaction_Date"),
    )
    df = df.select(
        "*",
        c("inc").cast("double").alias("Monthly_Income"),
        c("cs").cast("double").alias("Credit_Score"),
        F.when(c("Loan_Amount") > 0, F.floor(c("Loan_Amount") / c("Loan_Tenure").cast("double")))
        .otherwise(0).alias("EMI"),
        _floor_div(c("inc") * (30 + k % 56), 100.0).alias("Monthly_Expenses"),
        F.when(c("n_ord") > 0, F.floor(c("Transaction_Amount") / c("n_ord").cast("double")))
        .otherwise(0).alias("Average_Transaction_Value"),
        F.when(c("cs") < 600, c("n_retf") % 12).otherwise(_floor_div(c("n_retf"), 4.0))
        .alias("Missed_Payments"),
        F.when(c("Customer_Satisfaction") < 3, c("n_li") % 8).otherwise(c("n_li") % 3)
        .alias("Complaints"),
        F.coalesce(F.datediff(F.lit(AS_OF).cast("date"), "Last_Transaction_Date"), F.lit(365))
        .alias("Days_Since_Transaction"),
    )
    df = df.select(
        "*",
        F.least(c("Missed_Payments") + c("n_late") % 3, F.lit(15)).alias("Late_Payments"),
        (F.rint(c("EMI").cast("double") / c("inc") * 1000) / F.lit(1000.0))
        .alias("Debt_to_Income_Ratio"),
        F.least(c("Complaints") + k % 4, F.lit(15)).alias("Support_Calls"),
    )
    df = df.select(
        "*",
        flag(k * 7907 % 100 < scores.churn_percent()).alias("Churn_Status"),
        flag((k * 6007 + 31) % 100 < scores.default_percent()).alias("Default_Status"),
    )
    df = df.withColumn("Risk_Label", scores.risk_label())
    return df.select(*[c(f.name).cast(f.dataType) for f in CLEAN_SCHEMA])


def with_defects(clean: DataFrame) -> DataFrame:
    """All-text copy of a customer table with gaps, bad values and repeated customers.

    Gives the cleaning rules something to do. ``_seq`` is the file order: the
    repeated rows come last and differ from the first ones.
    """
    c = F.col
    k = F.substring("Customer_ID", 5, 20).cast("bigint")

    def damaged(df: DataFrame) -> DataFrame:
        k = c("k")
        text = {n: c(n).cast("string") for n in RAW_COLUMNS}
        for n in ("Age", "Credit_Score", *MONEY_COLUMNS):
            text[n] = c(n).cast("bigint").cast("string")
        text["Age"] = (F.when(k % 200 == 3, None).when(k % 200 == 53, "abc")
                       .when(k % 200 == 103, "150").otherwise(text["Age"]))
        text["Monthly_Income"] = (F.when(k % 125 == 7, None).when(k % 125 == 57, "0")
                                  .otherwise(text["Monthly_Income"]))
        text["Credit_Score"] = (F.when(k % 160 == 11, "nan").when(k % 160 == 91, "1200")
                                .otherwise(text["Credit_Score"]))
        text["Customer_Satisfaction"] = F.when(k % 100 != 13, text["Customer_Satisfaction"])
        text["Online_Banking_Usage"] = (F.when(k % 90 == 55, "9999999999")
                                        .when(k % 90 != 5, text["Online_Banking_Usage"]))
        text["Account_Balance"] = (F.when(k % 170 == 23, "1e30").when(k % 170 == 123, "1234.56")
                                   .otherwise(text["Account_Balance"]))
        text["Transaction_Count"] = F.when(k % 170 == 63, "1e20").otherwise(
            text["Transaction_Count"])
        text["Gender"] = (F.when(k % 300 == 29, None)
                          .when(k % 3 == 0, F.concat(F.lit("  "), F.upper("Gender"), F.lit(" ")))
                          .otherwise(c("Gender")))
        text["Occupation"] = F.when(k % 4 == 1, F.lower("Occupation")).otherwise(c("Occupation"))
        text["Last_Transaction_Date"] = (F.when(k % 150 == 31, "not-a-date")
                                         .when(k % 150 == 41, "2024")
                                         .when(k % 150 == 51, "03/05/2024")
                                         .when(k % 150 == 61, "2024-03-05T99")
                                         .when(k % 150 != 81, text["Last_Transaction_Date"]))
        text["Risk_Label"] = (F.when(k % 75 == 19, "unknown")
                              .when(k % 5 == 2, F.lower("Risk_Label")).otherwise(c("Risk_Label")))
        return df.select("_seq", *[text[n].alias(n) for n in RAW_COLUMNS])

    first = clean.withColumn("k", k).withColumn(ORDINAL, c("k"))
    again = (
        clean.withColumn("k", k).where(c("k") % 50 == 17)
        .withColumn(ORDINAL, c("k") + 1_000_000_000)
        .withColumn("Age", c("Age") + 1)
        .withColumn("Monthly_Income", c("Monthly_Income") + 1000)
    )
    return damaged(first).unionByName(damaged(again))
