"""Column expressions on hand-made rows at every edge."""

import math

import pytest
from pyspark.sql import functions as F
from tellerlake.functions import buckets, numeric, scores, text
from tellerlake.functions.segments import segment


def values(spark, kind, rows, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {kind}")
    made = expr("v" if expr in (text.title_case, text.parse_number, text.parse_date) else F.col("v"))
    return [r[0] for r in df.select("i", made.alias("x")).orderBy("i").select("x").collect()]


def test_title_case(spark):
    rows = ["  nRI", "self-employed", "o'neil", "tamil nadu\t", "élan vital", "", None]
    assert values(spark, "string", rows, text.title_case) == [
        "Nri", "Self-Employed", "O'Neil", "Tamil Nadu", "Élan Vital", "", None]


def test_parse_number(spark):
    rows = [" 12 ", "1e3", "-.5", "7.", "abc", "1,000", "1.0d", "nan", "", "inf", "0x1", None]
    assert values(spark, "string", rows, text.parse_number) == [
        12.0, 1000.0, -0.5, 7.0, None, None, None, None, None, None, None, None]


def test_parse_date(spark):
    got = values(spark, "string", ["2024-02-29", "2023-02-29", "soon", None], text.parse_date)
    assert [str(d) for d in got] == ["2024-02-29", "None", "None", "None"]


def test_format_inr(spark):
    rows = [0.0, 99_999.0, 100_000.0, 125_000.0, 9_999_999.0, 10_000_000.0, 1.23456e11, -5.0, 2.5]
    assert values(spark, "double", rows, text.format_inr) == [
        "₹0", "₹99,999", "₹1.0 L", "₹1.2 L", "₹100.0 L", "₹1.0 Cr", "₹12345.6 Cr", "₹-5", "₹2"]
    assert values(spark, "double", rows[:6], text.inr_unit) == ["", "", "L", "L", "L", "Cr"]


def test_half_even_and_ratio(spark):
    got = values(spark, "double", [0.0005, 0.0015, 0.0025], lambda c: numeric.half_even(c, 3))
    assert got == [0.0, 0.002, 0.002]
    assert values(spark, "double", [0.0, 4.0], lambda c: numeric.ratio(F.lit(1), c)) == [None, 0.25]


def test_debt_ratio(spark):
    df = spark.createDataFrame([(5.0, 0.0), (30.0, 10.0), (0.0005, 1.0), (-1.0, 4.0)],
                               "emi double, inc double")
    got = [r[0] for r in df.select(scores.debt_ratio(F.col("emi"), F.col("inc"))).collect()]
    assert got == [0.0, 2.0, 0.0, 0.0]


def test_age_groups(spark):
    rows = [17.0, 18.0, 25.0, 25.5, 26.0, 35.0, 45.0, 55.0, 55.5, 56.0, None]
    assert values(spark, "double", rows, buckets.age_group) == [
        "18-25", "18-25", "18-25", "26-35", "26-35", "26-35", "36-45", "46-55", "56+", "56+", "56+"]
    assert values(spark, "double", rows, lambda c: buckets.age_group(c, "between")) == [
        "56+", "18-25", "18-25", "56+", "26-35", "26-35", "36-45", "46-55", "56+", "56+", "56+"]


def test_missed_buckets(spark):
    rows = [-1.0, 0.0, 1.0, 2.0, 2.5, 3.0, 5.0, 6.0, 100.0, 101.0, None]
    bucket = lambda style: values(spark, "double", rows, lambda c: buckets.missed_bucket(c, style))
    assert bucket("between") == ["6+", "0", "1-2", "1-2", "6+", "3-5", "3-5", "6+", "6+", "6+", "6+"]
    assert bucket("upto") == ["1-2 Missed", "0 Missed", "1-2 Missed", "1-2 Missed", "3-5 Missed",
                              "3-5 Missed", "3-5 Missed", "6+ Missed", "6+ Missed", "6+ Missed", "6+ Missed"]
    assert bucket("cut") == [None, "0", "1-2", "1-2", "3-5", "3-5", "3-5", "6+", "6+", None, None]


def test_credit_categories(spark):
    rows = [499.0, 500.0, 599.0, 600.0, 699.0, 700.0, 749.0, 750.0]
    assert values(spark, "double", rows, buckets.credit_category) == [
        "Very Poor", "Poor", "Poor", "Fair", "Fair", "Good", "Good", "Excellent"]
    assert values(spark, "double", rows[:2], lambda c: buckets.credit_category(c, "ranged")) == [
        "Very Poor (<500)", "Poor (500-599)"]


def test_atm_buckets(spark):
    rows = [0, 1, 3, 4, 6, 7, 10, 11]
    assert values(spark, "int", rows, buckets.atm_bucket) == [
        "0", "1-3", "1-3", "4-6", "4-6", "7-10", "7-10", "10+"]


def test_unknown_style():
    for call in (lambda: buckets.age_group(None, "x"), lambda: buckets.credit_category(None, "x"),
                 lambda: buckets.missed_bucket(None, "x"), lambda: segment("x")):
        with pytest.raises(ValueError):
            call()


BASE = dict(Account_Balance=0, Credit_Score=600.0, Number_of_Products=1, Transaction_Amount=50_000,
            Online_Banking_Usage=0, Mobile_Banking_Usage=0, Loan_Amount=0, Debt_to_Income_Ratio=0.0,
            Churn_Status=0, Days_Since_Transaction=0, Branch_Visits=5, Transaction_Count=9)


@pytest.mark.parametrize("change, detail, summary, dashboard", [
    ({}, "Regular", "Regular", "Regular"),
    (dict(Account_Balance=500_000, Credit_Score=750.0, Number_of_Products=3),) + ("Premium",) * 3,
    (dict(Account_Balance=500_000, Credit_Score=750.0, Number_of_Products=2),) + ("High Value",) * 3,
    (dict(Account_Balance=200_000, Credit_Score=650.0),) + ("High Value",) * 3,
    (dict(Account_Balance=199_999, Credit_Score=650.0),) + ("Regular",) * 3,
    (dict(Transaction_Amount=100_000, Online_Banking_Usage=1), "Digital First", "Regular", "Regular"),
    (dict(Online_Banking_Usage=1, Mobile_Banking_Usage=1), "Regular", "Digital First", "Digital First"),
    (dict(Loan_Amount=1, Debt_to_Income_Ratio=0.36, Churn_Status=1),) + ("Loan Dependent",) * 3,
    (dict(Loan_Amount=1, Debt_to_Income_Ratio=0.35),) + ("Regular",) * 3,
    (dict(Churn_Status=1),) + ("At Risk",) * 3,
    (dict(Days_Since_Transaction=91), "At Risk", "At Risk", "Regular"),
    (dict(Days_Since_Transaction=90),) + ("Regular",) * 3,
    (dict(Transaction_Amount=19_999, Branch_Visits=1), "Low Engagement", "Regular", "Regular"),
    (dict(Transaction_Count=4), "Regular", "Low Engagement", "Low Engagement"),
    (dict(Loan_Amount=None, Debt_to_Income_Ratio=None),) + ("Regular",) * 3,
])
def test_segments(spark, change, detail, summary, dashboard):
    row = {**BASE, **change}
    schema = ", ".join(
        f"{k} {'double' if k in ('Credit_Score', 'Debt_to_Income_Ratio') else 'int'}" for k in row)
    df = spark.createDataFrame([tuple(row.values())], schema)
    got = df.select(segment("detail"), segment("summary"), segment("dashboard")).first()
    assert tuple(got) == (detail, summary, dashboard)


RISKY = dict(Credit_Score=599.0, Debt_to_Income_Ratio=0.41, Missed_Payments=3, Default_Status=1,
             Loan_Amount=360_001, Monthly_Income=20_000.0, Late_Payments=3, Existing_Loans=3,
             Complaints=3, Loan_Status="Npa", Customer_Satisfaction=2.4, Days_Since_Transaction=61,
             Number_of_Products=1, Tenure_Years=1)
SAFE = dict(Credit_Score=600.0, Debt_to_Income_Ratio=0.4, Missed_Payments=2, Default_Status=0,
            Loan_Amount=450_000, Monthly_Income=25_000.0, Late_Payments=2, Existing_Loans=2,
            Complaints=2, Loan_Status="Active", Customer_Satisfaction=2.5, Days_Since_Transaction=60,
            Number_of_Products=2, Tenure_Years=2)
SCORED = ("Credit_Score double, Debt_to_Income_Ratio double, Missed_Payments int, Default_Status int, "
          "Loan_Amount int, Monthly_Income double, Late_Payments int, Existing_Loans int, Complaints int, "
          "Loan_Status string, Customer_Satisfaction double, Days_Since_Transaction int, "
          "Number_of_Products int, Tenure_Years int")


def test_rule_scores(spark):
    df = spark.createDataFrame([tuple(RISKY.values()), tuple(SAFE.values())], SCORED)
    rows = df.select(scores.risk_score().alias("s"), scores.risk_label().alias("l"),
                     scores.default_percent().alias("d"), scores.churn_percent().alias("c"),
                     scores.risk_indicators().alias("i")).collect()
    assert rows[0].s == pytest.approx(14.3) and rows[0].l == "High"
    assert (rows[1].s, rows[1].l) == (0.0, "Low")
    assert (rows[0].d, rows[0].c) == (2 + 8, 55)
    assert (rows[1].d, rows[1].c) == (2, 5)
    assert rows[0].i == scores.INDICATORS and rows[1].i == [scores.NO_INDICATOR]


def test_indicator_text(spark):
    df = spark.createDataFrame([tuple(RISKY.values())], SCORED).withColumn(
        "code", F.explode(scores.risk_indicators()))
    got = [r[0] for r in df.select(scores.indicator_text(F.col("code"))).collect()]
    assert got == ["Credit score 599 is under 600.", "Debt-to-income ratio 0.41 is over 0.4.",
                   "3 payments were missed.", "The loan is 18 times the monthly income.",
                   "There are 3 loans already."]


def test_zero_divisors(spark):
    df = spark.createDataFrame([(100, 0)], "a int, n int")
    got = df.select(scores.instalment(F.col("a"), F.col("n")), scores.average_ticket(F.col("a"), F.col("n")),
                    scores.applicant_ratio(F.col("n"), F.col("n")),
                    scores.applicant_ratio(F.col("a"), F.col("n")),
                    numeric.percent(F.col("a"), F.col("n"))).first()
    assert tuple(got) == (100, 100, 0.0, 100.0, None)
    assert not any(isinstance(v, float) and math.isnan(v) for v in got if v is not None)
