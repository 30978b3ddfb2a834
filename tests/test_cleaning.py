"""Cleaning rules on hand-made rows, and as a whole."""

import pytest
from pyspark.sql import functions as F
from tellerlake.operators import cleaning
from tellerlake.schema import CLEAN_SCHEMA, RAW_COLUMNS, RISK_LABELS
from tellerlake.sources import files, star, store

GOOD = {
    "Customer_ID": "CUST000001", "Age": "30", "Gender": "male", "City": "pune", "State": "goa",
    "Occupation": "self-employed", "Account_Type": "NRI", "Account_Balance": "1000",
    "Monthly_Income": "1000", "Credit_Score": "700", "Tenure_Years": "3", "Number_of_Products": "2",
    "Loan_Status": "NPA", "Loan_Amount": "0", "Loan_Tenure": "0", "EMI": "0",
    "Monthly_Expenses": "10", "Transaction_Count": "5", "Transaction_Amount": "50",
    "Average_Transaction_Value": "10", "Online_Banking_Usage": "1", "Mobile_Banking_Usage": "1",
    "ATM_Usage": "1", "Branch_Visits": "1", "Credit_Card_Usage": "1", "Debit_Card_Usage": "1",
    "Missed_Payments": "0", "Late_Payments": "0", "Existing_Loans": "0",
    "Debt_to_Income_Ratio": "9", "Customer_Satisfaction": "3.5", "Complaints": "0",
    "Support_Calls": "0", "Last_Transaction_Date": "2024-12-01", "Churn_Status": "0",
    "Default_Status": "0", "Risk_Label": "low",
}


def raw(spark, *changes):
    rows = []
    for i, change in enumerate(changes):
        row = {**GOOD, "Customer_ID": f"CUST{i:06d}", **change}
        rows.append((i, *[row[c] for c in RAW_COLUMNS]))
    return spark.createDataFrame(rows, "_seq bigint, " + ", ".join(f"{c} string" for c in RAW_COLUMNS))


def test_first_row_wins_even_when_hot(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 100)).alias("Customer_ID"),
        (20_000 - F.col("id")).alias("_seq"), F.col("id").alias("v"))
    got = {r[0]: r[1] for r in cleaning.drop_repeats(df.repartition(8)).select("Customer_ID", "v").collect()}
    best = {}
    for i in range(20_000):
        best["hot" if i % 3 == 0 else f"k{i % 100}"] = i
    assert got == best


def test_median_sees_rows_that_are_dropped_later(spark):
    df = raw(spark, {"Age": "20"}, {"Age": "40"}, {"Age": "150"}, {"Age": None}, {"Age": "abc"})
    out = {r.Customer_ID: r.Age for r in cleaning.clean_customers(df).collect()}
    assert out == {"CUST000000": 20.0, "CUST000001": 40.0, "CUST000003": 40.0, "CUST000004": 40.0}


def test_medians(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (None, None), (10.0, None), (11.0, None)],
                               "a double, b double")
    assert cleaning.medians(df, ["a", "b"]) == {"a": 6.0, "b": None}
    assert cleaning.impute_medians(df, ["a", "b"]).where("a = 6 AND b IS NULL").count() == 1


def test_invalid_rows_go(spark):
    bad = [{"Age": "17"}, {"Age": "101"}, {"Credit_Score": "299"}, {"Credit_Score": "901"},
           {"Monthly_Income": "0"}, {"Account_Balance": "-1"}, {"Transaction_Amount": "-1"},
           {"Transaction_Amount": "x"}]
    edge = [{"Age": "18"}, {"Age": "100"}, {"Credit_Score": "300"}, {"Credit_Score": "900"},
            {"Account_Balance": "0"}, {"Transaction_Amount": "0"}]
    out = cleaning.clean_customers(raw(spark, {}, *edge, *bad)).collect()
    assert sorted(r.Customer_ID for r in out) == [f"CUST{i:06d}" for i in range(7)]


def test_text_labels_dates_ratio(spark):
    df = raw(
        spark, {"EMI": "300"}, {"Gender": None, "Risk_Label": "HIGH", "Last_Transaction_Date": "no"},
        {"Last_Transaction_Date": "2025-06-01", "Risk_Label": "odd", "EMI": "9999"},
        {"Online_Banking_Usage": "", "Complaints": None})
    a, b, c, d = cleaning.clean_customers(df).orderBy("Customer_ID").collect()
    assert (a.Occupation, a.Account_Type, a.Loan_Status, a.City) == ("Self-Employed", "Nri", "Npa", "Pune")
    assert (a.Debt_to_Income_Ratio, a.Days_Since_Transaction, a.Risk_Label) == (0.3, 30, "Low")
    assert (b.Gender, b.Risk_Label, str(b.Last_Transaction_Date), b.Days_Since_Transaction) == (
        "Nan", "High", "2024-01-01", 365)
    assert (c.Days_Since_Transaction, c.Risk_Label, c.Debt_to_Income_Ratio) == (0, "Medium", 2.0)
    assert (d.Online_Banking_Usage, d.Complaints) == (0, 0)


def test_missing_columns_fail_early(spark):
    with pytest.raises(ValueError, match="EMI"):
        cleaning.clean_customers(raw(spark, {}).drop("EMI"))


def test_cleaning_is_idempotent(spark, bank):
    once = cleaning.clean_customers(star.with_defects(bank))
    again = once.select(F.monotonically_increasing_id().alias("_seq"),
                        *[F.col(c).cast("string").alias(c) for c in RAW_COLUMNS])
    twice = cleaning.clean_customers(again)
    kinds = [(f.name, f.dataType.simpleString()) for f in CLEAN_SCHEMA]
    assert once.dtypes == kinds and twice.dtypes == kinds
    assert once.count() == twice.count() > 0
    assert once.exceptAll(twice).count() == 0
    assert {r[0] for r in once.select("Risk_Label").distinct().collect()} <= set(RISK_LABELS)
    assert not cleaning.null_census(once).collect()


def test_money_keeps_its_fraction(spark):
    df = raw(spark, {"Account_Balance": "1234.56", "EMI": "104.50", "Loan_Amount": "10.25", "ATM_Usage": "2.9"},
             {"Account_Balance": None, "EMI": None}, {"Account_Balance": "1000.1", "Complaints": "1e20"})
    got = {r.Customer_ID: r for r in cleaning.clean_customers(df).collect()}
    first, second, third = (got[f"CUST00000{i}"] for i in range(3))
    assert (first.Account_Balance, first.EMI, first.Loan_Amount, first.ATM_Usage) == (1234.56, 104.5, 10.25, 2)
    assert first.Debt_to_Income_Ratio == 0.104  # of the whole instalment; the tie goes to even
    assert (second.Account_Balance, second.EMI) == ((1234.56 - 1000.1) * 0.5 + 1000.1, 0.0)
    assert (third.Account_Balance, third.Complaints) == (1000.1, 0)


def test_raw_file_order_is_kept(spark, tmp_path):
    rows = raw(spark, {"Customer_ID": "A", "Age": "20"}, {"Customer_ID": "B"}, {"Customer_ID": "A", "Age": "30"})
    path = str(tmp_path / "raw")
    files.write_csv(rows.drop("_seq").coalesce(1), path)
    got = cleaning.clean_customers(files.read_raw_csv(spark, path))
    assert {r.Customer_ID: r.Age for r in got.collect()} == {"A": 20.0, "B": 30.0}


def test_types_and_nulls(spark, bank):
    listed = cleaning.column_types(bank).collect()
    assert [(r["column"], r["type"]) for r in listed] == bank.dtypes
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b string")
    assert {tuple(r) for r in cleaning.null_census(df).collect()} == {("a", 1), ("b", 2)}


def test_tables_skip_unknown_columns_and_replace(spark, bank, tmp_path):
    parts = store.split_tables(bank.drop("City"))
    assert "City" not in parts["customers"].columns
    assert dict(parts["customers"].dtypes)["Last_Transaction_Date"] == "string"
    path = str(tmp_path / "tables")
    store.build_tables(bank, path)
    tables = store.build_tables(bank.limit(7), path)
    assert {n: t.count() for n, t in tables.items()} == {n: 7 for n in tables}
    assert spark.sql("SELECT count(*) FROM loans JOIN customers USING (Customer_ID)").first()[0] == 7


def test_columns_are_read_by_name(spark, tmp_path):
    rows = raw(spark, {"Age": "20", "Account_Balance": "1234.0"}, {"Gender": "female"})
    mixed = rows.select(F.lit("x").alias("More"), *sorted(RAW_COLUMNS, reverse=True))
    path = str(tmp_path / "mixed")
    files.write_csv(mixed.coalesce(1), path)
    got = {r.Customer_ID: r for r in files.read_raw_csv(spark, path).collect()}
    assert (got["CUST000000"].Age, got["CUST000000"].Gender, got["CUST000001"].Gender) == ("20", "male", "female")
    clean = str(tmp_path / "clean")
    files.write_csv(mixed.withColumn("Days_Since_Transaction", F.lit("3.0")).coalesce(1), clean)
    read = {r.Customer_ID: r for r in files.read_customers_csv(spark, clean).collect()}
    assert (read["CUST000000"].Account_Balance, read["CUST000000"].Days_Since_Transaction) == (1234, 3)
    with pytest.raises(ValueError, match="EMI"):
        files.write_csv(mixed.drop("EMI").coalesce(1), clean)
        files.read_customers_csv(spark, clean)


def test_text_that_fits_no_type_is_named(spark, tmp_path):
    path = str(tmp_path / "bad")
    files.write_csv(raw(spark, {"EMI": "12.5", "ATM_Usage": "12.5"}).drop("_seq").withColumn("Days_Since_Transaction", F.lit(1)), path)
    with pytest.raises(Exception, match="ATM_Usage: not a bigint: 12.5"):
        files.read_customers_csv(spark, path).collect()


def test_large_numbers_and_odd_dates(spark):
    df = raw(spark, {"Account_Balance": "1e30"}, {"Transaction_Count": "1e20", "Online_Banking_Usage": "9999999999"},
             {"Last_Transaction_Date": "2024"}, {"Last_Transaction_Date": "03/05/2024"},
             {"Last_Transaction_Date": "2024-03-05T99"}, {"Last_Transaction_Date": "2024-03-05 10:00:00"})
    a, b, c, d, e, f = cleaning.clean_customers(df).orderBy("Customer_ID").collect()
    assert (a.Account_Balance, b.Transaction_Count, b.Online_Banking_Usage) == (1e30, 0, 0)
    assert [str(r.Last_Transaction_Date) for r in (c, d, e, f)] == ["2024-01-01", "2024-03-05", "2024-01-01", "2024-03-05"]


def test_partitioned_sources_count_all_bytes(spark, tmp_path):
    for name in ("customer", "nation", "orders", "lineitem"):
        table = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        if name == "lineitem":
            table.write.partitionBy("l_returnflag").parquet(f"{tmp_path}/{name}.parquet")
        else:
            table.write.parquet(f"{tmp_path}/{name}.parquet")
    before = store.source_state(spark, str(tmp_path))
    assert before[3][1] > 50_000
    more = spark.read.parquet(f"{tmp_path}/lineitem.parquet").where("l_returnflag = 'A'").limit(5)
    more.write.mode("append").partitionBy("l_returnflag").parquet(f"{tmp_path}/lineitem.parquet")
    assert store.source_state(spark, str(tmp_path)) != before
