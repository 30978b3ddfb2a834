"""Plan shapes that must hold at any size: no exchange, no Python, no whole-table window."""

import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from tellerlake.operators import activity, geography, insights, lending, risk, segmentation
from tellerlake.plans import catalog
from tellerlake.sources import files, star, store

JOINED = [segmentation.customer_segments, segmentation.segment_summary,
          geography.loan_performance, lending.by_state, lending.strained_borrowers,
          risk.worst_payers, risk.high_ratio, risk.by_state, activity.top_spenders,
          activity.by_occupation, activity.by_risk]


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.fixture(scope="module")
def bucketed(spark, bank):
    """The four tables over a customer table in several buckets."""
    df = store.store_customers(bank, "bank_in_buckets", store.new_path(spark, "in-buckets"), 4)
    return store.split_tables(df)


@pytest.mark.parametrize("operator", JOINED)
def test_customer_joins_need_no_exchange(no_broadcast, bucketed, operator):
    text = plan(operator(bucketed))
    below = text[text.index("SortMergeJoin"):]
    assert "Exchange" not in below
    assert below.count("SelectedBucketsCount: 4 out of 4") == below.count("FileScan") > 1


def test_line_items_move_once(no_broadcast):
    text = plan(star.activity(*star.read_star(no_broadcast, SMALL, "orders", "lineitem")))
    joined = text[text.index("SortMergeJoin [o_orderkey"):]
    lines = joined[joined.index("Exchange hashpartitioning(l_orderkey"):]
    assert lines.count("Exchange") == 1
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string,l_linestatus:string,l_shipdate" in lines
    totals = text[:text.index("SortMergeJoin [o_orderkey")].rsplit("Exchange", 1)[1]
    assert "partial_count(1)" in totals  # lines are summed per customer before they move again
    top = text[text.index("SortMergeJoin [o_custkey"):text.index("SortMergeJoin [o_orderkey")]
    assert top.count("Exchange") == 2  # one for each sum by customer, none for joining them


@pytest.mark.parametrize("key", sorted({**catalog.CORPUS, **catalog.DERIVED, **catalog.PACKS,
                                        **catalog.PAGES, **catalog.INSIGHTS}))
def test_plans_stay_in_the_jvm(spark, bank, key):
    text = plan(catalog.all_queries()[key](spark, SMALL))
    assert not re.search(r"PythonUDF|BatchEvalPython|ArrowEvalPython|MapInPandas|CartesianProduct|"
                         r"BroadcastNestedLoopJoin", text)


@pytest.mark.parametrize("key", ["kpi_pack", "kpi_executive", "kpi_loans", "kpi_risk",
                                 "kpi_eda_summary", "recommendations", "insights_all",
                                 "kpi_risk_distribution", "segpage_summary"])
def test_one_scan(spark, bank, key):
    assert plan(catalog.all_queries()[key](spark, SMALL)).count("FileScan") == 1


def test_filter_and_columns_reach_the_scan(spark, bank):
    text = plan(catalog.all_queries()["loan_totals"](spark, SMALL))
    assert "GreaterThan(Loan_Amount,0.0)" in text
    assert re.search(r"ReadSchema: struct<Loan_Amount:double,Debt_to_Income_Ratio:double>", text)


def test_repeats_are_cut_before_the_exchange(spark, bank, tmp_path):
    from tellerlake.operators import cleaning
    path = str(tmp_path / "raw")
    files.write_csv(star.with_defects(bank), path)
    text = plan(cleaning.drop_repeats(files.read_raw_csv(spark, path, ordinal=True)))
    assert re.search(r"WindowGroupLimit.*Final[\s\S]*Exchange[\s\S]*WindowGroupLimit.*Partial", text)


def test_hot_order_and_hot_customer(spark, tmp_path):
    """One order holds a third of all lines and one customer most orders."""
    customer, nation, orders, lineitem = star.read_star(
        spark, SMALL, "customer", "nation", "orders", "lineitem")
    hot = lineitem.withColumn("l_orderkey", F.when(F.col("l_linenumber") % 3 == 0, 7)
                              .otherwise(F.col("l_orderkey")))
    owned = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 != 0, 5)
                              .otherwise(F.col("o_custkey")))
    got = star.activity(owned, hot).where("o_custkey = 5").first()
    joined = owned.where("o_custkey = 5").join(hot, F.col("o_orderkey") == F.col("l_orderkey"))
    want = joined.agg(
        F.count("*").alias("li"),
        F.count_if((F.col("l_returnflag") == "A") & (F.col("l_shipdate") > F.col("o_orderdate"))).alias("late"),
        F.count_if(F.col("l_returnflag") == "R").alias("ret")).first()
    assert (got.n_li, got.n_late, got.n_ret) == (want.li, want.late, want.ret)
    assert got.n_ord == owned.where("o_custkey = 5").count()


def test_stored_table_follows_its_source(spark, tmp_path):
    for name, df in zip(("customer", "nation", "orders", "lineitem"),
                        star.read_star(spark, SMALL, "customer", "nation", "orders", "lineitem")):
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    first = store.customers_of(spark, str(tmp_path)).count()
    assert first == 150 and store.customers_of(spark, str(tmp_path)).count() == 150
    customer = star.read_star(spark, SMALL, "customer")[0].where("c_custkey < 40")
    customer.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "customer.parquet"))
    assert store.customers_of(spark, str(tmp_path)).count() == 40


def test_recommendations_at_their_thresholds(spark, bank):
    """Figures exactly on a threshold fire nothing; then there is one healthy row."""
    rows = []
    for i in range(200):
        rows.append(("High" if i < 30 else "Low", int(i < 30), 2 + i % 2, int(i < 160), 0,
                     0.6 if i < 20 else 0.1, 500.0 if i < 30 else 700.0))
    df = spark.createDataFrame(
        rows, "Risk_Label string, Churn_Status int, Number_of_Products int, Online_Banking_Usage int, "
              "Mobile_Banking_Usage int, Debt_to_Income_Ratio double, Credit_Score double")
    assert [r.rule for r in insights.recommendations(df).collect()] == ["healthy"]
    worse = df.withColumn("Credit_Score", F.lit(500.0))
    assert [r.rule for r in insights.recommendations(worse).collect()] == ["credit health"]


def test_bucket_count_follows_the_source_size(spark):
    cores = spark.sparkContext.defaultParallelism
    assert [store.buckets(spark, n) for n in (0, 10_000_000, 10**9, 10**14)] == [
        1, min(cores, 3), cores, 25_001]


def test_missing_file_is_reported(spark, bank, tmp_path):
    df, error = files.load_customers(spark, str(tmp_path / "none"))
    assert df is None and "not found" in error
    files.write_csv(bank, str(tmp_path / "some"))
    df, error = files.load_customers(spark, str(tmp_path / "some"))
    assert error is None and df.exceptAll(bank).count() == 0


def test_memo_is_per_source(spark, bank):
    made = []
    for _ in range(2):
        assert store.once(spark, SMALL, "probe", lambda: made.append(1) or "kept") == "kept"
    assert store.once(spark, "/root/testdata/sf0.01", "probe", lambda: "other") == "other"
    assert made == [1]
