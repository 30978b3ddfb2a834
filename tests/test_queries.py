"""Every registered query against its check statement, and relations between queries."""

import pytest
from conftest import SMALL
from harness import compare, connect

import __spark_entry__ as entry_points
from tellerlake.plans.catalog import all_queries

QUERIES, CHECKS = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("key", sorted(CHECKS))
def test_query_matches_check(spark, duck, key):
    assert compare(QUERIES[key](spark, SMALL), duck, CHECKS[key]) is None


def test_entry(spark):
    assert entry_points.entry(spark).count() == 3


def test_no_query_is_named_as_a_step():
    # the corpus pipeline is registered apart, under the name its contract gives it
    assert not [k for k in all_queries() if "pipeline" in k]


def test_pack_agrees_with_single_figures(spark):
    run = lambda k: QUERIES[k](spark, SMALL).first()
    pack = run("kpi_pack")
    assert pack.Total_Customers == run("kpi_total_customers").Total_Customers
    assert pack.Total_Deposits_Crore == run("kpi_total_deposits_crore").Total_Deposits_Crore
    assert pack.Customer_Churn_Rate_Pct == run("kpi_churn_rate").Churn_Rate_Pct
    assert pack.Complaint_Rate_Pct == run("kpi_complaint_rate").Complaint_Rate_Pct
    assert pack.Active_Customers + pack.Inactive_Customers == pack.Total_Customers


@pytest.mark.parametrize("key", ["kpi_by_age_group", "seg_summary", "loan_missed_distribution",
                                 "txn_atm_distribution", "exec_risk_counts", "class_counts"])
def test_groups_cover_all_rows(spark, bank, key):
    assert QUERIES[key](spark, SMALL).groupBy().sum("Count").first()[0] == bank.count()
