"""Shared CTEs for the check statements: customer table, projections, raw copy."""

from __future__ import annotations


def rnd(expr: str, digits: int) -> str:
    """Round half up on the decimal form of a double.

    DuckDB rounds the scaled binary value, which moves decimal ties such as 1.005.
    """
    return (f"CAST(round(CAST(CAST(CAST({expr} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,15)), "
            f"{digits}) AS DOUBLE)")


def pct(num: str, den: str, digits: int = 2) -> str:
    return rnd(f"100.0::DOUBLE * {num} / nullif({den}, 0)", digits)


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


BANK = """
ord AS (
  SELECT o_custkey, count(*) AS n_ord,
    CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS amt,
    min(CAST(o_orderdate AS DATE)) AS first_dt, max(CAST(o_orderdate AS DATE)) AS last_dt,
    count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent,
    count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS n_high,
    count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS n_medium,
    count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') AS n_nospec,
    count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS n_low,
    count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p
  FROM orders GROUP BY o_custkey),
lin AS (
  SELECT o_custkey, count(*) AS n_li,
    count(*) FILTER (WHERE l_returnflag = 'R') AS n_ret,
    count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F') AS n_retf,
    count(*) FILTER (WHERE l_returnflag = 'A' AND l_shipdate > o_orderdate) AS n_late
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey),
src AS (
  SELECT c_custkey AS k, c_acctbal AS bal, c_mktsegment AS mkt, n_name AS nat,
    first_dt, last_dt, coalesce(n_ord, 0) AS n_ord, coalesce(amt, 0) AS amt,
    coalesce(n_urgent, 0) AS n_urgent, coalesce(n_high, 0) AS n_high,
    coalesce(n_medium, 0) AS n_medium, coalesce(n_nospec, 0) AS n_nospec,
    coalesce(n_low, 0) AS n_low, coalesce(n_p, 0) AS n_p, coalesce(n_li, 0) AS n_li,
    coalesce(n_ret, 0) AS n_ret, coalesce(n_retf, 0) AS n_retf, coalesce(n_late, 0) AS n_late
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN ord ON ord.o_custkey = c_custkey
  LEFT JOIN lin ON lin.o_custkey = c_custkey),
st1 AS (
  SELECT *, 8000 + CAST(floor(amt / 48.0::DOUBLE) AS BIGINT) AS inc,
    300 + (k * 7919 + 13 * n_ord) % 601 AS cs,
    1.0::DOUBLE + ((k * 29) % 41) / 10.0::DOUBLE AS sat,
    CASE WHEN n_p >= 4 THEN CAST(floor(amt * (1 + k % 8) / 16.0::DOUBLE) AS BIGINT) ELSE 0 END AS loan,
    CASE WHEN n_p >= 4 THEN [12,24,36,48,60,84,120,180,240][k % 9 + 1] ELSE 0 END AS ten,
    CAST(floor(amt / 20.0::DOUBLE) AS BIGINT) AS tamt,
    CAST(last_dt + 8553 AS DATE) AS ltd
  FROM src),
st2 AS (
  SELECT *, CASE WHEN loan > 0 THEN CAST(floor(loan / (ten * 1.0::DOUBLE)) AS BIGINT) ELSE 0 END AS emi,
    CASE WHEN cs < 600 THEN n_retf % 12 ELSE CAST(floor(n_retf / 4.0::DOUBLE) AS BIGINT) END AS missed,
    CASE WHEN sat < 3 THEN n_li % 8 ELSE n_li % 3 END AS compl,
    coalesce(date_diff('day', ltd, DATE '2024-12-31'), 365) AS days
  FROM st1),
st3 AS (
  SELECT *, round_even(emi * 1.0::DOUBLE / inc * 1000, 0) / 1000 AS dti,
    least(missed + n_late % 3, 15) AS late,
    CASE WHEN n_p < 4 THEN 'None' WHEN k % 20 < 13 THEN 'Active'
         WHEN k % 20 < 18 THEN 'Closed' ELSE 'Npa' END AS stat,
    CASE WHEN n_p >= 4 THEN 1 + n_p % 4 ELSE 0 END AS nloans,
    coalesce(year(last_dt) - year(first_dt), 0) AS tenure, 1 + n_urgent % 5 AS prods
  FROM st2),
st4 AS (
  SELECT *,
    CASE WHEN (k * 7907) % 100 < 5 + 15 * (sat < 2.5)::INT + 10 * (days > 60)::INT
      + 10 * (compl > 2)::INT + 10 * (prods = 1)::INT + 5 * (tenure < 2)::INT THEN 1 ELSE 0 END AS churn,
    CASE WHEN (k * 6007 + 31) % 100 < 2 + 25 * (cs < 550)::INT + 15 * (dti > 0.5)::INT
      + 12 * (missed > 3)::INT + 8 * (stat = 'Npa')::INT + 5 * (inc < 20000)::INT THEN 1 ELSE 0 END AS dflt
  FROM st3),
st5 AS (
  SELECT *, 25 * (cs < 600)::INT + 20 * (dti > 0.4)::INT + 18 * (missed > 2)::INT
    + 30 * dflt + 15 * (loan > inc * 18)::INT + 10 * (inc < 25000)::INT
    + 12 * (late > 2)::INT + 8 * (nloans > 2)::INT + 5 * (compl > 2)::INT AS pts
  FROM st4),
bank AS (
  SELECT printf('CUST%06d', k) AS Customer_ID, CAST(18 + (k * 37) % 58 AS DOUBLE) AS Age,
    CASE WHEN (k * 11) % 100 < 54 THEN 'Male' WHEN (k * 11) % 100 < 98 THEN 'Female' ELSE 'Other' END AS Gender,
    nat || CASE WHEN k % 10 < 9 THEN '_C0' ELSE '_C1' END AS City, nat AS State,
    CASE WHEN (k * 17) % 100 < 40 THEN 'Salaried' WHEN (k * 17) % 100 < 60 THEN 'Self-Employed'
      WHEN (k * 17) % 100 < 72 THEN 'Business Owner' WHEN (k * 17) % 100 < 82 THEN 'Professional'
      WHEN (k * 17) % 100 < 89 THEN 'Retired' WHEN (k * 17) % 100 < 94 THEN 'Freelancer'
      WHEN (k * 17) % 100 < 98 THEN 'Homemaker' ELSE 'Student' END AS Occupation,
    CASE mkt WHEN 'MACHINERY' THEN 'Current' WHEN 'HOUSEHOLD' THEN 'Salary'
      WHEN 'AUTOMOBILE' THEN 'Nri' ELSE 'Savings' END AS Account_Type,
    floor(abs(bal) * 100)::DOUBLE AS Account_Balance,
    CAST(inc AS DOUBLE) AS Monthly_Income, CAST(cs AS DOUBLE) AS Credit_Score,
    CAST(tenure AS BIGINT) AS Tenure_Years, CAST(prods AS BIGINT) AS Number_of_Products,
    stat AS Loan_Status, CAST(loan AS DOUBLE) AS Loan_Amount, CAST(ten AS BIGINT) AS Loan_Tenure,
    CAST(emi AS DOUBLE) AS EMI,
    floor(inc * (30 + k % 56) / 100.0::DOUBLE) AS Monthly_Expenses,
    n_ord AS Transaction_Count, CAST(tamt AS DOUBLE) AS Transaction_Amount,
    CASE WHEN n_ord > 0 THEN floor(tamt / (n_ord * 1.0::DOUBLE)) ELSE 0 END AS Average_Transaction_Value,
    (n_high >= 2)::INT AS Online_Banking_Usage, (n_medium >= 2)::INT AS Mobile_Banking_Usage,
    n_ret % 20 AS ATM_Usage, n_late % 10 AS Branch_Visits,
    (n_low >= 2)::INT AS Credit_Card_Usage, (n_nospec >= 1)::INT AS Debit_Card_Usage,
    CAST(missed AS BIGINT) AS Missed_Payments, CAST(late AS BIGINT) AS Late_Payments,
    CAST(nloans AS BIGINT) AS Existing_Loans, dti AS Debt_to_Income_Ratio,
    sat AS Customer_Satisfaction, CAST(compl AS BIGINT) AS Complaints,
    CAST(least(compl + k % 4, 15) AS BIGINT) AS Support_Calls, ltd AS Last_Transaction_Date,
    churn AS Churn_Status, dflt AS Default_Status,
    CASE WHEN pts >= 50 THEN 'High' WHEN pts >= 20 THEN 'Medium' ELSE 'Low' END AS Risk_Label,
    CAST(days AS INT) AS Days_Since_Transaction
  FROM st5)"""

TABLES = """
customers AS (
  SELECT * EXCLUDE (Loan_Status, Loan_Amount, Loan_Tenure, EMI, Transaction_Count,
    Transaction_Amount, Average_Transaction_Value, Missed_Payments, Late_Payments,
    Existing_Loans, Debt_to_Income_Ratio)
    REPLACE (CAST(Last_Transaction_Date AS VARCHAR) AS Last_Transaction_Date) FROM bank),
transactions AS (
  SELECT Customer_ID, Transaction_Count, Transaction_Amount, Average_Transaction_Value, ATM_Usage FROM bank),
loans AS (
  SELECT Customer_ID, Loan_Status, Loan_Amount, Loan_Tenure, EMI, Missed_Payments, Late_Payments,
    Existing_Loans, Debt_to_Income_Ratio, Default_Status FROM bank),
risk_analysis AS (
  SELECT Customer_ID, Credit_Score, Debt_to_Income_Ratio, Missed_Payments, Late_Payments,
    Default_Status, Churn_Status, Risk_Label, Complaints FROM bank)"""

def _whole(c: str) -> str:
    return f"CAST(CAST({c} AS BIGINT) AS VARCHAR)"


_RAW_KEPT = f"""City, State, Account_Type, CASE WHEN k % 170 = 23 THEN '1e30' WHEN k % 170 = 123 THEN '1234.56'
      ELSE {_whole("Account_Balance")} END AS Account_Balance,
    CAST(Tenure_Years AS VARCHAR) AS Tenure_Years, CAST(Number_of_Products AS VARCHAR) AS Number_of_Products,
    Loan_Status, {_whole("Loan_Amount")} AS Loan_Amount, CAST(Loan_Tenure AS VARCHAR) AS Loan_Tenure,
    {_whole("EMI")} AS EMI, {_whole("Monthly_Expenses")} AS Monthly_Expenses,
    CASE WHEN k % 170 = 63 THEN '1e20' ELSE CAST(Transaction_Count AS VARCHAR) END AS Transaction_Count,
    {_whole("Transaction_Amount")} AS Transaction_Amount,
    {_whole("Average_Transaction_Value")} AS Average_Transaction_Value,
    CAST(Mobile_Banking_Usage AS VARCHAR) AS Mobile_Banking_Usage, CAST(ATM_Usage AS VARCHAR) AS ATM_Usage,
    CAST(Branch_Visits AS VARCHAR) AS Branch_Visits, CAST(Credit_Card_Usage AS VARCHAR) AS Credit_Card_Usage,
    CAST(Debit_Card_Usage AS VARCHAR) AS Debit_Card_Usage, CAST(Missed_Payments AS VARCHAR) AS Missed_Payments,
    CAST(Late_Payments AS VARCHAR) AS Late_Payments, CAST(Existing_Loans AS VARCHAR) AS Existing_Loans,
    CAST(Debt_to_Income_Ratio AS VARCHAR) AS Debt_to_Income_Ratio, CAST(Complaints AS VARCHAR) AS Complaints,
    CAST(Support_Calls AS VARCHAR) AS Support_Calls, CAST(Churn_Status AS VARCHAR) AS Churn_Status,
    CAST(Default_Status AS VARCHAR) AS Default_Status"""

RAW = f"""
copies AS (
  SELECT *, CAST(substr(Customer_ID, 5) AS BIGINT) AS k, 0 AS extra FROM bank
  UNION ALL
  SELECT *, CAST(substr(Customer_ID, 5) AS BIGINT) AS k, 1 AS extra FROM bank
  WHERE CAST(substr(Customer_ID, 5) AS BIGINT) % 50 = 17),
raw AS (
  SELECT k + extra * 1000000000 AS _seq, Customer_ID,
    CASE WHEN k % 200 = 3 THEN NULL WHEN k % 200 = 53 THEN 'abc' WHEN k % 200 = 103 THEN '150'
      ELSE CAST(CAST(Age AS BIGINT) + extra AS VARCHAR) END AS Age,
    CASE WHEN k % 300 = 29 THEN NULL WHEN k % 3 = 0 THEN '  ' || upper(Gender) || ' ' ELSE Gender END AS Gender,
    CASE WHEN k % 4 = 1 THEN lower(Occupation) ELSE Occupation END AS Occupation,
    CASE WHEN k % 125 = 7 THEN NULL WHEN k % 125 = 57 THEN '0'
      ELSE CAST(CAST(Monthly_Income AS BIGINT) + extra * 1000 AS VARCHAR) END AS Monthly_Income,
    CASE WHEN k % 160 = 11 THEN 'nan' WHEN k % 160 = 91 THEN '1200'
      ELSE CAST(CAST(Credit_Score AS BIGINT) AS VARCHAR) END AS Credit_Score,
    CASE WHEN k % 100 <> 13 THEN CAST(Customer_Satisfaction AS VARCHAR) END AS Customer_Satisfaction,
    CASE WHEN k % 90 = 55 THEN '9999999999' WHEN k % 90 <> 5 THEN CAST(Online_Banking_Usage AS VARCHAR) END AS Online_Banking_Usage,
    CASE WHEN k % 150 = 31 THEN 'not-a-date' WHEN k % 150 = 41 THEN '2024'
      WHEN k % 150 = 51 THEN '03/05/2024' WHEN k % 150 = 61 THEN '2024-03-05T99' WHEN k % 150 <> 81 THEN CAST(Last_Transaction_Date AS VARCHAR)
      END AS Last_Transaction_Date,
    CASE WHEN k % 75 = 19 THEN 'unknown' WHEN k % 5 = 2 THEN lower(Risk_Label) ELSE Risk_Label END AS Risk_Label,
    {_RAW_KEPT}
  FROM copies)"""


def over_bank(body: str, ctes: str = "") -> str:
    """``body`` over the ``bank`` customer table, with optional further CTEs."""
    return f"WITH {BANK.strip()}{',' + ctes if ctes else ''}\n{body.strip()}"


def over_tables(body: str) -> str:
    return over_bank(body, TABLES)


def over_raw(body: str, ctes: str = "") -> str:
    return over_bank(body, RAW + ("," + ctes if ctes else ""))
