"""Check statements for KPI packs, statistics, dashboard tables and insights."""

from __future__ import annotations

from ...schema import CLEAN_SCHEMA, CORRELATED_COLUMNS
from .base import big, over_bank, rnd
from .corpus import SEG_APP
from .derived import AGE_UPTO, CREDIT, MISSED_CUT, inr

HI = "(CASE WHEN Risk_Label = 'High' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
DASH = f"""
dash AS (SELECT *, {SEG_APP} AS Segment, {CREDIT} AS Credit_Category, {AGE_UPTO} AS Age_Group,
  {MISSED_CUT} AS Missed_Bucket FROM bank)"""
PAGE = """
page AS (SELECT * FROM bank WHERE Age BETWEEN 18 AND 75 AND Credit_Score BETWEEN 300 AND 900)"""
LOANS = """
lend AS (SELECT * FROM bank WHERE Loan_Amount > 0)"""
RUPEE = lambda x: f"'₹' || format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT))"
PCT_TEXT = lambda x: f"printf('%.1f%%', {x})"


def counts(col: str, name: str, src: str = "bank", tail: str = "") -> str:
    return f"SELECT {col} AS {name}, count(*) AS Count FROM {src} WHERE {col} IS NOT NULL GROUP BY 1 {tail}"


def hist(col: str, bins: int, src: str = "bank", extra: str = "") -> str:
    return f"""SELECT i AS bin, lo + i * w AS bin_start, lo + (i + 1) * w AS bin_end,
        count(x) AS Count{extra}
        FROM (SELECT range AS i FROM range({bins}))
        CROSS JOIN (SELECT min({col})::DOUBLE AS lo, (max({col})::DOUBLE - min({col})::DOUBLE) / {bins}.0::DOUBLE AS w
          FROM {src}) e
        LEFT JOIN (SELECT {col}::DOUBLE AS x FROM {src}) v
          ON least(CAST(floor((x - lo) / w) AS BIGINT), {bins} - 1) = i
        GROUP BY i, lo, w"""


def cross(a: str, b: str, src: str = "dash") -> str:
    return f"SELECT {a}, {b}, count(*) AS Count FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL"


def gmean(key: str, value: str, src: str = "bank", text: bool = False) -> str:
    extra = f", {inr(f'avg({value})')} AS Text" if text else ""
    return f"SELECT {key}, avg({value})::DOUBLE AS {value}{extra} FROM {src} GROUP BY {key}"


def describe(columns: list[str]) -> str:
    one = [f"""SELECT '{c}' AS "column", count({c})::DOUBLE AS count, {rnd(f'avg({c})', 2)} AS mean,
        {rnd(f'stddev_samp({c})', 2)} AS std, {rnd(f'min({c})', 2)} AS min,
        {rnd(f'quantile_cont({c}::DOUBLE, 0.25)', 2)} AS q25, {rnd(f'quantile_cont({c}::DOUBLE, 0.5)', 2)} AS q50,
        {rnd(f'quantile_cont({c}::DOUBLE, 0.75)', 2)} AS q75, {rnd(f'max({c})', 2)} AS max FROM bank"""
           for c in columns]
    return "\nUNION ALL ".join(one)


def correlation(columns: list[str]) -> str:
    cells = []
    for a in columns:
        for b in columns:
            cells.append(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS r FROM bank")
    return "\nUNION ALL ".join(cells)


def five(key: str, value: str, src: str = "bank") -> str:
    return f"""SELECT {key}, min, q1, median, q3, max, q1 - (q3 - q1) * 1.5::DOUBLE AS lower_fence,
        q3 + (q3 - q1) * 1.5::DOUBLE AS upper_fence FROM (
        SELECT {key}, min({value})::DOUBLE AS min, quantile_cont({value}::DOUBLE, 0.25) AS q1,
        quantile_cont({value}::DOUBLE, 0.5) AS median, quantile_cont({value}::DOUBLE, 0.75) AS q3,
        max({value})::DOUBLE AS max FROM {src} GROUP BY {key})"""


def cat_filter(v: str) -> str:
    return f'coalesce(avg({HI}) FILTER (WHERE Credit_Category = \'{v}\') * 100, 0) AS "{v}"'


def best(key: str, expr: str, name: str) -> str:
    return f"SELECT {key}, {expr} AS {name} FROM dash GROUP BY {key} ORDER BY 2 DESC, 1 LIMIT 1"


CATS = ["Very Poor", "Poor", "Fair", "Good", "Excellent"]
NUMERIC = [f.name for f in CLEAN_SCHEMA if f.dataType.simpleString() in ("bigint", "int", "double")]
SHARE = lambda p: f"(avg({HI}) FILTER (WHERE {p}) * 100)"
CONTRASTS = {
    "credit_vs_risk": ("Below_600_Pct", SHARE("Credit_Score < 600"),
                       "From_700_Pct", SHARE("Credit_Score >= 700")),
    "dti_vs_risk": ("Over_Half_Pct", SHARE("Debt_to_Income_Ratio > 0.5"),
                    "Up_To_0_3_Pct", SHARE("Debt_to_Income_Ratio <= 0.3")),
    "missed_vs_risk": ("Six_Or_More_Pct", f"coalesce({SHARE('Missed_Payments BETWEEN 6 AND 100')}, 0)",
                       "None_Missed_Pct", f"coalesce({SHARE('Missed_Payments = 0')}, 0)"),
    "products_vs_churn": (
        "One_Product_Pct", "coalesce(avg(Churn_Status) FILTER (WHERE Number_of_Products = 1) * 100, 0)",
        "Five_Products_Pct", "coalesce(avg(Churn_Status) FILTER (WHERE Number_of_Products = 5) * 100, 0)"),
    "digital_vs_risk": ("Digital_Pct", SHARE("Online_Banking_Usage + Mobile_Banking_Usage = 2"),
                        "Non_Digital_Pct", SHARE("Online_Banking_Usage + Mobile_Banking_Usage = 0")),
}


def rule(pos: int, name: str, value: str, fires: str, text: str) -> str:
    return (f"SELECT {pos} AS position, '{name}' AS rule, {value} AS v, {fires.format(v=value)} AS fired, "
            f"{text.format(v=value)} AS metric_text FROM bank")


def _kpis() -> dict[str, str]:
    cnt = lambda p: f"count(*) FILTER (WHERE {p})"
    lab = lambda v: cnt(f"Risk_Label = '{v}'")
    labshare = lambda v: f"(avg(CASE WHEN Risk_Label = '{v}' THEN 1.0::DOUBLE ELSE 0 END) * 100)"
    dep, lns, vol = (f"sum({c})" for c in ("Account_Balance", "Loan_Amount", "Transaction_Amount"))
    summary = [
        ("Total Customers", "count(*)", "format('{{:,}}', {v})"),
        ("Active Customers", cnt("Churn_Status = 0"), "format('{{:,}}', {v})"),
        ("Churn Rate", "avg(Churn_Status) * 100", "printf('%.1f%%', {v})"),
        ("Avg Monthly Income", "avg(Monthly_Income)", None),
        ("Avg Account Balance", "avg(Account_Balance)", None),
        ("Avg Credit Score", "avg(Credit_Score)", "printf('%.0f', {v})"),
        ("Loan Customers", cnt("Loan_Amount > 0"), "format('{{:,}}', {v})"),
        ("Default Rate", "avg(Default_Status) * 100", "printf('%.1f%%', {v})"),
        *[(f"{v} Risk %", labshare(v), "printf('%.1f%%', {v})") for v in ("High", "Medium", "Low")],
    ]
    rows = [f"SELECT {i} AS Position, '{n}' AS Metric, {rnd(v, 6)} AS Value, "
            f"{(t.format(v=v) if t else RUPEE(v))} AS Text FROM bank"
            for i, (n, v, t) in enumerate(summary, 1)]
    return {
        "kpi_pack": over_bank(f"""SELECT count(*) AS Total_Customers, {cnt('Churn_Status = 0')} AS Active_Customers,
            {cnt('Churn_Status <> 0')} AS Inactive_Customers, {rnd('avg(Age)', 1)} AS Average_Age,
            {rnd('avg(Monthly_Income)', 0)} AS Average_Income, {rnd('avg(Account_Balance)', 0)} AS Average_Account_Balance,
            {rnd('sum(Account_Balance) / 1e7', 2)} AS Total_Deposits_Crore,
            {rnd('sum(Loan_Amount) / 1e7', 2)} AS Total_Loan_Amount_Crore,
            {rnd('avg(Credit_Score)', 1)} AS Average_Credit_Score,
            {rnd('avg(Transaction_Amount)', 0)} AS Average_Transaction_Amount,
            {big('sum(Transaction_Count)')} AS Total_Transactions,
            {rnd('avg(Number_of_Products)', 2)} AS Avg_Products_per_Customer,
            {cnt('Loan_Amount > 0')} AS Loan_Customers, {rnd('avg(Default_Status) * 100', 2)} AS Loan_Default_Rate_Pct,
            {rnd('avg(Churn_Status) * 100', 2)} AS Customer_Churn_Rate_Pct, {lab('High')} AS High_Risk_Customers,
            {lab('Medium')} AS Medium_Risk_Customers, {lab('Low')} AS Low_Risk_Customers,
            {rnd('avg(CASE WHEN Complaints > 0 THEN 1.0::DOUBLE ELSE 0 END) * 100', 2)} AS Complaint_Rate_Pct,
            {rnd('avg(Debt_to_Income_Ratio)', 3)} AS Avg_Debt_to_Income_Ratio FROM bank"""),
        "kpi_executive": over_bank(f"""SELECT count(*) AS Total_Customers, {cnt('Churn_Status = 0')} AS Active_Customers,
            {dep} AS Total_Deposits, {inr(dep)} AS Total_Deposits_Text, {lns} AS Total_Loans,
            {inr(lns)} AS Total_Loans_Text, {rnd('avg(Credit_Score)', 0)} AS Avg_Credit_Score,
            {rnd('avg(Default_Status) * 100', 1)} AS Default_Rate_Pct, {rnd('avg(Churn_Status) * 100', 1)} AS Churn_Rate_Pct,
            {lab('High')} AS High_Risk_Customers, {rnd(labshare('High'), 1)} AS High_Risk_Pct,
            {rnd('avg(Monthly_Income)', 2)} AS Avg_Monthly_Income,
            {inr('avg(Monthly_Income)')} AS Avg_Monthly_Income_Text FROM bank"""),
        "kpi_transactions": over_bank(f"""SELECT {big('sum(Transaction_Count)')} AS Total_Transactions,
            {vol} AS Total_Volume, {inr(vol)} AS Total_Volume_Text,
            {rnd('avg(Average_Transaction_Value)', 2)} AS Avg_Txn_Value,
            {big('sum(Online_Banking_Usage)')} AS Online_Users,
            {rnd('avg(Online_Banking_Usage) * 100', 0)} AS Online_Pct FROM bank"""),
        "kpi_loans": over_bank(f"""SELECT {cnt('Loan_Amount > 0')} AS Loan_Customers,
            {rnd('avg(CASE WHEN Loan_Amount > 0 THEN 1.0::DOUBLE ELSE 0 END) * 100', 0)} AS Loan_Customer_Pct,
            sum(Loan_Amount) FILTER (WHERE Loan_Amount > 0) AS Loan_Portfolio,
            {rnd('avg(Loan_Amount) FILTER (WHERE Loan_Amount > 0)', 2)} AS Avg_Loan,
            {rnd('(avg(Default_Status) FILTER (WHERE Loan_Amount > 0)) * 100', 2)} AS Loan_Default_Pct,
            {rnd('avg(Debt_to_Income_Ratio) FILTER (WHERE Loan_Amount > 0)', 3)} AS Avg_Loan_DTI FROM bank"""),
        "kpi_risk": over_bank("SELECT " + ", ".join(
            f"{lab(v)} AS {v}_Risk, {rnd(labshare(v), 1)} AS {v}_Risk_Pct" for v in ("High", "Medium", "Low"))
            + ", " + rnd("avg(Debt_to_Income_Ratio) FILTER (WHERE Risk_Label = 'High')", 3)
            + " AS Avg_High_Risk_DTI FROM bank"),
        "kpi_eda_summary": over_bank("\nUNION ALL ".join(rows)),
    }


def statements() -> dict[str, str]:
    bank = {
        # generic operators
        "value_counts": counts("City", "City"),
        "crosstab_long": cross("Gender", "Account_Type", "bank"),
        "crosstab_wide": """SELECT Occupation, count(*) FILTER (WHERE Gender = 'Female') AS Female,
            count(*) FILTER (WHERE Gender = 'Male') AS Male, count(*) FILTER (WHERE Gender = 'Other') AS Other
            FROM bank GROUP BY 1""",
        "group_mean": f"SELECT Gender, {rnd('avg(Customer_Satisfaction) * 20', 9)} AS Satisfaction_Pct FROM bank GROUP BY 1",
        "group_share": """SELECT State, Gender, avg(CASE WHEN Complaints > 2 THEN 1.0::DOUBLE ELSE 0 END) * 100 AS Pct
            FROM bank GROUP BY ALL""",
        "histogram": hist("Monthly_Expenses", 25),
        "five_number_summary": five("Account_Type", "Account_Balance"),
        "describe_numeric": describe(["Account_Balance", "Loan_Amount", "Debt_to_Income_Ratio"]),
        "correlation_matrix": correlation(["Age", "Monthly_Income", "Credit_Score", "Tenure_Years"]),
        "filter_customers": """SELECT Customer_ID, Age, Gender, State, Account_Type, Credit_Score FROM bank
            WHERE Age BETWEEN 25 AND 60 AND Gender IN ('Male', 'Female') AND State <> 'NATION_0'
            AND State IN (SELECT n_name FROM nation) AND Account_Type IN ('Savings', 'Current', 'Salary')
            AND Credit_Score BETWEEN 400 AND 850""",
        # executive page
        "exec_risk_counts": counts("Risk_Label", "Risk"),
        "exec_account_type_counts": counts("Account_Type", "Account_Type"),
        "exec_top_states": counts("State", "State", tail="ORDER BY 2 DESC, 1 LIMIT 10"),
        "exec_credit_score_hist": hist(
            "Credit_Score", 40, extra=f", (SELECT {rnd('avg(Credit_Score)', 6)} FROM bank) AS mean"),
        "exec_state_risk": cross("State", "Risk_Label", "bank"),
        # transaction page
        "txn_amount_hist": hist("Transaction_Amount", 40),
        "txn_count_hist": hist("Transaction_Count", 30),
        "txn_channel_adoption": """SELECT 'Online Banking' AS Channel, CAST(sum(Online_Banking_Usage) AS BIGINT) AS Users FROM bank
            UNION ALL SELECT 'Mobile Banking', CAST(sum(Mobile_Banking_Usage) AS BIGINT) FROM bank
            UNION ALL SELECT 'Both', count(*) FROM bank WHERE Online_Banking_Usage + Mobile_Banking_Usage = 2
            UNION ALL SELECT 'Neither', count(*) FROM bank WHERE Online_Banking_Usage + Mobile_Banking_Usage = 0""",
        "txn_atm_hist": hist("ATM_Usage", 20),
        "txn_amount_by_occupation": gmean("Occupation", "Transaction_Amount", text=True),
        "txn_amount_by_risk": gmean("Risk_Label", "Transaction_Amount", text=True),
        "txn_branch_hist": hist("Branch_Visits", 10),
        "cust_occupation_counts": counts("Occupation", "Occupation"),
        "eda_income_hist": hist("Monthly_Income", 50),
        "eda_balance_hist": hist("Account_Balance", 50),
        "risk_high_sample": """SELECT Customer_ID, Age, Monthly_Income, Credit_Score, Missed_Payments,
            Debt_to_Income_Ratio, Default_Status, State FROM bank WHERE Risk_Label = 'High'
            ORDER BY Customer_ID LIMIT 20""",
        "risk_dti_quartiles": five("Risk_Label", "Debt_to_Income_Ratio"),
        "eda_describe": describe(NUMERIC),
        "eda_income_describe": "SELECT statistic, v AS value, '₹' || format('{:,}', CAST(round_even(v, 0) AS BIGINT)) AS text FROM ("
            + "\nUNION ALL ".join(f"SELECT '{n}' AS statistic, {rnd(e, 6)} AS v FROM bank" for n, e in [
                ("count", "count(Monthly_Income)"), ("mean", "avg(Monthly_Income)"),
                ("std", "stddev_samp(Monthly_Income)"), ("min", "min(Monthly_Income)"),
                ("q25", "quantile_cont(Monthly_Income, 0.25)"), ("q50", "quantile_cont(Monthly_Income, 0.5)"),
                ("q75", "quantile_cont(Monthly_Income, 0.75)"), ("max", "max(Monthly_Income)")]) + ")",
        "eda_date_describe": "SELECT 'Last_Transaction_Date' AS \"column\", n AS count, " + ", ".join(
            f"strftime(make_timestamp(CAST({rnd(c, 0)} AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS {c}"
            for c in ("mean", "min", "q25", "q50", "q75", "max")) + """ FROM (SELECT count(x) AS n, avg(x) AS mean,
            min(x) AS min, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50,
            quantile_cont(x, 0.75) AS q75, max(x) AS max FROM (
            SELECT date_diff('day', DATE '1970-01-01', Last_Transaction_Date) * 86400.0::DOUBLE AS x FROM bank))""",
        "eda_correlation": correlation(CORRELATED_COLUMNS),
    }
    page = {
        "cust_filtered_count": """SELECT count(*) AS Customers FROM bank WHERE Age BETWEEN 25 AND 60
            AND Gender IN ('Male', 'Female') AND Credit_Score BETWEEN 400 AND 850""",
        "cust_age_hist": hist("Age", 30, "page"),
        "cust_gender_counts": f"""SELECT Gender, count(*) AS Count,
            {rnd('count(*) * 100.0::DOUBLE / (SELECT count(*) FROM page)', 1)} AS Pct FROM page GROUP BY 1""",
        "cust_income_hist": hist("Monthly_Income", 40, "page"),
        "cust_balance_hist": hist("Account_Balance", 40, "page"),
        "cust_income_by_occupation": gmean("Occupation", "Monthly_Income", "page"),
        "cust_tenure_hist": hist("Tenure_Years", 20, "page"),
        "cust_product_counts": counts("Number_of_Products", "Products", "page"),
    }
    lend = {
        "loanpage_status_counts": counts("Loan_Status", "Status", "lend"),
        "loanpage_amount_hist": hist("Loan_Amount", 40, "lend"),
        "loanpage_dti_hist": hist("Debt_to_Income_Ratio", 40, "lend"),
        "loanpage_top_states": """SELECT State, sum(Loan_Amount) AS Loan_Amount,
            sum(Loan_Amount) / 1e7::DOUBLE AS Loan_Cr,
            printf('₹%.1fCr', sum(Loan_Amount) / 1e7::DOUBLE) AS Text
            FROM lend GROUP BY State ORDER BY 2 DESC, 1 LIMIT 10""",
    }
    dash = {
        "loanpage_missed_default": """SELECT Missed_Bucket, count(*) AS Count, avg(Default_Status) AS Default_Rate,
            avg(Default_Status) * 100 AS Default_Rate_Pct FROM dash
            WHERE Loan_Amount > 0 AND Missed_Bucket IS NOT NULL GROUP BY 1""",
        "risk_age_group": cross("Age_Group", "Risk_Label"),
        "risk_age_group_high": cross("Age_Group", "Risk_Label", "(SELECT * FROM dash WHERE Risk_Label = 'High')"),
        "risk_credit_category_counts": cross("Credit_Category", "Risk_Label"),
        "risk_missed_counts": cross("Missed_Bucket", "Risk_Label"),
        "risk_state_credit_heatmap": f"SELECT State, {', '.join(cat_filter(v) for v in CATS)} FROM dash GROUP BY State",
        "segpage_summary": f"""SELECT Segment, count(*) AS Count, avg(Monthly_Income) AS Avg_Income,
            avg(Account_Balance) AS Avg_Balance, avg(Credit_Score) AS Avg_Credit_Score,
            avg(Transaction_Amount) AS Avg_Txn_Amount, avg(Churn_Status) AS Churn_Rate,
            avg({HI}) * 100 AS High_Risk_Pct FROM dash GROUP BY Segment""",
        "segpage_summary_formatted": f"""SELECT Segment, count(*) AS Count, {RUPEE('avg(Monthly_Income)')} AS Avg_Income,
            {RUPEE('avg(Account_Balance)')} AS Avg_Balance, printf('%.0f', avg(Credit_Score)) AS Avg_Credit_Score,
            {RUPEE('avg(Transaction_Amount)')} AS Avg_Txn_Amount, {PCT_TEXT('avg(Churn_Status) * 100')} AS Churn_Rate,
            {PCT_TEXT(f'avg({HI}) * 100')} AS High_Risk_Pct FROM dash GROUP BY Segment""",
        "segpage_segment_risk": cross("Segment", "Risk_Label"),
        "eda_credit_counts": "\nUNION ALL ".join(
            f"SELECT '{v}' AS Credit_Category, nullif(count(*), 0) AS Count FROM dash WHERE Credit_Category = '{v}'"
            for v in CATS),
        "eda_credit_risk_crosstab": """SELECT Credit_Category, count(*) FILTER (WHERE Risk_Label = 'High') AS High,
            count(*) FILTER (WHERE Risk_Label = 'Low') AS Low,
            count(*) FILTER (WHERE Risk_Label = 'Medium') AS Medium FROM dash GROUP BY 1""",
        "insight_riskiest_segment": best("Segment", f"avg({HI}) * 100", "High_Risk_Pct"),
        "insight_top_default_state": best("State", "avg(Default_Status) * 100", "Default_Rate_Pct"),
        "insight_top_account_type": best("Account_Type", "avg(Account_Balance)", "Avg_Balance"),
        "insight_default_by_state": "SELECT State, avg(Default_Status) * 100 AS Default_Rate FROM dash GROUP BY 1",
        "insight_churn_by_segment": "SELECT Segment, avg(Churn_Status) * 100 AS Churn_Rate FROM dash GROUP BY 1",
        **{f"insight_{k}": f"SELECT {a} AS {na}, {b} AS {nb} FROM dash" for k, (na, a, nb, b) in CONTRASTS.items()},
    }
    flat = lambda pos, name, key: (
        f"SELECT {pos} AS position, '{name}' AS insight, NULL::VARCHAR AS subject, "
        f"{CONTRASTS[key][1]} AS value_a, {CONTRASTS[key][3]} AS value_b FROM dash")
    topped = lambda pos, name, key, expr: (
        f"SELECT * FROM (SELECT {pos} AS position, '{name}' AS insight, {key} AS subject, {expr} AS value_a, "
        f"NULL::DOUBLE AS value_b FROM dash GROUP BY {key} ORDER BY value_a DESC, subject LIMIT 1)")
    dash["insights_all"] = "\nUNION ALL ".join([
        topped(1, "Riskiest Segment", "Segment", f"avg({HI}) * 100"),
        topped(2, "Highest Default State", "State", "avg(Default_Status) * 100"),
        flat(3, "Credit Score & Risk", "credit_vs_risk"),
        flat(4, "Debt-to-Income Impact", "dti_vs_risk"),
        flat(5, "Missed Payments", "missed_vs_risk"),
        flat(6, "Products & Churn", "products_vs_churn"),
        topped(7, "Account Type Balances", "Account_Type", "avg(Account_Balance)"),
        flat(8, "Digital Banking & Risk", "digital_vs_risk"),
    ])
    pcts = "printf('%.1f%%', {v})"
    where = lambda p: f"(avg(CASE WHEN {p} THEN 1.0::DOUBLE ELSE 0 END) * 100)"
    rules = "\nUNION ALL ".join([
        rule(1, "risk mitigation", where("Risk_Label = 'High'"), "{v} > 15", pcts),
        rule(2, "retention", "(avg(Churn_Status) * 100)", "{v} > 15", pcts),
        rule(3, "cross-sell", "avg(Number_of_Products)", "{v} < 2.5", "printf('%.2f', {v})"),
        rule(4, "digital adoption", where("Online_Banking_Usage + Mobile_Banking_Usage > 0"), "{v} < 80", pcts),
        rule(5, "debt monitoring", where("Debt_to_Income_Ratio > 0.5"), "{v} > 10", pcts),
        rule(6, "credit health", where("Credit_Score < 600"), "{v} > 15", pcts),
    ])
    recs = over_bank(f"""SELECT position, rule, {rnd('v', 6)} AS metric, metric_text FROM rules WHERE fired
        UNION ALL SELECT 7, 'healthy', NULL, '' WHERE NOT EXISTS (SELECT 1 FROM rules WHERE fired)""",
        f"\nrules AS ({rules})")
    return {
        **_kpis(),
        **{k: over_bank(b) for k, b in bank.items()},
        **{k: over_bank(b, PAGE) for k, b in page.items()},
        **{k: over_bank(b, LOANS) for k, b in lend.items()},
        **{k: over_bank(b, DASH) for k, b in dash.items()},
        "recommendations": recs,
    }
