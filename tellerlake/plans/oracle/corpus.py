"""Check statements for the analyses over the four relational tables."""

from __future__ import annotations

from .base import big, over_tables, pct, rnd

HIGH = "count(*) FILTER (WHERE Risk_Label = 'High')"

# Limits and names of segments and buckets.
PREMIUM, HIGH_VALUE = (500_000, 750, 3), (200_000, 650)
DIGITAL_AMOUNT, LOW_AMOUNT, LOW_VISITS, LOW_COUNT = 100_000, 20_000, 1, 5
LOAN_RATIO, IDLE_DAYS = 0.35, 90
CREDIT_LIMITS = [("Credit_Score < 500", "Very Poor (<500)"), ("Credit_Score < 600", "Poor (500-599)"),
                 ("Credit_Score < 700", "Fair (600-699)"), ("Credit_Score < 750", "Good (700-749)")]
MISSED_LIMITS = [("Missed_Payments = 0", "0"), ("Missed_Payments <= 2", "1-2"), ("Missed_Payments <= 5", "3-5")]
ATM_LIMITS = [("ATM_Usage = 0", "0"), ("ATM_Usage <= 3", "1-3"), ("ATM_Usage <= 6", "4-6"), ("ATM_Usage <= 10", "7-10")]


def first_of(rules: list[tuple[str, str]], other: str) -> str:
    whens = " ".join(f"WHEN {test} THEN '{name}'" for test, name in rules)
    return f"CASE {whens} ELSE '{other}' END"


def segment(digital: str, at_risk: str, low: str) -> str:
    return first_of([
        ("Account_Balance >= {} AND Credit_Score >= {} AND Number_of_Products >= {}".format(*PREMIUM), "Premium"),
        ("Account_Balance >= {} AND Credit_Score >= {}".format(*HIGH_VALUE), "High Value"),
        (digital, "Digital First"),
        (f"Loan_Amount > 0 AND Debt_to_Income_Ratio > {LOAN_RATIO}", "Loan Dependent"),
        (at_risk, "At Risk"), (low, "Low Engagement")], "Regular")


BOTH = "Online_Banking_Usage + Mobile_Banking_Usage = 2"
CHURNED = "Churn_Status = 1"
IDLE = f"{CHURNED} OR Days_Since_Transaction > {IDLE_DAYS}"
SEG_DETAIL = segment(f"Transaction_Amount >= {DIGITAL_AMOUNT} AND Online_Banking_Usage = 1", IDLE,
                     f"Transaction_Amount < {LOW_AMOUNT} AND Branch_Visits <= {LOW_VISITS}")
SEG_SUMMARY = segment(BOTH, IDLE, f"Transaction_Count < {LOW_COUNT}")
SEG_APP = segment(BOTH, CHURNED, f"Transaction_Count < {LOW_COUNT}")

AGE_BETWEEN = """CASE WHEN Age >= 18 AND Age <= 25 THEN '18-25' WHEN Age >= 26 AND Age <= 35 THEN '26-35'
  WHEN Age >= 36 AND Age <= 45 THEN '36-45' WHEN Age >= 46 AND Age <= 55 THEN '46-55' ELSE '56+' END"""

ALL3 = """customers JOIN (SELECT Customer_ID, Loan_Amount, Debt_to_Income_Ratio FROM loans) USING (Customer_ID)
  JOIN (SELECT Customer_ID, Transaction_Count, Transaction_Amount FROM transactions) USING (Customer_ID)"""


def one(alias: str, expr: str, table: str = "customers") -> str:
    return f"SELECT {expr} AS {alias} FROM {table}"


def high_by(key: str, alias: str, table: str = "risk_analysis") -> str:
    return (f"SELECT {key} AS {alias}, count(*) AS Total, {HIGH} AS High_Risk, "
            f"{pct(HIGH, 'count(*)')} AS High_Risk_Pct FROM {table} GROUP BY 1")


def statements() -> dict[str, str]:
    bodies = {
        "kpi_total_customers": one("Total_Customers", "count(*)"),
        "kpi_avg_balance": one("Avg_Account_Balance", rnd("avg(Account_Balance)", 2)),
        "kpi_avg_income": one("Avg_Monthly_Income", rnd("avg(Monthly_Income)", 2)),
        "kpi_total_deposits_crore": one("Total_Deposits_Crore", rnd("sum(Account_Balance) / 1e7", 2)),
        "kpi_default_rate": one("Default_Rate_Pct", rnd("avg(Default_Status) * 100", 2)),
        "kpi_churn_rate": one("Churn_Rate_Pct", rnd("avg(Churn_Status) * 100", 2)),
        "kpi_avg_products": one("Avg_Products", rnd("avg(Number_of_Products)", 2)),
        "kpi_avg_credit_score": one("Avg_Credit_Score", rnd("avg(Credit_Score)", 1)),
        "kpi_complaint_rate": one(
            "Complaint_Rate_Pct", pct("count(*) FILTER (WHERE Complaints > 0)", "count(*)")),
        "kpi_risk_distribution": f"""SELECT Risk_Label, count(*) AS Count,
            {pct('count(*)', '(SELECT count(*) FROM customers)')} AS Pct FROM customers GROUP BY Risk_Label""",
        "kpi_active_inactive": """SELECT count(*) FILTER (WHERE Churn_Status = 0) AS Active_Customers,
            count(*) FILTER (WHERE Churn_Status = 1) AS Inactive_Customers FROM customers""",
        "kpi_by_account_type": f"""SELECT Account_Type, count(*) AS Total,
            {rnd('avg(Account_Balance)', 2)} AS Avg_Balance FROM customers GROUP BY 1""",
        "kpi_by_age_group": f"""SELECT {AGE_BETWEEN} AS Age_Group, count(*) AS Count,
            {rnd('avg(Monthly_Income)', 2)} AS Avg_Income FROM customers GROUP BY 1""",
        "kpi_top10_balance": """SELECT Customer_ID, Age, Occupation, Account_Balance, Credit_Score, Risk_Label
            FROM customers ORDER BY Account_Balance DESC, Customer_ID LIMIT 10""",
        "kpi_tenure_by_account_type": f"""SELECT Account_Type,
            {rnd('avg(Tenure_Years)', 1)} AS Avg_Tenure_Years FROM customers GROUP BY 1""",
        "seg_customer_detail": f"""SELECT Customer_ID, Account_Balance, Monthly_Income, Credit_Score,
            Number_of_Products, Transaction_Amount, Online_Banking_Usage, Mobile_Banking_Usage,
            Churn_Status, Risk_Label, {SEG_DETAIL} AS Customer_Segment FROM {ALL3}""",
        "seg_summary": f"""SELECT {SEG_SUMMARY} AS Segment, count(*) AS Count,
            {rnd('avg(Monthly_Income)', 0)} AS Avg_Income, {rnd('avg(Account_Balance)', 0)} AS Avg_Balance,
            {rnd('avg(Credit_Score)', 1)} AS Avg_Credit_Score,
            {rnd('avg(Churn_Status) * 100', 2)} AS Churn_Rate_Pct FROM {ALL3} GROUP BY 1""",
        "geo_customers_by_state": f"""SELECT State, count(*) AS Total_Customers,
            {rnd('avg(Monthly_Income)', 0)} AS Avg_Income, {rnd('avg(Account_Balance)', 0)} AS Avg_Balance,
            {rnd('avg(Credit_Score)', 1)} AS Avg_Credit_Score,
            {pct('sum(Churn_Status)', 'count(*)')} AS Churn_Rate_Pct,
            {pct('sum(Default_Status)', 'count(*)')} AS Default_Rate_Pct FROM customers GROUP BY State""",
        "geo_risk_by_state": f"""SELECT State, count(*) AS Total, {HIGH} AS High_Risk,
            count(*) FILTER (WHERE Risk_Label = 'Medium') AS Medium_Risk,
            count(*) FILTER (WHERE Risk_Label = 'Low') AS Low_Risk,
            {pct(HIGH, 'count(*)')} AS High_Risk_Pct FROM customers GROUP BY State""",
        "geo_top_cities": f"""SELECT City, State, count(*) AS Customers,
            {rnd('avg(Account_Balance)', 0)} AS Avg_Balance, {rnd('avg(Monthly_Income)', 0)} AS Avg_Income
            FROM customers GROUP BY City, State HAVING count(*) >= 50
            ORDER BY Avg_Balance DESC, City, State LIMIT 15""",
        "geo_loan_performance": f"""SELECT State, count(*) AS Loan_Customers,
            {rnd('sum(Loan_Amount) / 1e7', 2)} AS Total_Loans_Crore,
            {pct('sum(l.Default_Status)', 'count(*)')} AS Default_Rate_Pct
            FROM loans l JOIN customers c USING (Customer_ID) WHERE Loan_Amount > 0 GROUP BY State""",
        "geo_income_rank": f"""SELECT State, Avg_Income, rank() OVER (ORDER BY Avg_Income DESC) AS Income_Rank
            FROM (SELECT State, {rnd('avg(Monthly_Income)', 0)} AS Avg_Income FROM customers GROUP BY State)""",
        "loan_totals": f"""SELECT count(*) AS Total_Loan_Customers,
            {rnd('sum(Loan_Amount) / 1e7', 2)} AS Total_Loan_Crore,
            {rnd('avg(Loan_Amount)', 0)} AS Avg_Loan_Amount,
            {rnd('avg(Debt_to_Income_Ratio)', 3)} AS Avg_DTI FROM loans WHERE Loan_Amount > 0""",
        "loan_status_breakdown": f"""SELECT Loan_Status, count(*) AS Count,
            {rnd('sum(Loan_Amount) / 1e7', 2)} AS Total_Crore, {rnd('avg(Loan_Amount)', 0)} AS Avg_Amount
            FROM loans GROUP BY Loan_Status""",
        "loan_default_analysis": f"""SELECT Default_Status, count(*) AS Count,
            {rnd('avg(Loan_Amount)', 0)} AS Avg_Loan, {rnd('avg(Missed_Payments)', 2)} AS Avg_Missed_Payments,
            {rnd('avg(Debt_to_Income_Ratio)', 3)} AS Avg_DTI FROM loans GROUP BY Default_Status""",
        "loan_by_state": f"""SELECT State, count(*) AS Loan_Customers,
            {rnd('sum(Loan_Amount) / 1e7', 2)} AS Total_Loans_Crore, {rnd('avg(Loan_Amount)', 0)} AS Avg_Loan,
            {pct('sum(l.Default_Status)', 'count(*)')} AS Default_Rate_Pct
            FROM loans l JOIN customers c USING (Customer_ID) WHERE Loan_Amount > 0 GROUP BY State""",
        "loan_missed_distribution": f"""SELECT {first_of(MISSED_LIMITS, '6+')}
            AS Missed_Bucket, count(*) AS Count, {pct('sum(Default_Status)', 'count(*)')} AS Default_Rate
            FROM loans GROUP BY 1""",
        "loan_high_dti": """SELECT Customer_ID, Monthly_Income, Loan_Amount, EMI, Debt_to_Income_Ratio,
            Missed_Payments, Risk_Label FROM loans JOIN customers USING (Customer_ID)
            WHERE Loan_Amount > 0 AND Debt_to_Income_Ratio > 0.5
            ORDER BY Debt_to_Income_Ratio DESC, Customer_ID LIMIT 20""",
        "loan_tenure_analysis": f"""SELECT Loan_Tenure, count(*) AS Count,
            {rnd('avg(Loan_Amount)', 0)} AS Avg_Amount, {rnd('avg(EMI)', 0)} AS Avg_EMI
            FROM loans WHERE Loan_Tenure > 0 GROUP BY 1""",
        "risk_distribution": f"""SELECT Risk_Label, count(*) AS Count,
            {pct('count(*)', '(SELECT count(*) FROM risk_analysis)')} AS Pct FROM risk_analysis GROUP BY 1""",
        "risk_high_customers": """SELECT r.Customer_ID, Age, Monthly_Income, c.Credit_Score, Missed_Payments,
            Debt_to_Income_Ratio, r.Default_Status, r.Risk_Label
            FROM risk_analysis r JOIN customers c ON c.Customer_ID = r.Customer_ID
            WHERE r.Risk_Label = 'High' ORDER BY Missed_Payments DESC, r.Customer_ID LIMIT 20""",
        "risk_by_credit_category": high_by(first_of(CREDIT_LIMITS, "Excellent (750+)"), "Credit_Category"),
        "risk_by_missed_bucket": high_by(first_of(
            [(test, f"{name} Missed") for test, name in MISSED_LIMITS], "6+ Missed"), "Missed_Bucket"),
        "risk_high_dti": """SELECT r.Customer_ID, Monthly_Income, Debt_to_Income_Ratio, Missed_Payments,
            r.Risk_Label FROM risk_analysis r JOIN customers c ON c.Customer_ID = r.Customer_ID
            WHERE Debt_to_Income_Ratio > 0.5 ORDER BY Debt_to_Income_Ratio DESC, r.Customer_ID LIMIT 20""",
        "risk_by_state": high_by("State", "State", """(SELECT r.Risk_Label, c.State FROM risk_analysis r
            JOIN customers c ON c.Customer_ID = r.Customer_ID)"""),
        "risk_default_correlation": f"""SELECT Risk_Label, count(*) AS Total,
            {big('sum(Default_Status)')} AS Defaults, {pct('sum(Default_Status)', 'count(*)')} AS Default_Rate_Pct
            FROM risk_analysis GROUP BY 1""",
        "txn_totals": f"""SELECT {big('sum(Transaction_Count)')} AS Total_Transactions,
            {rnd('sum(Transaction_Amount) / 1e7', 2)} AS Total_Transaction_Crore,
            {rnd('avg(Average_Transaction_Value)', 2)} AS Avg_Txn_Value FROM transactions""",
        "txn_top10": """SELECT Customer_ID, Transaction_Count, Transaction_Amount, Average_Transaction_Value,
            Occupation, State FROM transactions JOIN customers USING (Customer_ID)
            ORDER BY Transaction_Amount DESC, Customer_ID LIMIT 10""",
        "txn_digital_adoption": f"""SELECT {big('sum(Online_Banking_Usage)')} AS Online_Users,
            {big('sum(Mobile_Banking_Usage)')} AS Mobile_Users,
            count(*) FILTER (WHERE Online_Banking_Usage + Mobile_Banking_Usage = 2) AS Both_Digital,
            count(*) AS Total, {pct('sum(Online_Banking_Usage)', 'count(*)')} AS Online_Pct,
            {pct('sum(Mobile_Banking_Usage)', 'count(*)')} AS Mobile_Pct FROM customers""",
        "txn_atm_distribution": f"""SELECT {first_of(ATM_LIMITS, '10+')} AS ATM_Bucket,
            count(*) AS Count FROM customers GROUP BY 1""",
        "txn_by_occupation": f"""SELECT Occupation, count(*) AS Customers,
            {rnd('avg(Transaction_Amount)', 0)} AS Avg_Txn_Amount, {rnd('avg(Transaction_Count)', 1)} AS Avg_Txn_Count
            FROM transactions JOIN customers USING (Customer_ID) GROUP BY 1""",
        "txn_by_risk": f"""SELECT Risk_Label, {rnd('avg(Transaction_Amount)', 0)} AS Avg_Txn_Amount,
            {rnd('avg(Transaction_Count)', 1)} AS Avg_Txn_Count
            FROM transactions JOIN customers USING (Customer_ID) GROUP BY 1""",
    }
    return {key: over_tables(body) for key, body in bodies.items()}
