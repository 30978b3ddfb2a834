"""Check statements for derived columns and rule scores, per customer."""

from __future__ import annotations

from .base import over_bank, rnd
from .corpus import AGE_BETWEEN, SEG_APP, SEG_DETAIL, SEG_SUMMARY

CREDIT = """CASE WHEN Credit_Score >= 750 THEN 'Excellent' WHEN Credit_Score >= 700 THEN 'Good'
  WHEN Credit_Score >= 600 THEN 'Fair' WHEN Credit_Score >= 500 THEN 'Poor' ELSE 'Very Poor' END"""
CREDIT_RANGED = """CASE WHEN Credit_Score >= 750 THEN 'Excellent (750+)' WHEN Credit_Score >= 700 THEN 'Good (700-749)'
  WHEN Credit_Score >= 600 THEN 'Fair (600-699)' WHEN Credit_Score >= 500 THEN 'Poor (500-599)'
  ELSE 'Very Poor (<500)' END"""
AGE_UPTO = """CASE WHEN Age > 55 THEN '56+' WHEN Age > 45 THEN '46-55' WHEN Age > 35 THEN '36-45'
  WHEN Age > 25 THEN '26-35' ELSE '18-25' END"""
MISSED_CUT = """CASE WHEN Missed_Payments <= -1 OR Missed_Payments > 100 THEN NULL WHEN Missed_Payments > 5 THEN '6+'
  WHEN Missed_Payments > 2 THEN '3-5' WHEN Missed_Payments > 0 THEN '1-2' WHEN Missed_Payments > -1 THEN '0' END"""
ATM = """CASE WHEN ATM_Usage > 10 THEN '10+' WHEN ATM_Usage > 6 THEN '7-10' WHEN ATM_Usage > 3 THEN '4-6'
  WHEN ATM_Usage <> 0 THEN '1-3' ELSE '0' END"""
POINTS = """(CASE WHEN Credit_Score < 600 THEN 25 ELSE 0 END + CASE WHEN Debt_to_Income_Ratio > 0.4 THEN 20 ELSE 0 END
  + CASE WHEN Missed_Payments > 2 THEN 18 ELSE 0 END + CASE WHEN Default_Status = 1 THEN 30 ELSE 0 END
  + CASE WHEN Loan_Amount > Monthly_Income * 18 THEN 15 ELSE 0 END + CASE WHEN Monthly_Income < 25000 THEN 10 ELSE 0 END
  + CASE WHEN Late_Payments > 2 THEN 12 ELSE 0 END + CASE WHEN Existing_Loans > 2 THEN 8 ELSE 0 END
  + CASE WHEN Complaints > 2 THEN 5 ELSE 0 END)"""
INDICATOR_LIST = """list_filter([CASE WHEN Credit_Score < 600 THEN 'LOW_CREDIT_SCORE' END,
  CASE WHEN Debt_to_Income_Ratio > 0.4 THEN 'HIGH_DTI' END, CASE WHEN Missed_Payments > 2 THEN 'MISSED_PAYMENTS' END,
  CASE WHEN Loan_Amount > Monthly_Income * 18 THEN 'HIGH_LOAN_BURDEN' END,
  CASE WHEN Existing_Loans > 2 THEN 'MANY_LOANS' END], lambda x: x IS NOT NULL)"""


def inr(x: str) -> str:
    return (f"CASE WHEN {x} >= 1e7 THEN printf('₹%.1f Cr', {x} / 1e7::DOUBLE) "
            f"WHEN {x} >= 1e5 THEN printf('₹%.1f L', {x} / 1e5::DOUBLE) "
            f"ELSE '₹' || format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT)) END")


def statements() -> dict[str, str]:
    per = lambda cols: over_bank(f"SELECT Customer_ID, {cols} FROM bank")
    return {
        "derive_credit_category": per(
            f"{CREDIT} AS Credit_Category, {CREDIT_RANGED} AS Credit_Category_Ranged"),
        "derive_age_group": per(f"{AGE_UPTO} AS Age_Group, {AGE_BETWEEN} AS Age_Group_Between"),
        "derive_missed_bucket": per(f"""CASE WHEN Missed_Payments = 0 THEN '0'
            WHEN Missed_Payments IN (1, 2) THEN '1-2' WHEN Missed_Payments IN (3, 4, 5) THEN '3-5'
            ELSE '6+' END AS Missed_Between,
            CASE WHEN Missed_Payments > 5 THEN '6+ Missed' WHEN Missed_Payments > 2 THEN '3-5 Missed'
            WHEN Missed_Payments <> 0 THEN '1-2 Missed' ELSE '0 Missed' END AS Missed_Upto,
            {MISSED_CUT} AS Missed_Cut"""),
        "derive_atm_bucket": per(f"{ATM} AS ATM_Bucket"),
        "segment_sql_detail_rules": per(f"{SEG_DETAIL} AS Segment"),
        "segment_sql_summary_rules": per(f"{SEG_SUMMARY} AS Segment"),
        "segment_app_rules": per(f"{SEG_APP} AS Segment"),
        "format_inr": per(f"""CASE WHEN Loan_Amount >= 10000000 THEN 'Cr' WHEN Loan_Amount >= 100000 THEN 'L'
            ELSE '' END AS unit, {inr('Loan_Amount')} AS loan_text, {inr('Account_Balance')} AS balance_text,
            {inr('Monthly_Income')} AS income_text"""),
        "scale_crore": per(f"{rnd('Loan_Amount / 1e7', 2)} AS Loan_Crore, "
                           f"{rnd('Account_Balance / 1e7', 2)} AS Balance_Crore"),
        "derive_loan_fields": per("""CAST(floor(Loan_Amount / (greatest(Loan_Tenure, 1) * 1.0::DOUBLE)) AS BIGINT)
            AS EMI, CAST(floor(Transaction_Amount / greatest(Transaction_Count, 1)) AS BIGINT) AS Average_Transaction_Value,
            CASE WHEN EMI > 0 THEN """ + rnd("EMI / greatest(Monthly_Income, 1.0::DOUBLE)", 3)
            + " ELSE 0.0::DOUBLE END AS Debt_to_Income_Ratio"),
        "score_risk_rules": per(f"""{POINTS} / 10.0::DOUBLE AS Risk_Score,
            CASE WHEN {POINTS} >= 50 THEN 'High' WHEN {POINTS} >= 20 THEN 'Medium' ELSE 'Low' END AS Rule_Label"""),
        "score_default_probability": per("""least(greatest(2 + 25 * (Credit_Score < 550)::INT
            + 15 * (Debt_to_Income_Ratio > 0.5)::INT + 12 * (Missed_Payments > 3)::INT
            + 8 * (Loan_Status = 'Npa')::INT + 5 * (Monthly_Income < 20000)::INT, 0), 100) / 100.0::DOUBLE
            AS Default_Probability"""),
        "score_churn_probability": per("""(5 + 15 * (Customer_Satisfaction < 2.5)::INT
            + 10 * (Days_Since_Transaction > 60)::INT + 10 * (Complaints > 2)::INT
            + 10 * (Number_of_Products = 1)::INT + 5 * (Tenure_Years < 2)::INT) / 100.0::DOUBLE
            AS Churn_Probability"""),
        "minmax_income_age": over_bank("""SELECT Customer_ID,
            (Monthly_Income - lo) / (hi - lo + 1) AS Income_Norm, (Age - 18) / 57.0::DOUBLE AS Age_Norm
            FROM bank, (SELECT min(Monthly_Income) AS lo, max(Monthly_Income) AS hi FROM bank)"""),
        "risk_indicators": per(f"coalesce(nullif(array_to_string({INDICATOR_LIST}, ','), ''), "
                               "'NO_INDICATOR') AS Indicators"),
    }
