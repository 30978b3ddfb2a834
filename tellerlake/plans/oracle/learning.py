"""Check statements for sources, sinks, features, evaluation and scoring inputs."""

from __future__ import annotations

from ...schema import CLEAN_SCHEMA, ENCODED_COLUMNS, FEATURE_COLUMNS, TABLE_COLUMNS
from .base import over_bank, over_raw, over_tables, rnd
from .cleaning import CLEAN
from .derived import INDICATOR_LIST

CODES = ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS DOUBLE) AS {c}_enc" for c in ENCODED_COLUMNS)
TARGET = "CASE Risk_Label WHEN 'Low' THEN 0 WHEN 'High' THEN 2 ELSE 1 END"
SPLIT = f"""
lab AS (SELECT Customer_ID, {TARGET} AS label FROM bank),
spl AS (SELECT Customer_ID, label, row_number() OVER (PARTITION BY label
    ORDER BY md5('42|' || Customer_ID), Customer_ID)
    <= round(0.2::DOUBLE * count(*) OVER (PARTITION BY label)) AS is_test FROM lab)"""
CHANCE = """(2 + 25 * (Credit_Score < 550)::INT + 15 * (Debt_to_Income_Ratio > 0.5)::INT
  + 12 * (Missed_Payments > 3)::INT + 8 * (Loan_Status = 'Npa')::INT + 5 * (Monthly_Income < 20000)::INT)"""
EVAL = f"""
ev AS (SELECT {TARGET} AS label, CAST({CHANCE} AS DOUBLE) AS ch FROM bank),
evp AS (SELECT label, CASE WHEN ch >= 25 THEN 2 WHEN ch >= 10 THEN 1 ELSE 0 END AS prediction FROM ev),
long AS (SELECT 0 AS class, 100 - ch AS score, label = 0 AS hit FROM ev
  UNION ALL SELECT 1, 50 - abs(ch - 14), label = 1 FROM ev
  UNION ALL SELECT 2, ch, label = 2 FROM ev),
tal AS (SELECT class, score, count(*) FILTER (WHERE hit) AS pos, count(*) FILTER (WHERE NOT hit) AS neg
  FROM long GROUP BY ALL),
pts AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, lead(pos) OVER w AS pos2, lead(neg) OVER w AS neg2,
  row_number() OVER w AS rn FROM tal WINDOW w AS (PARTITION BY class ORDER BY score DESC)),
area AS (SELECT class, sum(pos)::DOUBLE AS P, sum(neg)::DOUBLE AS N,
  sum(neg * (tp - pos / 2.0::DOUBLE))::DOUBLE / (sum(pos)::DOUBLE * sum(neg)::DOUBLE) AS auc FROM pts GROUP BY class)"""


def _weighted() -> str:
    parts = "\nUNION ALL ".join(
        f"""SELECT count(*) FILTER (WHERE label = {c})::DOUBLE AS r, count(*) FILTER (WHERE prediction = {c})::DOUBLE AS s,
        count(*) FILTER (WHERE label = {c} AND prediction = {c})::DOUBLE AS h FROM evp""" for c in range(3))
    return f"""SELECT {rnd('sum(r * coalesce(2 * h / nullif(s + r, 0), 0)) / sum(r)', 4)} AS F1_Weighted,
        {rnd('sum(r * coalesce(h / nullif(s, 0), 0)) / sum(r)', 4)} AS Precision,
        {rnd('sum(h) / sum(r)', 4)} AS Recall FROM ({parts})"""


def statements() -> dict[str, str]:
    clean = ", ".join(CLEAN_SCHEMA.names)
    wide = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FEATURE_COLUMNS)
    matrix = "\nUNION ALL ".join(
        f"SELECT '{name}' AS Actual, count(*) FILTER (WHERE prediction = 0) AS Low, "
        f"count(*) FILTER (WHERE prediction = 1) AS Medium, count(*) FILTER (WHERE prediction = 2) AS High "
        f"FROM evp WHERE label = {i}" for i, name in enumerate(("Low", "Medium", "High")))
    out = {
        "scan_customers_csv": over_bank(f"SELECT {clean} FROM bank"),
        "write_clean": over_raw(f"SELECT {clean} FROM clean", CLEAN),
        "scan_tables": over_tables("""SELECT c.Customer_ID, c.State, t.Transaction_Count, l.Loan_Status,
            r.Risk_Label FROM customers c JOIN transactions t ON t.Customer_ID = c.Customer_ID
            JOIN loans l ON l.Customer_ID = c.Customer_ID
            JOIN risk_analysis r ON r.Customer_ID = c.Customer_ID"""),
        **{f"tbl_{name}": over_tables(f"SELECT {', '.join(cols)} FROM {name}")
           for name, cols in TABLE_COLUMNS.items()},
        "encode_categories": over_bank(f"SELECT Customer_ID, {CODES} FROM bank"),
        "assemble_features": over_bank(
            f"SELECT Customer_ID, {wide} FROM (SELECT *, {CODES} FROM bank)"),
        "encode_target": over_bank(f"SELECT Customer_ID, {TARGET} AS label FROM bank"),
        "class_counts": over_bank(
            f"SELECT {TARGET} AS label, Risk_Label, count(*) AS Count FROM bank GROUP BY ALL"),
        "stratified_split": over_bank("SELECT * FROM spl", SPLIT),
        "class_weights": over_bank("""SELECT label, n AS Count,
            sum(n) OVER ()::DOUBLE / (count(*) OVER () * n) AS Weight
            FROM (SELECT label, count(*) AS n FROM spl WHERE NOT is_test GROUP BY label)""", SPLIT),
        "eval_auc_ovr_weighted": over_bank(
            "SELECT round(sum(auc * P) / sum(P), 9) AS ROC_AUC FROM area", EVAL),
        "eval_weighted_f1_precision_recall": over_bank(_weighted(), EVAL),
        "eval_confusion_matrix": over_bank(matrix, EVAL),
        "eval_roc_curve": over_bank("""SELECT class, fp / N AS fpr, tp / P AS tpr, score AS threshold,
            round(auc, 9) AS AUC FROM pts JOIN area USING (class)
            WHERE rn = 1 OR pos2 IS NULL OR pos <> pos2 OR neg <> neg2
            UNION ALL SELECT class, 0, 0, 'inf'::DOUBLE, round(auc, 9) FROM area""", EVAL),
        "applicant_inputs": over_bank("""SELECT Customer_ID, Age, Monthly_Income, Credit_Score, Account_Balance,
            Tenure_Years, Loan_Amount, EMI, Monthly_Expenses, Missed_Payments, Late_Payments, Transaction_Count,
            Transaction_Amount, Number_of_Products, Complaints, Customer_Satisfaction, Existing_Loans,
            Online_Banking_Usage, Mobile_Banking_Usage, ATM_Usage, Branch_Visits, Gender, Occupation, Account_Type,
            CAST(floor(Transaction_Amount / greatest(Transaction_Count, 1)) AS BIGINT) AS Average_Transaction_Value,
            CASE WHEN EMI > 0 THEN """ + rnd("EMI / greatest(Monthly_Income, 1.0::DOUBLE)", 3) + """
            ELSE 0.0::DOUBLE END AS Debt_to_Income_Ratio, Complaints + 1 AS Support_Calls,
            1 AS Credit_Card_Usage, 1 AS Debit_Card_Usage, 7 AS Days_Since_Transaction FROM bank"""),
        "score_explanations": over_bank(f"""SELECT Customer_ID, Indicator,
            CASE Indicator WHEN 'LOW_CREDIT_SCORE' THEN printf('Credit score %.0f is under 600.', Credit_Score)
              WHEN 'HIGH_DTI' THEN printf('Debt-to-income ratio %.2f is over 0.4.', Debt_to_Income_Ratio)
              WHEN 'MISSED_PAYMENTS' THEN printf('%d payments were missed.', Missed_Payments)
              WHEN 'HIGH_LOAN_BURDEN' THEN printf('The loan is %.0f times the monthly income.', Loan_Amount / Monthly_Income)
              WHEN 'MANY_LOANS' THEN printf('There are %d loans already.', Existing_Loans)
              ELSE 'No major risk indicator found.' END AS Text
            FROM (SELECT *, unnest(CASE WHEN len(hits) = 0 THEN ['NO_INDICATOR'] ELSE hits END) AS Indicator
              FROM (SELECT *, {INDICATOR_LIST} AS hits FROM bank))"""),
    }
    return out
