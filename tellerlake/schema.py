"""Column lists and types of the customer table, its four projections and the model inputs."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "Customer_ID"
ORDINAL = "_seq"

# The column order and types of the customer table.
_CLEAN_COLUMNS = """
Customer_ID string, Age double, Gender string, City string, State string,
Occupation string, Account_Type string, Account_Balance double,
Monthly_Income double, Credit_Score double, Tenure_Years bigint,
Number_of_Products bigint, Loan_Status string, Loan_Amount double,
Loan_Tenure bigint, EMI double, Monthly_Expenses double,
Transaction_Count bigint, Transaction_Amount double,
Average_Transaction_Value double, Online_Banking_Usage int,
Mobile_Banking_Usage int, ATM_Usage bigint, Branch_Visits bigint,
Credit_Card_Usage int, Debit_Card_Usage int, Missed_Payments bigint,
Late_Payments bigint, Existing_Loans bigint, Debt_to_Income_Ratio double,
Customer_Satisfaction double, Complaints bigint, Support_Calls bigint,
Last_Transaction_Date date, Churn_Status int, Default_Status int,
Risk_Label string, Days_Since_Transaction int
"""


_TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(),
    "int": T.IntegerType(), "date": T.DateType(),
}


def struct(columns: str) -> T.StructType:
    """``name type, name type`` to a schema, without needing a running session."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


CLEAN_SCHEMA = struct(_CLEAN_COLUMNS)

# A raw file carries every clean column but the derived recency, all as text,
# because a raw value may be anything.
RAW_COLUMNS = [c for c in CLEAN_SCHEMA.names if c != "Days_Since_Transaction"]
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])

# Which columns the cleaning rules treat as what.
MONEY_COLUMNS = [
    "Account_Balance", "Monthly_Income", "Loan_Amount", "EMI",
    "Monthly_Expenses", "Transaction_Amount", "Average_Transaction_Value",
]
NUMERIC_COLUMNS = [
    "Age", "Account_Balance", "Monthly_Income", "Credit_Score", "Tenure_Years",
    "Number_of_Products", "Loan_Amount", "Loan_Tenure", "EMI",
    "Monthly_Expenses", "Transaction_Count", "Transaction_Amount",
    "Average_Transaction_Value", "ATM_Usage", "Branch_Visits",
    "Missed_Payments", "Late_Payments", "Existing_Loans",
    "Customer_Satisfaction", "Complaints", "Support_Calls", "Churn_Status",
    "Default_Status",
]
FLAG_COLUMNS = [
    "Online_Banking_Usage", "Mobile_Banking_Usage", "Credit_Card_Usage",
    "Debit_Card_Usage",
]
IMPUTED_COLUMNS = [
    "Age", "Monthly_Income", "Credit_Score", "Account_Balance", "Loan_Amount",
    "Customer_Satisfaction",
]
TEXT_COLUMNS = [
    "Gender", "State", "City", "Occupation", "Account_Type", "Loan_Status",
    "Risk_Label",
]

# The four relational tables, each a projection of the customer table.
TABLE_COLUMNS = {
    "customers": [
        "Customer_ID", "Age", "Gender", "City", "State", "Occupation",
        "Account_Type", "Account_Balance", "Monthly_Income", "Credit_Score",
        "Tenure_Years", "Number_of_Products", "Monthly_Expenses",
        "Online_Banking_Usage", "Mobile_Banking_Usage", "ATM_Usage",
        "Branch_Visits", "Credit_Card_Usage", "Debit_Card_Usage",
        "Customer_Satisfaction", "Complaints", "Support_Calls",
        "Last_Transaction_Date", "Days_Since_Transaction", "Churn_Status",
        "Default_Status", "Risk_Label",
    ],
    "transactions": [
        "Customer_ID", "Transaction_Count", "Transaction_Amount",
        "Average_Transaction_Value", "ATM_Usage",
    ],
    "loans": [
        "Customer_ID", "Loan_Status", "Loan_Amount", "Loan_Tenure", "EMI",
        "Missed_Payments", "Late_Payments", "Existing_Loans",
        "Debt_to_Income_Ratio", "Default_Status",
    ],
    "risk_analysis": [
        "Customer_ID", "Credit_Score", "Debt_to_Income_Ratio",
        "Missed_Payments", "Late_Payments", "Default_Status", "Churn_Status",
        "Risk_Label", "Complaints",
    ],
}

# Model inputs in vector order; the last three are category codes.
FEATURE_COLUMNS = [
    "Age", "Monthly_Income", "Credit_Score", "Account_Balance", "Tenure_Years",
    "Number_of_Products", "Loan_Amount", "EMI", "Monthly_Expenses",
    "Transaction_Count", "Transaction_Amount", "Average_Transaction_Value",
    "Missed_Payments", "Late_Payments", "Existing_Loans",
    "Debt_to_Income_Ratio", "Complaints", "Support_Calls", "ATM_Usage",
    "Branch_Visits", "Online_Banking_Usage", "Mobile_Banking_Usage",
    "Credit_Card_Usage", "Debit_Card_Usage", "Customer_Satisfaction",
    "Days_Since_Transaction", "Gender_enc", "Occupation_enc",
    "Account_Type_enc",
]
# The columns coded by category.
ENCODED_COLUMNS = ["Gender", "Occupation", "Account_Type"]

# The columns of the correlation matrix.
CORRELATED_COLUMNS = [
    "Age", "Monthly_Income", "Credit_Score", "Account_Balance", "Loan_Amount",
    "Debt_to_Income_Ratio", "Missed_Payments", "Transaction_Amount",
    "Customer_Satisfaction", "Complaints",
]

# Risk classes and credit categories, from low to high.
RISK_LABELS = ["Low", "Medium", "High"]
CREDIT_CATEGORIES = ["Very Poor", "Poor", "Fair", "Good", "Excellent"]


def require(df, columns) -> None:
    """Fail before any job starts when ``df`` lacks one of ``columns``."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
