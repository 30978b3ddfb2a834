"""Check statements for the cleaning rules."""

from __future__ import annotations

from ...schema import (CLEAN_SCHEMA, FLAG_COLUMNS, IMPUTED_COLUMNS, NUMERIC_COLUMNS, RAW_COLUMNS, RISK_LABELS,
                       TEXT_COLUMNS)
from .base import over_raw

_NUM = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def number(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{_NUM}') THEN try_cast(trim({c}) AS DOUBLE) END"


_KINDS = {f.name: f.dataType.simpleString() for f in CLEAN_SCHEMA}


def fitting(c: str) -> str:
    """:func:`number`, null where it does not fit the column's whole-number type."""
    if _KINDS[c] == "double":
        return number(c)
    return f"CASE WHEN try_cast(trunc({number(c)}) AS {_KINDS[c]}) IS NOT NULL THEN {number(c)} END"


def title(c: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all(lower(trim({c})), "
            r"'(\p{L}+|\P{L}+)', 1), lambda p: upper(p[1]) || p[2:]), '')")


NUMBERS = ", ".join(f"{fitting(c)} AS {c}" for c in NUMERIC_COLUMNS)
FLAGS = ", ".join(f"coalesce(try_cast(trunc({number(c)}) AS INT), 0) AS {c}" for c in FLAG_COLUMNS)
DATE = r"""CASE
  WHEN regexp_matches(trim(Last_Transaction_Date), '^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}([.]\d+)?)?)?$')
    THEN try_cast(left(trim(Last_Transaction_Date), 10) AS DATE)
  WHEN regexp_matches(trim(Last_Transaction_Date), '^\d{1,2}/\d{1,2}/\d{4}$')
    THEN CAST(try_strptime(trim(Last_Transaction_Date), '%m/%d/%Y') AS DATE) END"""
TEXTS = ", ".join(f"coalesce({title(c)}, 'Nan') AS {c}" for c in TEXT_COLUMNS)
RAWS = ", ".join(RAW_COLUMNS)

FIRST = """
firsts AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY Customer_ID ORDER BY _seq) = 1)"""
TYPED = FIRST + f""",
typed AS (SELECT * REPLACE ({NUMBERS}, {FLAGS}, {DATE} AS Last_Transaction_Date) FROM firsts)"""
FILLED = TYPED + ",\nmed AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.5) AS m_{c}" for c in IMPUTED_COLUMNS) + """ FROM typed),
filled AS (SELECT typed.* REPLACE (""" + ", ".join(
    f"coalesce({c}, m_{c}) AS {c}" for c in IMPUTED_COLUMNS) + ") FROM typed, med)"
VALID = """Age >= 18 AND Age <= 100 AND Credit_Score >= 300 AND Credit_Score <= 900
  AND Monthly_Income > 0 AND Account_Balance >= 0 AND Transaction_Amount >= 0"""
ZEROS = ", ".join(f"coalesce({c}, 0) AS {c}" for c in NUMERIC_COLUMNS)
DAYS = "CAST(greatest(date_diff('day', {d}, DATE '2024-12-31'), 0) AS INT)"
RATIO = ("CASE WHEN Monthly_Income > 0 THEN least(greatest(round_even(EMI / Monthly_Income * 1000, 0)"
         " / 1000, 0.0::DOUBLE), 2.0::DOUBLE) ELSE 0.0::DOUBLE END")
LABELS = ", ".join(f"'{v}'" for v in RISK_LABELS)
_FINAL_NUM = ", ".join(
    f"coalesce({c}, 0) AS {c}" if _KINDS[c] == "double" else f"CAST(trunc(coalesce({c}, 0)) AS {_KINDS[c]}) AS {c}"
    for c in NUMERIC_COLUMNS)
CLEAN = FILLED + f""",
tidy AS (SELECT * REPLACE ({TEXTS}, coalesce(Last_Transaction_Date, DATE '2024-01-01') AS Last_Transaction_Date,
    coalesce(Customer_Satisfaction, 0) AS Customer_Satisfaction, coalesce(EMI, 0) AS EMI)
  FROM filled WHERE {VALID}),
clean AS (SELECT {RAWS}, {DAYS.format(d='Last_Transaction_Date')} AS Days_Since_Transaction
  FROM (SELECT * REPLACE ({RATIO} AS Debt_to_Income_Ratio, {_FINAL_NUM},
    CASE WHEN Risk_Label IN ({LABELS}) THEN Risk_Label ELSE 'Medium' END AS Risk_Label) FROM tidy))"""


def statements() -> dict[str, str]:
    imputed = ", ".join(IMPUTED_COLUMNS)
    return {
        "clean_dedup": over_raw(f"SELECT _seq, {RAWS} FROM firsts", FIRST),
        "clean_coerce_numeric": over_raw(f"SELECT _seq, Customer_ID, {NUMBERS} FROM raw"),
        "clean_coerce_binary": over_raw(f"SELECT _seq, Customer_ID, {FLAGS} FROM raw"),
        "clean_parse_date": over_raw(
            f"SELECT _seq, Customer_ID, {DATE} AS Last_Transaction_Date FROM raw"),
        "clean_impute_median": over_raw(f"SELECT Customer_ID, {imputed} FROM filled", FILLED),
        "clean_validate_ranges": over_raw(
            f"SELECT Customer_ID, Age, Credit_Score, Monthly_Income, Account_Balance, "
            f"Transaction_Amount FROM typed WHERE {VALID}", TYPED),
        "clean_fill_zero": over_raw(f"SELECT Customer_ID, {ZEROS} FROM typed", TYPED),
        "clean_standardise_text": over_raw(f"SELECT _seq, Customer_ID, {TEXTS} FROM raw"),
        "clean_recency": over_raw(f"""SELECT Customer_ID, d AS Last_Transaction_Date,
            {DAYS.format(d='d')} AS Days_Since_Transaction
            FROM (SELECT *, coalesce(Last_Transaction_Date, DATE '2024-01-01') AS d FROM typed)""", TYPED),
        "clean_recompute_dti": over_raw(
            f"SELECT Customer_ID, {RATIO} AS Debt_to_Income_Ratio FROM typed", TYPED),
        "clean_label_domain": over_raw(f"""SELECT _seq, Customer_ID,
            CASE WHEN Risk_Label IN ({LABELS}) THEN Risk_Label ELSE 'Medium' END AS Risk_Label FROM raw"""),
        "clean_stage_report": over_raw("""SELECT 1 AS step, 'raw' AS stage, count(*) AS rows FROM raw
            UNION ALL SELECT 2, 'dedup', count(*) FROM firsts
            UNION ALL SELECT 3, 'final', count(*) FROM clean""", CLEAN),
        "clean_customers": over_raw("SELECT * FROM clean", CLEAN),
        "profile_null_census": over_raw(f"""SELECT "column", nulls FROM (SELECT {', '.join(
            f'count(*) FILTER (WHERE {c} IS NULL) AS {c}' for c in RAW_COLUMNS)} FROM raw)
            UNPIVOT (nulls FOR "column" IN ({RAWS})) WHERE nulls > 0"""),
    }
