"""Text clean-up and display formatting, all as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_BLANKS = " \t\n\r\x0b\x0c"


def title_case(name: str) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest.

    ``initcap`` only splits on blanks; here ``self-employed`` becomes ``Self-Employed``.
    A null stays null.
    """
    return F.expr(
        f"array_join(transform(regexp_extract_all(lower(btrim(`{name}`, '{_BLANKS}')), "
        r"r'(\p{L}+|\P{L}+)', 1), run -> initcap(run)), '')")


def parse_number(name: str) -> Column:
    """Text column to double; anything that is not a plain decimal number becomes null."""
    return F.expr(f"if(`{name}` RLIKE r'{_NUMBER}', "
                  f"try_cast(btrim(`{name}`, '{_BLANKS}') AS DOUBLE), NULL)")


# Accepted dates: year-month-day, also with slashes or a clock time behind it, and month/day/year.
_YEAR_FIRST = r"^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?)?$"
_MONTH_FIRST = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$"


def parse_whole(name: str, kind: str) -> Column:
    """:func:`parse_number`, null also where the number does not fit the whole-number ``kind``."""
    number = parse_number(name)
    return F.when(number.try_cast(kind).isNotNull(), number)


def parse_date(name: str) -> Column:
    """Text column to date; text that is not wholly one of the accepted forms becomes null."""
    text = f"btrim(`{name}`, '{_BLANKS}')"
    part = lambda form, order: ", ".join(
        f"regexp_extract({text}, r'{form}', {i})" for i in order)
    return F.expr(
        f"CASE WHEN {text} RLIKE r'{_YEAR_FIRST}' "
        f"THEN try_cast(concat_ws('-', {part(_YEAR_FIRST, (1, 2, 3))}) AS DATE) "
        f"WHEN {text} RLIKE r'{_MONTH_FIRST}' "
        f"THEN try_cast(concat_ws('-', {part(_MONTH_FIRST, (3, 1, 2))}) AS DATE) END")


def fixed(col: Column, digits: int, grouped: bool = False) -> Column:
    """Fixed-point text, ties of the binary value to even; ``format_string`` rounds them up."""
    text = F.format_number(col.cast("double"), digits)
    return text if grouped else F.replace(text, F.lit(","), F.lit(""))


def rupees(col: Column) -> Column:
    return F.concat(F.lit("₹"), fixed(col, 0, grouped=True))


def percent_text(col: Column, digits: int = 1) -> Column:
    return F.concat(fixed(col, digits), F.lit("%"))


def inr_unit(col: Column) -> Column:
    """Which unit :func:`format_inr` picks: ``Cr`` (1e7), ``L`` (1e5) or none."""
    return F.when(col >= 1e7, "Cr").when(col >= 1e5, "L").otherwise("")


def format_inr(col: Column) -> Column:
    """Rupee amount in crore, lakh or plain digits, as on the dashboard cards."""
    value = col.cast("double")

    def scaled(by: float, unit: str) -> Column:
        return F.concat(F.lit("₹"), fixed(value / F.lit(by), 1), F.lit(unit))

    return (F.when(value >= 1e7, scaled(1e7, " Cr")).when(value >= 1e5, scaled(1e5, " L"))
            .otherwise(rupees(value)))
