"""Numbers written as text, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\f\v\u00a0"


def bare(text: Column) -> Column:
    """A text without outer blanks of any kind."""
    return F.btrim(text, F.lit(BLANKS))


DECIMAL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def finite_number(text: Column) -> Column:
    """The finite decimal number that a text spells (sign, exponent and outer blanks allowed), else null."""
    number = F.when(text.rlike(DECIMAL), bare(text).try_cast("double"))
    return F.when(F.abs(number) < F.lit(float("inf")), number + F.lit(0.0))


def twelve_digits(value: Column) -> Column:
    """A text that is equal for doubles equal at twelve significant digits; null for null and NaN."""
    return F.when(
        value.isNotNull() & ~F.isnan(value), F.format_string("%.11e", F.when(value == 0, F.lit(0.0)).otherwise(value))
    )
