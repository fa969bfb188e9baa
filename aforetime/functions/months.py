"""Calendar months in any spelling as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aforetime.functions.numbers import bare

# The first three letters of month names, English and German.
MONTH_STARTS = {
    "jan": 1, "feb": 2, "mar": 3, "mär": 3, "mrz": 3, "apr": 4, "may": 5, "mai": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "dez": 12,
}

_PLAIN = r"^[0-9]{4}-(0[1-9]|1[0-2])$"
_YEAR_FIRST = r"^(?:month[-_ ])?([0-9]{4})[-/._ ]?([0-9]{1,2})(?:[-/._ ]?[0-9]{1,2}(?:[t ].*)?)?$"
_MONTH_FIRST = r"^([0-9]{1,2})[-/._ ]([0-9]{4})$"
_NAMED = r"^(\p{L}{3})\p{L}*\.?[-/._ ,]*([0-9]{4})$"
_NAMED_LAST = r"^([0-9]{4})[-/._ ]*(\p{L}{3})\p{L}*\.?$"


def month_index(text: Column) -> Column:
    """Months since year 0 (12·year + month − 1) of a month written in any spelling; null if it is none.

    Read are year–month (with or without separator, leading zero, day or the
    word month before it), month–year and month names in English or German
    with the year on either side.
    """
    t = F.lower(bare(text))
    names = F.create_map(*[F.lit(x) for pair in MONTH_STARTS.items() for x in pair])

    def number(pattern: str, group: int) -> Column:
        return F.regexp_extract(t, pattern, group).try_cast("int")

    def from_parts(year: Column, month: Column) -> Column:
        return F.when(month.between(1, 12), year * 12 + month - 1)

    return F.coalesce(
        F.when(text.rlike(_PLAIN), F.substring(text, 1, 4).cast("int") * 12 + F.substring(text, 6, 2).cast("int") - 1),
        from_parts(number(_YEAR_FIRST, 1), number(_YEAR_FIRST, 2)),
        from_parts(number(_MONTH_FIRST, 2), number(_MONTH_FIRST, 1)),
        from_parts(number(_NAMED, 2), names[F.regexp_extract(t, _NAMED, 1)]),
        from_parts(number(_NAMED_LAST, 1), names[F.regexp_extract(t, _NAMED_LAST, 2)]),
    )


def month_text(index: Column) -> Column:
    """YYYY-MM of a month index."""
    return F.concat(
        F.lpad(F.floor(index / 12).cast("string"), 4, "0"), F.lit("-"), F.lpad((index % 12 + 1).cast("string"), 2, "0")
    )


def clean_month(text: Column) -> Column:
    """YYYY-MM of a month in any spelling, null if it is none."""
    return F.when(text.rlike(_PLAIN), text).otherwise(month_text(month_index(text)))
