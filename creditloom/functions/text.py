"""Number formatting for reports. Ties round half to even on the exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, digits: int) -> Column:
    pattern = "0" if digits == 0 else "0." + "0" * digits
    return F.call_function("format_number", x, F.lit(pattern))


def signed(x: Column, digits: int) -> Column:
    """With an explicit plus for values above zero."""
    return F.concat(F.when(x > 0, "+").otherwise(""), fixed(x, digits))


def grouped(x: Column, digits: int = 0) -> Column:
    return F.format_number(x, digits)


def money(x: Column) -> Column:
    return F.concat(F.lit("$"), grouped(x))


def percent(share: Column, digits: int = 1) -> Column:
    return F.concat(fixed(share * 100.0, digits), F.lit("%"))


def times(x: Column, digits: int = 1) -> Column:
    return F.concat(fixed(x, digits), F.lit("x"))


def years_of_days(days: Column) -> Column:
    return F.concat(fixed(F.abs(days) / 365.0, 1), F.lit(" years"))
