"""Number and percentage texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grouped(value: Column) -> Column:
    """Whole number with thousands separators, halves to even."""
    return F.format_number(value.cast("decimal(38,6)"), 0)


def money(value: Column) -> Column:
    return F.concat(F.lit("₹"), grouped(value))


def percent(fraction: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f%%", fraction.cast("double") * 100)


def seven_digits(value: Column) -> Column:
    """A money amount to seven significant digits with thousands separators, no trailing zeros."""
    amount = value.cast("decimal(14,2)")
    size = F.abs(amount)
    shown = (
        F.when(size < 100_000, amount)
        .when(size < 1_000_000, F.round(amount, 1))
        .otherwise(F.round(amount, 0))
    )
    text = F.format_number(shown.cast("decimal(16,2)"), 2)
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
