"""Null, ratio and distinct-count rules that every operator shares."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that count as "no value" in text columns.
MISSING_TOKENS = ("", "NA", "null", "NaN")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_missing(value: Column | str) -> Column:
    value = _col(value)
    return value.isNull() | value.cast("string").isin(*MISSING_TOKENS)


def nz_sum(value: Column | str) -> Column:
    """A sum that is 0, not NULL, when there is nothing to add."""
    return F.coalesce(F.sum(_col(value)), F.lit(0))


def n_distinct(value: Column | str) -> Column:
    """A distinct count in which NULL is one more value."""
    value = _col(value)
    has_null = F.coalesce(F.max(F.when(value.isNull(), 1)), F.lit(0))
    return F.count_distinct(value) + has_null


def mean_of(value: Column | str) -> Column:
    """Mean of a money or integer column: exact sum first, one division last."""
    value = _col(value)
    return F.try_divide(F.sum(value).cast("double"), F.count(value).cast("double"))


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """numerator / denominator as a double, 0 unless the denominator is positive."""
    top, bottom = _col(numerator).cast("double"), _col(denominator).cast("double")
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def growth_pct(current: Column | str, previous: Column | str) -> Column:
    """Percentage change, 0 when the previous value is NULL or 0."""
    now, before = _col(current).cast("double"), _col(previous).cast("double")
    return F.when(before.isNull() | (before == 0), F.lit(0.0)).otherwise(
        F.try_divide(now - before, before) * 100
    )


def min_max(value: Column | str, low: Column | str, high: Column | str) -> Column:
    """Scale to 0..1; a column with a single value becomes 0."""
    value, low, high = (_col(c).cast("double") for c in (value, low, high))
    return F.when(high == low, F.lit(0.0)).otherwise(F.try_divide(value - low, high - low))


def clamp_at_zero(value: Column | str) -> Column:
    value = _col(value)
    return F.when(value < 0, F.lit(0.0)).otherwise(value)


def distance_to(columns: Sequence[str], center: Sequence[float]) -> Column:
    """Squared distance of the columns from a point."""
    parts = [(F.col(c) - F.lit(float(x))) * (F.col(c) - F.lit(float(x))) for c, x in zip(columns, center)]
    return reduce(add, parts)


def nearest(columns: Sequence[str], centers: Sequence[Sequence[float]]) -> Column:
    """Number (from 0) of the nearest center, the first of equal ones; centers are few."""
    return F.array_min(
        F.array(*[F.struct(distance_to(columns, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centers)])
    )["i"]


def only_row(df: DataFrame) -> Column:
    """The one row of ``df`` as a struct: a scalar subquery, not a join."""
    return df.select(F.struct(*df.columns)).scalar()


# Month names, three letters each.
MONTH_NAMES = "JanFebMarAprMayJunJulAugSepOctNovDec"


def month_name(month: Column) -> Column:
    """Short name of a month number (a substring is much cheaper than formatting the date)."""
    return F.substring(F.lit(MONTH_NAMES), month * 3 - 2, F.lit(3))


def desc(*names: str) -> list[Column]:
    return [F.desc_nulls_last(n) for n in names]


def asc(*names: str) -> list[Column]:
    return [F.asc_nulls_last(n) for n in names]
