"""Rates, changes, half-even rounding and the texts made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_where(condition: Column, value: Column) -> Column:
    """Sum of ``value`` where the condition holds; rows where it is unknown are left out."""
    return F.sum(F.when(condition, value).when(~condition, F.lit(0)))


def strict_sum(value: Column) -> Column:
    """Sum that is missing as soon as one input is missing."""
    return F.when(F.count(F.when(value.isNull(), F.lit(1))) == 0, F.sum(value))


def ratio(a: Column, b: Column) -> Column:
    """a / b, missing where b is zero."""
    return F.try_divide(a, b)


def change_fraction(base: Column, horizon: Column) -> Column:
    return F.try_divide(horizon - base, base)


def change_percent(base: Column, horizon: Column, digits: int | None = 1) -> Column:
    pct = F.try_divide((horizon - base) * 100, base)
    return pct if digits is None else round_even(pct, digits)


def share_percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return round_even(F.try_divide(part * 100, whole), digits)


def round_even(value: Column, digits: int = 0) -> Column:
    """Round half to even, also for negative digits."""
    return F.bround(value.cast("double"), digits)


def millions(value: Column) -> Column:
    """Nearest 100,000, in millions."""
    return round_even(value, -5) / F.lit(1e6)


def thousands_text(value: Column) -> Column:
    """Nearest thousand with separators: 1234567 -> ``1,235,000``."""
    return F.format_number(round_even(value, -3), 0)


def number_text(value: Column) -> Column:
    """Shortest text of a rounded number: 12.0 -> ``12``."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def percent_text(fraction: Column, digits: int = 1) -> Column:
    return F.concat(number_text(round_even(fraction * 100, digits)), F.lit("%"))


def signed_percent_text(fraction: Column, digits: int = 1) -> Column:
    text = percent_text(fraction, digits)
    return F.when(fraction > 0, F.concat(F.lit("+"), text)).otherwise(text)


def direction(value: Column) -> Column:
    return (
        F.when(value > 0, F.lit("above")).when(value < 0, F.lit("below")).when(value == 0, F.lit("level"))
    )


def axis_unit(largest: Column) -> Column:
    return F.when(largest < 1e6, F.lit("k")).otherwise(F.lit("m"))


def axis_scale(largest: Column) -> Column:
    return F.when(largest < 1e6, F.lit(1e-3)).otherwise(F.lit(1e-6))


def bar_width(value: Column, largest: Column) -> Column:
    """Length of a table bar, 80 at the largest value."""
    return F.try_divide(value * 80, largest)
