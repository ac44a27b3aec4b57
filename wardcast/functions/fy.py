"""Financial years: labels, start dates and display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fy_label(year: Column, next_year: Column | None = None, sep: str = "_") -> Column:
    """``2022`` -> ``2022_23``; the second part always has two digits."""
    following = year + 1 if next_year is None else next_year
    return F.concat(
        year.cast("string"), F.lit(sep), F.lpad((following % 100).cast("string"), 2, "0")
    )


def fy_of_date(date: Column, sep: str = "/", first_month: int = 4) -> Column:
    """Label of the financial year a date falls in."""
    year = F.when(F.month(date) >= first_month, F.year(date)).otherwise(F.year(date) - 1)
    return fy_label(year, sep=sep)


def fy_start(label: Column) -> Column:
    """First day of a financial year, from either spelling of its label."""
    return F.to_date(F.concat(F.substring(label, 1, 4), F.lit("-04-01")))


def fy_start_label(start: Column) -> Column:
    """Axis label of a start date: 1 April 2022 -> ``2022/23``."""
    return fy_label(F.year(start), sep="/")


def fy_display(label: Column) -> Column:
    """``2022_23`` -> ``2022/23`` (first underscore only)."""
    return F.regexp_replace(label, "^([^_]*)_", "$1/")
