"""Grow baseline counts over the financial years of the population forecast.

The growth of a person cell is one row with a value for every year, so counts meet it in one join that
multiplies no rows. Products are added up year by year in as many columns as there are years; only the
sums are opened into rows, one for each year.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.columns import COLS, Cols
from wardcast.operators.lookup import join_lookup
from wardcast.operators.size import fits

UNMATCHED = ("keep", "drop")
NAN = float("nan")


@dataclass(frozen=True)
class Growth:
    """Person cells with ``growths``, an array with one value for each of ``years``.

    A value is missing where the cell has no such year, and not a number where its growth is undefined. ``small`` tells
    whether the table may be broadcast, if that was measured.
    """

    cells: DataFrame
    years: tuple[str, ...]
    small: bool | None = None


def growth_by_cell(fy_popn: DataFrame, c: Cols = COLS) -> Growth:
    """Growth of each person cell, years side by side; the years are read, a list as long as the forecast."""
    years = [r[0] for r in fy_popn.select(c.fin_year).distinct().collect()]
    years = tuple(sorted(y for y in years if y is not None))
    value = F.coalesce(F.col(c.growth), F.lit(NAN))
    each = [F.max(F.when(F.col(c.fin_year) == y, value)) for y in years]
    growths = F.array(*each) if each else F.array().cast("array<double>")
    return Growth(fy_popn.groupBy(*c.person).agg(growths.alias("growths")), years)


def measured(growth: Growth) -> Growth:
    """The same with its size checked, once for all joins."""
    return Growth(growth.cells, growth.years, fits(growth.cells))


def grown(counts: DataFrame, growth: Growth, c: Cols = COLS) -> DataFrame:
    """Counts with the growths of their person cell, missing where there is none: as many rows as before."""
    return join_lookup(counts, growth.cells, c.person, small=growth.small)


def sums_by_year(value: Column, growth: Growth) -> Column:
    """Sum of value x growth for each year; not a number if a part of it is undefined."""
    known = F.coalesce(value.cast("double"), F.lit(NAN))
    sums = [F.sum(known * F.get("growths", F.lit(k))) for k in range(len(growth.years))]
    return F.array(*sums) if sums else F.array().cast("array<double>")


def totals(arrays: Column, growth: Growth) -> Column:
    """Element-wise sum of arrays of ``sums_by_year``."""
    sums = [F.sum(F.get(arrays, F.lit(k))) for k in range(len(growth.years))]
    return F.array(*sums) if sums else F.array().cast("array<double>")


def opened(sums: Column, unmatched: Column, growth: Growth, c: Cols = COLS) -> Column:
    """Entries (year, projected count) of summed arrays; unmatched counts are an entry without either.

    A year that no cell had gives no entry, an undefined sum a missing value.
    """
    entry = F.struct(F.lit(None).cast("string").alias(c.fin_year), F.lit(None).cast("double").alias(c.projected))
    values = [F.get(sums, F.lit(k)) for k in range(len(growth.years))]
    years = [
        F.when(v.isNotNull(), F.struct(F.lit(y).alias(c.fin_year), F.nanvl(v, F.lit(None)).alias(c.projected)))
        for y, v in zip(growth.years, values)
    ]
    return F.array_compact(F.array(*years, F.when(unmatched, entry)))


def check_unmatched(unmatched: str) -> bool:
    """Are counts without growth to be kept?"""
    if unmatched not in UNMATCHED:
        raise ValueError(f"unmatched must be one of {UNMATCHED}, not {unmatched!r}")
    return unmatched == "keep"


def project(
    counts: DataFrame,
    growth: DataFrame | Growth,
    group_keys: Sequence[str] = (),
    *,
    by_age: bool = True,
    unmatched: str = "keep",
    c: Cols = COLS,
) -> DataFrame:
    """Sum of count x growth by group, financial year and (with ``by_age``) age.

    Counts are brought to one row per group and person cell, joined to the growths of the cell and summed
    map-side, all years at once. Counts without growth form rows with a missing year and count;
    ``unmatched="drop"`` leaves them out. A missing coefficient makes its sum missing rather than too small.
    ``growth`` has one row per cell and year, or is the result of ``growth_by_cell``.
    """
    keep = check_unmatched(unmatched)
    if not isinstance(growth, Growth):
        growth = growth_by_cell(growth, c)
    keys = [*group_keys, *c.person]
    if set(counts.columns) != {*keys, "count"}:
        counts = counts.groupBy(*keys).agg(F.sum("count").alias("count"))
    ages = [c.age] if by_age else []
    sums = grown(counts, growth, c).groupBy(*group_keys, *ages).agg(
        sums_by_year(F.col("count"), growth).alias("_sums"),
        (F.bool_or(F.col("growths").isNull()) & F.lit(keep)).alias("_unmatched"),
    )
    entries = F.inline(opened(F.col("_sums"), F.col("_unmatched"), growth, c))
    return sums.select(*group_keys, *ages, entries).select(*group_keys, c.fin_year, *ages, c.projected)


def project_by_service(
    counts: DataFrame,
    growth: DataFrame | Growth,
    group_keys: Sequence[str] = (),
    *,
    unmatched: str = "keep",
    c: Cols = COLS,
) -> DataFrame:
    """Projection by group, service and year, ages added up in the same pass."""
    return project(counts, growth, [*group_keys, c.service], by_age=False, unmatched=unmatched, c=c)


def project_both(
    counts: DataFrame,
    growth: Growth,
    group_keys: Sequence[str] = (),
    *,
    once: str = "count",
    c: Cols = COLS,
) -> DataFrame:
    """Projections by age and by service from one join: service, age, ``by_age`` (which of them), year, projected count.

    ``counts`` has a row per group, service and person cell. Services add up ``count``, ages ``once`` (of patients in several services
    each is in one). Products are summed by service and age first; what is then added up in two ways is short.
    """
    names = {"count": "_count", **({once: "_once"} if once != "count" else {})}
    rows = grown(counts, growth, c).groupBy(*group_keys, c.service, c.age).agg(
        *[sums_by_year(F.col(n), growth).alias(to) for n, to in names.items()],
        F.bool_or(F.col("growths").isNull()).alias("_unmatched"),
    )
    keys = [F.col(k) for k in group_keys]
    sets = [[*keys, F.col(c.age)], [*keys, F.col(c.service)]]
    sums = rows.groupingSets(sets, *keys, F.col(c.service), F.col(c.age)).agg(
        (F.grouping(c.service) == 1).alias("by_age"),
        *[totals(F.col(to), growth).alias(to) for to in names.values()],
        F.bool_or("_unmatched").alias("_unmatched"),
    )
    used = F.when(F.col("by_age"), F.col(names.get(once, "_count"))).otherwise(F.col("_count"))
    entries = F.inline(opened(used, F.col("_unmatched"), growth, c))
    return sums.select(*group_keys, c.service, c.age, "by_age", entries)


def unmatched_counts(
    counts: DataFrame, growth: DataFrame, group_keys: Sequence[str] = (), c: Cols = COLS
) -> DataFrame:
    """How much of the baseline finds no growth coefficient, next to the whole."""
    known = growth.select(*c.person).distinct().withColumn("_known", F.lit(True))
    rows = join_lookup(counts, known, c.person)
    return rows.groupBy(*group_keys).agg(
        F.sum("count").alias("count"),
        F.sum(F.when(F.col("_known").isNull(), F.col("count")).otherwise(0)).alias("unmatched"),
    )
