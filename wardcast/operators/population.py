"""Population by financial year, growth coefficients and regional shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardcast.columns import COLS, Cols
from wardcast.functions.fy import fy_label
from wardcast.functions.measures import ratio, strict_sum
from wardcast.functions.recode import sex_label
from wardcast.operators.lookup import join_lookup, join_results


def population_series(
    population: DataFrame,
    *,
    base_year: int = 2022,
    weights: tuple[float, float] = (0.75, 0.25),
    c: Cols = COLS,
) -> DataFrame:
    """One row per person cell with its financial years in order, as an array of (year, population, growth).

    Input columns: year, area_code, age, sex, value. A financial year blends its calendar year
    with the next one that the cell has; the last calendar year has none and is dropped. A cell's calendar
    years come together as one short array; blend and base are taken from it by position.
    """
    rows = population.filter(F.col("year").try_cast("int") >= base_year).select(
        F.col("area_code").alias(c.district),
        F.col("age").try_cast("int").alias(c.age),
        sex_label(F.col("sex")).alias(c.gender),
        F.struct(F.col("year").try_cast("int").alias("year"), F.col("value").try_cast("double").alias("value")).alias("_at"),
    )
    cells = rows.groupBy(*c.person).agg(F.array_sort(F.collect_list("_at")).alias("_years"))
    n = F.size("_years") - 1
    blend = F.zip_with(
        F.slice("_years", F.lit(1), n),
        F.slice("_years", F.lit(2), n),
        lambda a, b: F.struct(
            fy_label(a["year"], b["year"]).alias(c.fin_year),
            (a["value"] * weights[0] + b["value"] * weights[1]).alias(c.population),
        ),
    )
    cells = cells.withColumn("_blend", blend)
    first = F.get("_blend", F.lit(0))[c.population]
    series = F.transform(
        F.filter("_blend", lambda x: x[c.population].isNotNull()),
        lambda x: F.struct(x[c.fin_year], x[c.population], ratio(x[c.population], first).alias(c.growth)),
    )
    return cells.select(*c.person, series.alias("series"))


def fy_population(
    population: DataFrame,
    *,
    base_year: int = 2022,
    weights: tuple[float, float] = (0.75, 0.25),
    c: Cols = COLS,
) -> DataFrame:
    """Calendar-year population to financial years, with growth since the first of them (see ``population_series``)."""
    cells = population_series(population, base_year=base_year, weights=weights, c=c)
    return cells.select(*c.person, F.inline("series")).select(*c.person, c.fin_year, c.population, c.growth)


def growth_coefficients(fy_popn: DataFrame, c: Cols = COLS) -> DataFrame:
    return fy_popn.select(*c.person, c.fin_year, c.growth)


def undefined_growth(fy_popn: DataFrame, c: Cols = COLS) -> DataFrame:
    """Cells without a growth coefficient, as their first population is zero.

    Counts in them make the projected sums they belong to missing.
    """
    return fy_popn.filter(F.col(c.growth).isNull()).select(*c.person).distinct()


def area_shares(area_region: DataFrame, area_district: DataFrame, c: Cols = COLS) -> DataFrame:
    """Share of each district's small areas that lie in each region."""
    both = join_lookup(
        area_region.select(c.area, c.region), area_district.select(c.area, c.district), [c.area]
    )
    # Counted by district and region first, so the window sees one row per pair.
    pairs = both.groupBy(c.region, c.district).agg(F.count(F.lit(1)).alias("_n"))
    whole = F.sum("_n").over(Window.partitionBy(c.district))
    return pairs.select(c.region, c.district, (F.col("_n") / whole).alias(c.share))


def region_population(shares: DataFrame, fy_popn: DataFrame, c: Cols = COLS) -> DataFrame:
    """Population of each region by financial year and age.

    Genders are added up before the join; the population streams past the
    district shares, which are the lookup. A share whose district has no
    population shows as a row without a financial year.
    """
    by_district = fy_popn.groupBy(c.district, c.fin_year, c.age).agg(
        strict_sum(F.col(c.population)).alias(c.population)
    )
    lookup = shares.withColumn("_shared", F.lit(True))
    both = join_lookup(by_district, lookup, [c.district]).filter("_shared").drop("_shared")
    alone = join_results(shares, by_district.select(c.district).distinct(), [c.district], "left_anti")
    both = both.unionByName(alone, allowMissingColumns=True)
    return both.groupBy(c.region, c.fin_year, c.age).agg(
        strict_sum(F.col(c.population) * F.col(c.share)).alias(c.age_population)
    )


def national_population(fy_popn: DataFrame, c: Cols = COLS) -> DataFrame:
    return fy_popn.groupBy(c.fin_year, c.age).agg(
        strict_sum(F.col(c.population)).alias(c.age_population)
    )
