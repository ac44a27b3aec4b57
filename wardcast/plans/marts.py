"""The published tables, from contacts and population to nested rows."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcast.columns import COLS, LEVELS, MEASURES, Cols, check_level, check_measure
from wardcast.operators.clean import tidy_contacts
from wardcast.operators.counts import (
    contact_cells,
    contact_counts,
    included_contacts,
    patient_counts,
    patient_shares_both,
    shares_of_level,
    unique_patients,
)
from wardcast.operators.lookup import join_results
from wardcast.operators.nest import nested
from wardcast.operators.population import (
    area_shares,
    fy_population,
    national_population,
    region_population,
)
from wardcast.operators.project import (
    Growth,
    growth_by_cell,
    measured,
    project,
    project_both,
    project_by_service,
)
from wardcast.operators.quality import contacts_dq, patients_dq
from wardcast.sources.marts import write_mart
from wardcast.sources.stages import Stage


@dataclass(frozen=True)
class Inputs:
    contacts: DataFrame
    area_region: DataFrame
    area_district: DataFrame
    submitters: DataFrame
    population: DataFrame


@dataclass(frozen=True)
class Base:
    """Tables every published table is made of."""

    contact_counts: DataFrame
    patient_counts: DataFrame
    patient_shares: dict[str, DataFrame]
    fy_population: DataFrame
    region_population: DataFrame
    national_population: DataFrame
    growth: Growth


def together(*jobs: Callable) -> list:
    """Submit independent jobs at the same time, so that small ones share the cluster."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


def base_tables(inputs: Inputs, stage: Stage | None = None, *, c: Cols = COLS, **tidy) -> Base:
    """Clean and count once.

    With a ``stage`` the contact cells, the count tables and the population are
    written between jobs, so that the long chain over the contacts runs once
    for all published tables, and later steps read small tables. What is kept by patient is clustered so: after
    the fill's shuffle patients are brought together no more.
    """

    def keep(make: Callable[[], DataFrame], name: str, cluster: str | None = None) -> DataFrame:
        return stage.save(make, name, cluster=cluster) if stage else make()

    def people() -> dict:
        popn = keep(lambda: fy_population(inputs.population, c=c), "fy_population")
        shares = area_shares(inputs.area_region, inputs.area_district, c)

        def growth() -> Growth:
            found = growth_by_cell(popn, c)
            return measured(replace(found, cells=keep(lambda: found.cells, "growth")))

        region, nation, growths = together(
            lambda: keep(lambda: region_population(shares, popn, c), "region_population"),
            lambda: keep(lambda: national_population(popn, c), "national_population"),
            growth,
        )
        return {
            "fy_population": popn,
            "region_population": region,
            "national_population": nation,
            "growth": growths,
        }

    def by_patient(cells: DataFrame) -> dict:
        patients = keep(lambda: patient_counts(cells, c), "patient_counts", c.patient)
        both = keep(lambda: patient_shares_both(patients, c), "patient_shares")
        shares = {level: shares_of_level(both, level, c) for level in LEVELS}
        return {"patient_counts": patients, "patient_shares": shares}

    def demand() -> dict:
        def cells_of_contacts() -> DataFrame:
            rows = tidy_contacts(
                inputs.contacts, inputs.area_district, inputs.submitters, stage=stage, c=c, **tidy
            )
            return contact_cells(rows, c)

        cells = keep(cells_of_contacts, "contact_cells", c.patient)
        contacts, patients = together(
            lambda: keep(lambda: contact_counts(cells, c), "contact_counts"), lambda: by_patient(cells)
        )
        return {"contact_counts": contacts, **patients}

    demanded, peopled = together(demand, people)
    return Base(**demanded, **peopled)


def baseline_counts(
    base: Base, measure: str, level: str, by_service: bool, c: Cols = COLS
) -> DataFrame:
    """Counts to project: included contacts, or fractional unique patients."""
    if check_measure(measure) == "contacts":
        return included_contacts(base.contact_counts, level, c)
    return unique_patients(base.patient_shares[level], level, by_service, c)


def projected(base: Base, measure: str, level: str, c: Cols = COLS) -> DataFrame:
    """Projected counts by region, year and age."""
    counts = baseline_counts(base, measure, level, False, c)
    keys = c.level_keys(level)
    return project(counts, base.growth, keys, c=c)


def projected_by_service(base: Base, measure: str, level: str, c: Cols = COLS) -> DataFrame:
    counts = baseline_counts(base, measure, level, True, c)
    keys = c.level_keys(level)
    return project_by_service(counts, base.growth, keys, c=c)


def build_mart(base: Base, measure: str, level: str, c: Cols = COLS) -> DataFrame:
    """One row per region, or one for the nation: nested projections and quality counts.

    Baseline counts are read once and joined once to the growths; both projections and both nested
    columns come from that.
    """
    keys = c.level_keys(check_level(level))
    if check_measure(measure) == "contacts":
        counts, once = included_contacts(base.contact_counts, level, c), "count"
    else:
        counts, once = base.patient_shares[level], "count_once"
    both = project_both(counts, base.growth, keys, once=once, c=c)
    popn = base.region_population if keys else base.national_population
    popn_keys = [c.region, c.fin_year, c.age] if keys else [c.fin_year, c.age]
    both = join_results(both, popn, popn_keys)

    ages, services = [c.fin_year, c.age], [c.service, c.fin_year]
    by_age = F.col("by_age")
    data = both.groupBy(*keys).agg(
        nested([*services, c.projected], services, ~by_age).alias("service_data"),
        nested([*ages, c.projected, c.age_population], ages, by_age).alias("data"),
    )
    quality = contacts_dq if check_measure(measure) == "contacts" else patients_dq
    counts = base.contact_counts if measure.lower() == "contacts" else base.patient_counts
    dq = quality(counts, level, prefix=True, c=c)
    if keys:
        mart = join_results(data, dq, [c.region])
    else:
        # Two one-row tables side by side: each fills its own columns.
        parts = data.unionByName(dq, allowMissingColumns=True)
        mart = parts.agg(*[F.first(x, ignorenulls=True).alias(x) for x in parts.columns])
    return mart.select(*keys, "service_data", "data", *[x for x in dq.columns if x != c.region])


def publish(
    spark: SparkSession,
    inputs: Inputs,
    root: str,
    *,
    run: str | None = None,
    version: str = "",
    c: Cols = COLS,
    **tidy,
) -> list[str]:
    """Compute and write all four published tables under ``root``; their paths.

    Tables between jobs are removed at the end. With a name for the ``run``, those of a try that failed are used by the
    next one of that name and ``version`` (of the inputs and parameters, as the caller counts them).
    """
    with Stage(spark, run=run, inputs=version) as stage:
        base = base_tables(inputs, stage, c=c, **tidy)

        def write(measure: str, level: str) -> str:
            return write_mart(build_mart(base, measure, level, c), root, measure, level, c)

        return together(*[partial(write, m, lv) for m in MEASURES for lv in LEVELS])
