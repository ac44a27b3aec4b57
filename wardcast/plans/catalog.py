"""Every registered query, run on the driver's tables.

Doubles are rounded half to even before they are compared with another engine,
since sums of floating-point numbers depend on their order.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import cached_property, partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from wardcast.columns import COLS as c
from wardcast.columns import LEVELS, MEASURES
from wardcast.functions.bands import BROAD_BANDS, FINE_BANDS, band, band_order
from wardcast.functions.fy import fy_display, fy_of_date, fy_start, fy_start_label
from wardcast.functions.recode import (
    attendance_status,
    recorded_service,
    region_display_name,
    service_display_name,
)
from wardcast.operators import compare, counts, insights, population, prestep, quality
from wardcast.operators.clean import flag_consistent, tidy_contacts
from wardcast.operators.fill import fill_down_up
from wardcast.operators.lookup import join_lookup
from wardcast.operators.nest import age_data, as_map, service_data
from wardcast.operators.project import project, unmatched_counts
from wardcast.operators.skew import big_keys
from wardcast.plans import fixtures, marts
from wardcast.sources import tables
from wardcast.sources.marts import one_region, read_mart, write_mart
from wardcast.sources.stages import Stage

DIGITS = 6
#: Names of the provider's columns, by ours.
RAW_NAMES = {c.patient: "Person_ID", c.date: "Contact_Date", c.service: "TeamType"}
HORIZON = "2032_33"  # for queries of a single horizon
SPLIT_FROM = 20  # rows of a patient from which the split fill is exercised


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.withColumns(
        {f.name: F.bround(f.name, digits) for f in df.schema if isinstance(f.dataType, DoubleType)}
    )


class Workspace:
    """The driver's tables of one folder, with the tables written between jobs.

    Inputs, counts and published tables are each written once to the session's
    shared folder and read back by the queries that need them.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.tables = spark, fixtures.StarTables(spark, sf_dir)
        self._published: set[tuple[str, str]] = set()

    @cached_property
    def stage(self) -> Stage:
        return Stage(self.spark)

    @cached_property
    def inputs(self) -> marts.Inputs:
        raw = vars(fixtures.inputs(self.tables))
        by = {"contacts": c.fin_year}
        saved = marts.together(
            *[partial(self.stage.save, df, name, by.get(name)) for name, df in raw.items()]
        )
        return marts.Inputs(**dict(zip(raw, saved)))

    @cached_property
    def raw(self) -> str:
        """The inputs as a provider's files: their names, text for numbers and dates, some of it unreadable.

        Forecasts lie in folders by variant; in the low one some cells begin with nobody.
        """
        i, save = self.inputs, self.stage.save
        patient = F.when(F.col(c.patient) % 101 == 5, F.concat(F.lit("P"), F.col(c.patient))).otherwise(F.col(c.patient).cast("string"))
        day = F.when(F.dayofmonth(c.date) == 31, F.lit(None)).when(F.dayofmonth(c.date) == 30, F.concat(F.col(c.date).cast("string"), F.lit("x")))
        contacts = i.contacts.withColumns({c.patient: patient, c.date: F.when(F.dayofmonth(c.date) < 30, F.col(c.date).cast("string")).otherwise(day)})
        extra = F.lit("name")
        value = F.col("value").cast("string")
        principal = i.population.withColumn("value", value).withColumn("projection", F.lit("principal_proj"))
        nobody = (F.col("age") == 85) & (F.col("sex") == 1) & (F.col("year") <= 2023)
        unread = F.when(F.col("age") == 3, F.lit(None)).when(F.col("age") == 4, "n/a")
        low = i.population.withColumn("value", F.when(nobody, "0").when(F.col("age").isin(3, 4), unread).otherwise(value))
        popn = principal.unionByName(low.withColumn("projection", F.lit("low_proj")))
        save(contacts.withColumnsRenamed(RAW_NAMES).withColumn("unused", F.lit(1)), "raw_contacts")
        save(i.area_region.withColumn("area_name", extra), "raw_area_region")
        save(i.area_district.withColumn("area_name", extra), "raw_area_district")
        save(i.submitters.withColumn("name", extra), "raw_submitters")
        save(popn, "raw_population", "projection")
        return f"{self.stage.root}/raw_"

    def low_population(self) -> DataFrame:
        """Forecast of the low variant by financial year."""
        return population.fy_population(tables.check_population(self.spark, f"{self.raw}population", "low_proj").rows)

    @cached_property
    def base(self) -> marts.Base:
        return marts.base_tables(self.inputs, self.stage)

    def mart(self, measure: str, level: str) -> DataFrame:
        """A published table, written at first use and read back."""
        if (measure, level) not in self._published:
            write_mart(marts.build_mart(self.base, measure, level), self.stage.root, measure, level)
            self._published.add((measure, level))
        return read_mart(self.spark, self.stage.root, measure, level)

    def published(self, names: list[tuple[str, str]]) -> list[DataFrame]:
        """Several published tables, written at the same time."""
        self.base  # noqa: B018 - written before the tables that need it
        return marts.together(*[partial(self.mart, *n) for n in names])

    def both(self, measure: str) -> list[DataFrame]:
        return self.published([(measure, level) for level in LEVELS])

    def all(self) -> list[DataFrame]:
        """Regional contacts and patients, then national contacts and patients."""
        return self.published([(m, level) for level in LEVELS for m in MEASURES])

    def located(self) -> DataFrame:
        """All contacts with their district attached."""
        return join_lookup(self.inputs.contacts, self.inputs.area_district, [c.area])


Query = Callable[[Workspace], DataFrame]


def _tidy(w: Workspace) -> DataFrame:
    return tidy_contacts(w.inputs.contacts, w.inputs.area_district, w.inputs.submitters)


def _fill(split: bool) -> Query:
    cols = [c.region, c.region_name, c.age, c.gender]

    def run(w: Workspace) -> DataFrame:
        rows = w.inputs.contacts.filter(F.col(c.patient).isNotNull())
        rows = rows.select(c.patient, c.date, *cols)
        big = big_keys(rows, c.patient, SPLIT_FROM) if split else None
        return fill_down_up(rows, c.patient, c.date, cols, big=big)

    return run


def _attendance(w: Workspace) -> DataFrame:
    code = F.col(c.attendance)
    return w.inputs.contacts.groupBy(code, attendance_status(code).alias("status")).agg(
        F.count(F.lit(1)).alias("contacts")
    )


def _consistent_flag(w: Workspace) -> DataFrame:
    by_submitter = w.inputs.contacts.groupBy(c.submitter).agg(F.count(F.lit(1)).alias("contacts"))
    return flag_consistent(by_submitter, w.inputs.submitters)


def _age_bands(w: Workspace) -> DataFrame:
    age = F.col(c.age).try_cast("int")
    return w.inputs.contacts.groupBy(
        band(age, FINE_BANDS).alias("fine"),
        band_order(age, FINE_BANDS).alias("fine_ord"),
        band(age, BROAD_BANDS).alias("broad"),
        band(age, BROAD_BANDS, null_age="Unknown").alias("broad_or_unknown"),
    ).agg(F.count(F.lit(1)).alias("contacts"))


def _fy_labels(w: Workspace) -> DataFrame:
    label = fy_of_date(F.col(c.date), sep="_")
    start = fy_start(label)
    return w.inputs.contacts.groupBy(
        label.alias("label"), fy_display(label).alias("shown"), start.alias("start"),
        fy_start_label(start).alias("start_label"),
    ).agg(F.count(F.lit(1)).alias("contacts"))


def _display_names(w: Workspace) -> DataFrame:
    return w.inputs.contacts.groupBy(
        region_display_name(F.col(c.region_name)).alias("region_shown"),
        service_display_name(recorded_service(F.col(c.service))).alias("service_shown"),
    ).agg(F.count(F.lit(1)).alias("contacts"))


def _shares(w: Workspace) -> DataFrame:
    return population.area_shares(w.inputs.area_region, w.inputs.area_district)


def _mart_rows(measure: str, level: str) -> Query:
    """Both nested columns opened again, with the quality columns beside them."""

    def run(w: Workspace) -> DataFrame:
        mart = marts.build_mart(w.base, measure, level)
        keys = c.level_keys(level)
        dq = quality.dq_columns(measure, level)
        ages = mart.select(*keys, *dq, F.inline("data")).withColumn("kind", F.lit("data"))
        services = mart.select(*keys, *dq, F.inline("service_data")).withColumn("kind", F.lit("service"))
        return ages.unionByName(services, allowMissingColumns=True)

    return run


def _dq_tables(level: str) -> Query:
    """Reports of both measures, one under the other."""

    def run(w: Workspace) -> DataFrame:
        parts = [
            quality.dq_table(w.mart(m, level), m, level).withColumn("measure", F.lit(m))
            for m in MEASURES
        ]
        return reduce(DataFrame.unionByName, parts)

    return run


def _exclusion_rates(w: Workspace) -> DataFrame:
    parts = [
        quality.dq_exclusion_rate(w.mart(m, "region"), m).withColumn("measure", F.lit(m))
        for m in MEASURES
    ]
    return reduce(DataFrame.unionByName, parts)


def _year_map(w: Workspace) -> DataFrame:
    """Years of each region as a map from year to total, opened as rows."""
    totals = compare.total_by_year(w.mart("contacts", "region"))
    maps = as_map(totals, c.fin_year, c.projected, c.regions)
    return maps.select(*c.regions, F.explode("values").alias(c.fin_year, c.projected))


def _submissions(w: Workspace) -> DataFrame:
    """Line items as submissions of one contact key; the last ship date is the latest."""
    return prestep.latest_submission(
        w.tables["lineitem"].select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_returnflag"),
        ["l_orderkey", "l_linenumber"],
        ["l_shipdate"],
    )


def _found_submitters(w: Workspace) -> DataFrame:
    return prestep.consistent_submitters(w.inputs.contacts)


def _exclusions(w: Workspace) -> DataFrame:
    rows = prestep.quality_exclusions(w.located())
    return rows.groupBy(F.array_join("reasons", "; ").alias("reasons")).agg(
        F.count(F.lit(1)).alias("contacts")
    )


def _contacts_in(w: Workspace) -> tables.Checked:
    return tables.check_contacts(w.spark, f"{w.raw}contacts", RAW_NAMES)


def _rejected_contacts(w: Workspace) -> DataFrame:
    rejects = _contacts_in(w).rejects
    return rejects.select("Person_ID", "Contact_Date", c.submitter, F.array_join("reasons", "; ").alias("reasons"))


def _rejected_population(w: Workspace) -> DataFrame:
    return tables.check_population(w.spark, f"{w.raw}population", "low_proj").counts()


def _projected_low(w: Workspace) -> DataFrame:
    """Contacts grown by the low forecast: sums with a cell of undefined growth are missing."""
    counts_ = counts.included_contacts(w.base.contact_counts, "region")
    return project(counts_, w.low_population(), c.regions)


def _projected_matched(w: Workspace) -> DataFrame:
    counts_ = counts.included_contacts(w.base.contact_counts, "region")
    return project(counts_, w.base.growth, c.regions, by_age=False, unmatched="drop")


QUERIES: dict[str, Query] = {
    "load_contacts": lambda w: _contacts_in(w).rows,
    "rejected_contacts": _rejected_contacts,
    "contact_reasons": lambda w: _contacts_in(w).counts(),
    "load_area_region": lambda w: tables.load_area_lookup(w.spark, f"{w.raw}area_region"),
    "load_area_district": lambda w: tables.load_area_lookup(w.spark, f"{w.raw}area_district", "cd$"),
    "load_submitters": lambda w: tables.load_submitters(w.spark, f"{w.raw}submitters"),
    "load_population": lambda w: tables.check_population(w.spark, f"{w.raw}population").rows,
    "rejected_population": _rejected_population,
    "undefined_growth": lambda w: population.undefined_growth(w.low_population()),
    "project_undefined": _projected_low,
    "project_matched": _projected_matched,
    "total_of_year": lambda w: compare.total_by_year(w.mart("contacts", "region"), HORIZON),
    "headline_horizon": lambda w: compare.headline(w.mart("contacts", "region"), horizon=HORIZON),
    "change_by_age_horizon": lambda w: compare.change_by_age(*w.both("contacts"), horizon=HORIZON),
    "top_age_change_horizon": lambda w: compare.top_age_change(w.mart("contacts", "region"), horizon=HORIZON),
    "change_by_service_horizon": lambda w: compare.change_by_service(*w.both("contacts"), horizon=HORIZON),
    "service_comparison_page": lambda w: compare.service_comparison(
        *w.both("patients"), horizon=HORIZON, page=1
    ),
    "service_order_horizon": lambda w: compare.service_order(*w.both("contacts"), horizon=HORIZON),
    "top_service_change_horizon": lambda w: compare.top_service_change(
        w.mart("patients", "region"), horizon=HORIZON
    ),
    "tidy_contacts": _tidy,
    "fill_down_up": _fill(split=False),
    "fill_down_up_split": _fill(split=True),
    "attendance_recode": _attendance,
    "consistent_flag": _consistent_flag,
    "age_bands": _age_bands,
    "fy_labels": _fy_labels,
    "display_names": _display_names,
    "fy_population": lambda w: population.fy_population(w.inputs.population),
    "growth_coefficients": lambda w: population.growth_coefficients(
        population.fy_population(w.inputs.population)
    ),
    "area_shares": _shares,
    "region_population": lambda w: population.region_population(
        _shares(w), population.fy_population(w.inputs.population)
    ),
    "national_population": lambda w: population.national_population(
        population.fy_population(w.inputs.population)
    ),
    "contact_cells": lambda w: counts.contact_cells(_tidy(w)),
    "patient_shares": lambda w: counts.patient_shares(w.base.patient_counts, "region"),
    "contact_counts": lambda w: counts.contact_counts(_tidy(w)),
    "patient_counts": lambda w: counts.patient_counts(_tidy(w)),
    "mart_roundtrip": lambda w: age_data(w.mart("contacts", "region")),
    "one_region": lambda w: service_data(one_region(w.mart("patients", "region"), "Q2")),
    "region_list": lambda w: compare.region_list(w.mart("contacts", "region")),
    "year_list": lambda w: compare.year_list(w.mart("contacts", "national")),
    "horizon_list": lambda w: compare.horizon_list(w.mart("contacts", "national")),
    "total_by_year": lambda w: compare.total_by_year(w.mart("patients", "national")),
    "year_map": _year_map,
    "headline_national": lambda w: compare.headline(w.mart("contacts", "national"), horizon=None),
    "headline_region": lambda w: compare.headline(w.mart("patients", "region"), horizon=None),
    "age_share_summary": lambda w: compare.age_share_summary(w.mart("contacts", "national")),
    "projection_series": lambda w: compare.projection_series(
        w.mart("contacts", "region"), horizon="2032_33"
    ),
    "change_by_age": lambda w: compare.change_by_age(*w.both("contacts"), horizon=None),
    "top_age_change": lambda w: compare.top_age_change(w.mart("contacts", "region"), horizon=None),
    "change_by_service": lambda w: compare.change_by_service(*w.both("contacts"), horizon=None),
    "service_comparison": lambda w: compare.service_comparison(*w.both("patients"), horizon=None),
    "service_order": lambda w: compare.service_order(*w.both("contacts"), horizon=None),
    "top_service_change": lambda w: compare.top_service_change(
        w.mart("patients", "region"), horizon=None
    ),
    "usage_rate": lambda w: compare.usage_rate(*w.both("patients")),
    "contacts_per_patient": lambda w: compare.contacts_per_patient(*w.all()),
    "dq_table_national": _dq_tables("national"),
    "dq_table_region": _dq_tables("region"),
    "dq_exclusion_rate": _exclusion_rates,
    "insight_facts": lambda w: insights.insight_facts({m: w.mart(m, "region") for m in MEASURES}),
    "national_facts": lambda w: insights.national_facts(
        {m: w.mart(m, "national") for m in MEASURES}
    ),
    "unmatched_counts": lambda w: unmatched_counts(
        counts.included_contacts(w.base.contact_counts, "region"), w.base.fy_population, c.regions
    ),
    "latest_submission": _submissions,
    "consistent_submitters": _found_submitters,
    "age_at_first_contact": lambda w: prestep.age_at_first_contact(w.inputs.contacts),
    "coverage": lambda w: prestep.coverage(w.inputs.contacts, _found_submitters(w)),
    "quality_exclusions": _exclusions,
}


def _register_levels() -> None:
    for level in LEVELS:
        QUERIES[f"contacts_dq_{level}"] = lambda w, level=level: quality.contacts_dq(
            w.base.contact_counts, level
        )
        QUERIES[f"patients_dq_{level}"] = lambda w, level=level: quality.patients_dq(
            w.base.patient_counts, level
        )
        QUERIES[f"patient_lad_shares_{level}"] = lambda w, level=level: counts.patient_lad_shares(
            w.base.patient_counts, level
        )
        QUERIES[f"unique_patients_{level}"] = lambda w, level=level: counts.unique_patients(
            w.base.patient_counts, level
        )
        QUERIES[f"unique_patients_by_service_{level}"] = (
            lambda w, level=level: counts.unique_patients(w.base.patient_counts, level, True)
        )
        QUERIES[f"included_contacts_{level}"] = lambda w, level=level: counts.included_contacts(
            w.base.contact_counts, level
        )
        for measure in MEASURES:
            QUERIES[f"project_{measure}_{level}"] = (
                lambda w, level=level, measure=measure: marts.projected(w.base, measure, level)
            )
            QUERIES[f"service_{measure}_{level}"] = (
                lambda w, level=level, measure=measure: marts.projected_by_service(
                    w.base, measure, level
                )
            )
            QUERIES[f"mart_{measure}_{level}_exploded"] = _mart_rows(measure, level)


_register_levels()

_workspaces: dict[tuple[str, str], Workspace] = {}
_lock = threading.RLock()  # tables between jobs are written once, whoever asks first


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """One workspace per application and folder, so that written tables are shared."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _workspaces:
        _workspaces[key] = Workspace(spark, sf_dir)
    return _workspaces[key]


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    with _lock:
        return rounded(QUERIES[name](workspace(spark, sf_dir)))
