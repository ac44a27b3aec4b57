"""Counts of contacts and of fractional unique patients."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardcast.columns import COLS, Cols, check_level
from wardcast.functions.recode import ATTENDED, GENDERS


def all_present(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in columns])


def contact_cells(tidy: DataFrame, c: Cols = COLS) -> DataFrame:
    """Contacts counted by patient and attributes, without dates; ``n`` contacts each.

    The common ground of all later counts, and the table to store between jobs:
    far smaller than the contacts and counted map-side. ``any_consistent`` and
    ``any_attended`` are raised over the patient's region and service,
    independently of each other. The cells and their flags use the partitioning
    by patient that filling the gaps has left, so neither shuffles again.
    """
    keys = [*c.regions, c.service, c.patient, c.consistent, c.attendance, *c.person]
    cells = tidy.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*c.regions, c.service, c.patient)
    attended = F.coalesce((F.col(c.attendance) == ATTENDED).cast("int"), F.lit(0))
    return cells.withColumns(
        {
            "any_consistent": F.max(c.consistent).over(w),
            "any_attended": F.max(attended).over(w),
        }
    )


def _is_cells(rows: DataFrame) -> bool:
    return "any_attended" in rows.columns


def contact_counts(contacts: DataFrame, c: Cols = COLS) -> DataFrame:
    """Contacts by region, service, quality flags, district, age and gender.

    Takes clean contacts or their cells.
    """
    n = F.sum("n") if _is_cells(contacts) else F.count(F.lit(1))
    keys = [*c.regions, c.service, c.consistent, c.attendance, *c.person]
    return contacts.groupBy(*keys).agg(n.alias("count"))


def patient_counts(contacts: DataFrame, c: Cols = COLS) -> DataFrame:
    """Contacts per patient, with flags raised over the patient's region and service.

    Both flags may come from different contacts, and ``n`` counts every one of
    the patient's contacts. Takes clean contacts or their cells.
    """
    cells = contacts if _is_cells(contacts) else contact_cells(contacts, c)
    return cells.groupBy(
        *c.regions,
        c.service,
        c.patient,
        F.col("any_consistent").alias(c.consistent),
        F.col("any_attended").alias(c.attendance),
        *c.person,
    ).agg(F.sum("n").alias("n"))


def included_patients(counts: DataFrame, level: str, c: Cols = COLS) -> DataFrame:
    """Patient rows that take part in the projection; only the regional ones need a region."""
    present = [c.region, *c.person] if check_level(level) == "region" else c.person
    flags = (F.col(c.consistent) == 1) & (F.col(c.attendance) == 1)
    return counts.filter(flags & all_present(*present))


def patient_lad_shares(counts: DataFrame, level: str, c: Cols = COLS) -> DataFrame:
    """Share of each patient's contacts by district, within the region or nationally.

    A patient's window comes first and the sum by district uses its shuffle; where the table is clustered by
    patient there is none.
    """
    keys = c.level_keys(level)
    whole = F.sum("n").over(Window.partitionBy(*keys, c.patient))
    rows = included_patients(counts, level, c).withColumn("_all", whole)
    by_district = rows.groupBy(*keys, c.district, c.patient).agg(F.sum("n").alias("_n"), F.max("_all").alias("_all"))
    return by_district.select(*keys, c.district, c.patient, (F.col("_n") / F.col("_all")).alias("prop"))


def _share(within: Sequence[str], order: Sequence[str], c: Cols) -> tuple[Column, Column]:
    """All of a patient's contacts, and those in a row's district.

    ``within`` is the region, or nothing for the nation. The widest window comes first, in the order that the
    others need: one sort serves all.
    """
    patient = Window.partitionBy(c.patient, *within).orderBy(*c.person, *order)
    whole = patient.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = Window.partitionBy(c.patient, *within, c.district)
    return F.sum("n").over(whole), F.sum("n").over(here)


def patient_shares_both(counts: DataFrame, c: Cols = COLS) -> DataFrame:
    """Fractional patients by region, service and person cell, for the regions and for the nation.

    ``count`` and ``count_once`` are the region's (see ``patient_shares``), missing for patients without a region;
    ``national`` and ``national_once`` are parts of the nation's, each patient's share in the first of the
    regions it has in a cell, so that adding them over regions gives the national figures.

    Contacts are brought together by patient once, by the first window, unless they are clustered so; windows for both levels use that, with a sort each, in
    place of joins of shares back to the patients. Every window holds the counted cells of one patient at most.
    """
    rows = included_patients(counts, "national", c)
    everywhere = [c.service, *c.regions]
    total, here = _share([], everywhere, c)
    person = Window.partitionBy(c.patient, *c.person)
    rows = rows.withColumn("_all", total).withColumn("_share", here / F.col("_all"))
    rows = rows.withColumn("_first", F.row_number().over(person.orderBy(*everywhere)) == 1)
    again = Window.partitionBy(c.patient, *c.person, c.service).orderBy(*c.regions)
    rows = rows.withColumn("_national", F.when(F.row_number().over(again) == 1, F.col("_share")))
    rows = rows.withColumn("_national_once", F.when(F.col("_first"), F.col("_share")).otherwise(0.0))

    total, here = _share(c.regions, [c.service], c)
    rows = rows.withColumn("_all", total)
    # A share is looked up by region code and name, so it is missing where one of them is.
    share = F.when(all_present(*c.regions), here / F.col("_all"))
    own = Window.partitionBy(c.patient, *c.regions, *c.person).orderBy(c.service)
    first = F.row_number().over(own) == 1
    rows = rows.withColumn("_share", share).withColumn("_first", first)
    once = F.when(F.col("_first"), F.col("_share")).when(F.col("_share").isNotNull(), 0.0)
    return rows.groupBy(*c.regions, c.service, *c.person).agg(
        F.sum("_share").alias("count"),
        F.sum(once).alias("count_once"),
        F.sum("_national").alias("national"),
        F.sum("_national_once").alias("national_once"),
    )


def shares_of_level(both: DataFrame, level: str, c: Cols = COLS) -> DataFrame:
    """Fractional patients of one level from ``patient_shares_both``; patients are not read again."""
    if check_level(level) == "region":
        return both.filter(F.col(c.region).isNotNull()).drop("national", "national_once")
    return both.groupBy(c.service, *c.person).agg(
        F.sum("national").alias("count"), F.sum("national_once").alias("count_once")
    )


def patient_shares(counts: DataFrame, level: str, c: Cols = COLS) -> DataFrame:
    """Fractional patients by service, district, age and gender, in both ways of counting.

    ``count`` adds up the patients of a service; ``count_once`` lets a patient
    of several services count in one of them only, so that adding it over
    services gives the unique patients. One pass over the patients serves both.
    """
    return shares_of_level(patient_shares_both(counts, c), level, c)


def unique_patients(
    counts: DataFrame, level: str, by_service: bool = False, c: Cols = COLS
) -> DataFrame:
    """Fractional unique patients by district, age and gender (and service).

    A patient seen in several districts counts in each by the share of their
    contacts there. By service the same overall share is used, so a service
    seen in one of two districts adds up to less than one. Takes patient counts
    or the result of ``patient_shares``.
    """
    shares = counts if "count_once" in counts.columns else patient_shares(counts, level, c)
    keys = c.level_keys(level)
    if by_service:
        return shares.select(*keys, c.service, *c.person, "count")
    return shares.groupBy(*keys, *c.person).agg(F.sum("count_once").alias("count"))


def included_contacts(counts: DataFrame, level: str, c: Cols = COLS) -> DataFrame:
    """Contacts that take part in the projection, by service, district, age and gender.

    A district is not required here: such contacts stay visible as unmatched
    in the projection. National figures are the sum of the regional ones.
    """
    keys = c.level_keys(level)
    kept = counts.filter(
        (F.col(c.consistent) == 1)
        & (F.col(c.attendance) == ATTENDED)
        & F.col(c.gender).isin(*GENDERS)
        & all_present(c.age, c.region)
    )
    return kept.groupBy(*keys, c.service, *c.person).agg(F.sum("count").alias("count"))
