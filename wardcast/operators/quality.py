"""Data-quality summaries of contacts and patients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.columns import COLS, Cols, check_level, check_measure
from wardcast.functions.measures import round_even, share_percent, sum_where
from wardcast.functions.recode import ATTENDED, CANCELLED, NOT_ATTENDED, UNKNOWN
from wardcast.operators.counts import all_present

# Measures of each summary in report order, with their labels.
DQ_LABELS = {
    "contacts": {
        "all_unfiltd": "All contacts in initial dataset",
        "missing_icb": "Contacts not attributed to an ICB",
        "inconsistnt": "Contacts from inconsistent submitters",
        "not_attnded": "Contacts where the patient did not attend",
        "app_canclld": "Contacts where the appointment was cancelled",
        "app_unknown": "Contacts where the appointment status is unknown",
        "missing_age": "Contacts with unknown patient age",
        "missing_gen": "Contacts with unknown patient gender",
        "total_excld": "Total contacts excluded",
        "final_count": "Remaining contacts included in projections",
    },
    "patients": {
        "all_unfiltd": "All patients in initial dataset",
        "missing_icb": "Patients not attributed to an ICB",
        "inconsistnt": "Patients from inconsistent submitters",
        "not_attnded": "Patients who did not attend any appointments",
        "missing_age": "Patients with unknown patient age",
        "missing_gen": "Patients with unknown patient gender",
        "total_excld": "Total patients excluded",
        "final_count": "Remaining patients included in projections",
    },
}
NATIONAL_ONLY = "missing_icb"


def dq_measures(measure: str, level: str) -> list[str]:
    names = list(DQ_LABELS[check_measure(measure)])
    return names if check_level(level) == "national" else [n for n in names if n != NATIONAL_ONLY]


def dq_columns(measure: str, level: str, c: Cols = COLS) -> list[str]:
    return [c.prefix(measure, level) + n for n in dq_measures(measure, level)]


def _report(sums: DataFrame, measure: str, level: str, prefix: bool, c: Cols) -> DataFrame:
    out = sums.withColumn("total_excld", F.col("all_unfiltd") - F.col("final_count"))
    names = dq_measures(measure, level)
    head = c.prefix(measure, level) if prefix else ""
    keys = [c.region] if level == "region" else []
    return out.select(*keys, *[F.col(n).alias(head + n) for n in names])


def contacts_dq(
    counts: DataFrame, level: str, *, prefix: bool = False, c: Cols = COLS
) -> DataFrame:
    """Contacts by reason for exclusion; one contact may have several reasons."""
    region = check_level(level) == "region"
    n = F.col("count")
    attendance = F.col(c.attendance)
    present = all_present(*c.person) if region else all_present(c.region, *c.person)
    reasons = {
        "all_unfiltd": F.sum(n),
        "missing_icb": sum_where(F.col(c.region).isNull(), n),
        "inconsistnt": sum_where(F.col(c.consistent) == 0, n),
        "not_attnded": sum_where(attendance == NOT_ATTENDED, n),
        "app_canclld": sum_where(attendance == CANCELLED, n),
        "app_unknown": sum_where(attendance == UNKNOWN, n),
        "missing_age": sum_where(F.col(c.age).isNull(), n),
        "missing_gen": sum_where(F.col(c.gender).isNull(), n),
        "final_count": sum_where(
            present & (F.col(c.consistent) == 1) & (attendance == ATTENDED), n
        ),
    }
    if region:
        del reasons[NATIONAL_ONLY]
        counts = counts.filter(F.col(c.region).isNotNull())
    groups = counts.groupBy(c.region) if region else counts.groupBy()
    sums = groups.agg(*[v.alias(k) for k, v in reasons.items()])
    return _report(sums, "contacts", level, prefix, c)


def _any(condition: Column) -> Column:
    return F.bool_or(condition)


def _never(column: str) -> Column:
    return F.bool_and(F.col(column).isNull())


def patients_dq(
    counts: DataFrame, level: str, *, prefix: bool = False, c: Cols = COLS
) -> DataFrame:
    """Patients by reason for exclusion: none of the patient's rows has what is needed.

    Per-patient flags are true/false aggregates, combined map-side, so that a
    patient with very many rows is no burden; then patients are added up.
    """
    region = check_level(level) == "region"
    consistent, attended = F.col(c.consistent), F.col(c.attendance)
    needed = [F.col(x).isNotNull() for x in ([] if region else [c.region]) + c.person]
    included = _any(consistent == 1) & _any(attended == 1)
    for condition in needed:
        included = included & _any(condition)
    flags = {
        "missing_icb": _never(c.region),
        "inconsistnt": F.bool_and(consistent == 0),
        "not_attnded": F.bool_and(attended == 0),
        "missing_age": _never(c.age),
        "missing_gen": _never(c.gender),
        "final_count": included,
    }
    if region:
        del flags[NATIONAL_ONLY]
        counts = counts.filter(F.col(c.region).isNotNull())
    keys = [c.region] if region else []
    patients = counts.groupBy(*keys, c.patient).agg(
        *[v.cast("int").alias(k) for k, v in flags.items()]
    )
    sums = patients.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("all_unfiltd"), *[F.sum(k).alias(k) for k in flags]
    )
    return _report(sums, "patients", level, prefix, c)


def dq_table(mart: DataFrame, measure: str, level: str, c: Cols = COLS) -> DataFrame:
    """Report rows: category label, count and per cent of the first category."""
    measure, keys = check_measure(measure), c.level_keys(level)
    head = c.prefix(measure, level)
    names = dq_measures(measure, level)
    first = F.col(head + names[0])
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("category_ord"),
                F.lit(DQ_LABELS[measure][n]).alias("category"),
                round_even(F.col(head + n), 0).cast("bigint").alias("n"),
                share_percent(F.col(head + n), first).alias("pct"),
            )
            for i, n in enumerate(names, start=1)
        ]
    )
    return mart.select(*keys, F.inline(rows))


def dq_exclusion_rate(mart: DataFrame, measure: str, level: str = "region", c: Cols = COLS) -> DataFrame:
    """Per cent of all initial contacts or patients that were left out."""
    head = c.prefix(measure, level)
    rate = share_percent(F.col(head + "total_excld"), F.col(head + "all_unfiltd"))
    return mart.select(*c.level_keys(level), rate.alias("exclusion_rate"))
