"""Optional steps before cleaning: latest versions, submitter checks, first age, exclusions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.columns import COLS, Cols
from wardcast.functions.recode import ATTENDED, UNKNOWN, attendance_status
from wardcast.operators.lookup import flag_membership


LAST_DAY = 2**31 - 1
INTS = 2**32  # how many ages an integer can hold, to set days apart


def latest_submission(
    rows: DataFrame, keys: Sequence[str], version_cols: Sequence[str]
) -> DataFrame:
    """One row per key: the highest version, ties settled by the other columns.

    The maximum of a struct combines map-side, so a key with very many copies
    does not end up in one sort as it would with ``row_number``.
    """
    rest = [x for x in rows.columns if x not in keys]
    tie = [x for x in rest if x not in version_cols]
    best = F.max(F.struct(*version_cols, *tie)).alias("_row")
    out = rows.groupBy(*keys).agg(best)
    fields = [F.col("_row")[x].alias(x) if x in rest else F.col(x) for x in rows.columns]
    return out.select(*fields)


def _months(condition: Column) -> Column:
    """Number of different calendar months in which the condition holds."""
    month = F.call_function("shiftleft", F.lit(1), F.month("_date") - 1)
    return F.bit_count(F.coalesce(F.bit_or(F.when(condition, month)), F.lit(0)))


def consistent_submitters(
    contacts: DataFrame, *, baseline_fy: str = "2022/23", months: int = 12, c: Cols = COLS
) -> DataFrame:
    """Submitters with contacts, and with attended contacts, in every month of the year.

    Months are gathered as bits of one integer per submitter: plain partial
    aggregation, no distinct.
    """
    attended = attendance_status(F.col(c.attendance)) == ATTENDED
    rows = contacts.filter((F.col(c.fin_year) == baseline_fy) & F.col(c.submitter).isNotNull())
    per = (
        rows.withColumn("_date", F.col(c.date))
        .groupBy(c.submitter)
        .agg(
            _months(F.lit(True)).alias("months_submitted"),
            _months(attended).alias("months_attended"),
        )
    )
    full = (F.col("months_submitted") >= months) & (F.col("months_attended") >= months)
    return per.filter(full).select(F.col(c.submitter).alias("provider_org_id"))


def age_at_first_contact(
    contacts: DataFrame, *, baseline_fy: str = "2022/23", c: Cols = COLS
) -> DataFrame:
    """One age per patient: that of the earliest contact with a known age (lowest on a day).

    Day and age make one number to take the least of, so the aggregation keeps
    to fixed-width buffers. Contacts without a date come last.
    """
    age = F.col(c.age).try_cast("int")
    day = F.coalesce(F.unix_date(F.to_date(c.date)), F.lit(LAST_DAY)).cast("long")
    rows = contacts.filter((F.col(c.fin_year) == baseline_fy) & F.col(c.patient).isNotNull())
    return rows.groupBy(c.patient).agg(F.min_by(age, day * INTS + (age.cast("long") + INTS // 2)).alias(c.age))


def coverage(
    contacts: DataFrame, submitters: DataFrame, *, baseline_fy: str = "2022/23", c: Cols = COLS
) -> DataFrame:
    """Attended contacts of all submitters and of the consistent ones, and their share."""
    attended = attendance_status(F.col(c.attendance)) == ATTENDED
    rows = contacts.filter((F.col(c.fin_year) == baseline_fy) & attended).select(c.submitter)
    rows = flag_membership(rows, c.submitter, submitters, c.consistent)
    listed = F.coalesce(F.col(c.consistent), F.lit(0))
    return rows.agg(
        F.count(F.lit(1)).alias("attended"),
        F.sum(listed).alias("attended_consistent"),
        F.bround(F.try_divide(F.sum(listed) * 100, F.count(F.lit(1))), 1).alias("pct_covered"),
    )


def quality_exclusions(rows: DataFrame, *, max_age: int = 115, c: Cols = COLS) -> DataFrame:
    """Add ``reasons``: why a contact with its district attached is of poor quality."""
    age = F.col(c.age).try_cast("int")
    checks = {
        "no patient": F.col(c.patient).isNull(),
        "no gender": F.col(c.gender).isNull() | (F.col(c.gender) == UNKNOWN),
        "no age": age.isNull(),
        "age too high": age > max_age,
        "no district": F.col(c.district).isNull(),
    }
    reasons = F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()])
    return rows.withColumn("reasons", F.array_compact(reasons))
