"""From raw contacts to clean, flagged contacts of the baseline year."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardcast.columns import COLS, Cols
from wardcast.functions.recode import ATTENDANCE, attendance_status, capped_age, known_gender
from wardcast.operators.fill import fill_down_up
from wardcast.operators.lookup import flag_membership, join_lookup
from wardcast.operators.skew import BIG_KEY_ROWS, big_keys
from wardcast.sources.stages import Stage


def baseline_contacts(contacts: DataFrame, baseline_fy: str, c: Cols = COLS) -> DataFrame:
    """Contacts of one financial year that belong to a known patient."""
    return contacts.filter(F.col(c.patient).isNotNull() & (F.col(c.fin_year) == baseline_fy))


def flag_consistent(contacts: DataFrame, submitters: DataFrame, c: Cols = COLS) -> DataFrame:
    """1 if the submitter is on the consistent list, 0 if not, missing if it has no code."""
    return flag_membership(contacts, c.submitter, submitters, c.consistent)


def tidy_contacts(
    contacts: DataFrame,
    area_district: DataFrame,
    submitters: DataFrame,
    *,
    baseline_fy: str = "2022/23",
    age_cap: int = 90,
    attendance_map: Mapping[str, Sequence[str]] = ATTENDANCE,
    big_patients: DataFrame | Sequence | None = None,
    big_patient_rows: int = BIG_KEY_ROWS,
    stage: Stage | None = None,
    c: Cols = COLS,
) -> DataFrame:
    """Select, flag and recode contacts, attach the district and fill each patient's gaps.

    Lookups are broadcast, so the only shuffle is the one that brings a
    patient's contacts together. Patients with ``big_patient_rows`` or more
    contacts are found by a count over the patient column and filled in
    pieces. Where they are known, or known not to exist, ``big_patients`` names
    them and saves that count. What has to be written on the way belongs to ``stage``.
    """
    rows = baseline_contacts(contacts, baseline_fy, c)
    if big_patients is None:
        big_patients = big_keys(rows, c.patient, big_patient_rows, stage)
    rows = rows.select(*c.regions, c.patient, c.date, c.area, c.age, c.gender,
                       c.submitter, c.attendance, c.service)
    rows = flag_consistent(rows, submitters, c).withColumns(
        {
            c.age: capped_age(F.col(c.age), age_cap),
            c.gender: known_gender(F.col(c.gender)),
            c.attendance: attendance_status(F.col(c.attendance), attendance_map),
        }
    )
    rows = join_lookup(rows, area_district.select(c.area, c.district), [c.area])
    rows = rows.drop(c.area, c.submitter)
    return fill_down_up(rows, c.patient, c.date, c.filled, big=big_patients, stage=stage)
