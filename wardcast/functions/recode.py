"""Recodes of raw contact attributes and display names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attendance status codes of the national data dictionary.
ATTENDANCE = {
    "Attended": ("5", "6"),
    "Did Not Attend": ("3", "7"),
    "Cancelled": ("2", "4"),
}
ATTENDED, NOT_ATTENDED, CANCELLED = ATTENDANCE
UNKNOWN = "Unknown"
NOT_RECORDED = "Not recorded"
GENDERS = ("Male", "Female")


def attendance_status(code: Column, mapping: Mapping[str, Sequence[str]] = ATTENDANCE) -> Column:
    out = None
    for status, codes in mapping.items():
        hit = code.isin(*codes)
        out = F.when(hit, F.lit(status)) if out is None else out.when(hit, F.lit(status))
    return out.otherwise(F.lit(UNKNOWN))


def capped_age(age: Column, cap: int = 90) -> Column:
    """Whole years, no more than ``cap``; a missing or unreadable age stays missing."""
    years = age.try_cast("int")
    return F.when(years > cap, F.lit(cap)).otherwise(years)


def known_gender(gender: Column) -> Column:
    return F.nullif(gender, F.lit(UNKNOWN))


def sex_label(code: Column) -> Column:
    """1 is Male, any other code Female; a missing code stays missing."""
    return F.when(code == 1, F.lit("Male")).when(code.isNotNull(), F.lit("Female"))


def region_display_name(name: Column) -> Column:
    """``NHS Mid Sussex Integrated Care Board`` -> ``Mid Sussex ICB``."""
    return F.regexp_replace(name, "^(NHS )(.*)( Integ.*)$", "$2 ICB")


def replace_first(text: Column, old: str, new: str) -> Column:
    """Replace the first occurrence of a plain string (``regexp_replace`` replaces all)."""
    return F.regexp_replace(text, f"^(.*?){old}", f"$1{new}")


def service_display_name(service: Column) -> Column:
    out = replace_first(service, " Service", "")
    out = replace_first(out, "Adult's", "Adults")
    return replace_first(out, "Children's", "Children")


def recorded_service(service: Column) -> Column:
    return F.coalesce(service, F.lit(NOT_RECORDED))
