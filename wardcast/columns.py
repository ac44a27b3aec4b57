"""Column names used across the package.

Every operator takes a ``Cols`` so that another country's or another
supplier's naming can be used without touching the code.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Cols:
    # contacts
    fin_year: str = "fin_year"
    region: str = "icb22cdh"
    region_name: str = "icb22nm"
    patient: str = "patient_id"
    date: str = "contact_date"
    area: str = "lsoa11cd"
    age: str = "age_int"
    gender: str = "gender_cat"
    submitter: str = "submitter_id"
    attendance: str = "attendance_cat"
    service: str = "service"
    # attached while cleaning
    district: str = "lad18cd"
    consistent: str = "consistent_ind"
    # population and projection
    population: str = "fin_year_popn"
    growth: str = "growth_coeff"
    share: str = "proportion"
    age_population: str = "proj_popn_by_fy_age"
    projected: str = "projected_count"
    # prefixes of the data-quality columns in the published tables
    region_prefix: str = "icb"
    national_prefix: str = "nat"

    @property
    def regions(self) -> list[str]:
        return [self.region, self.region_name]

    @property
    def person(self) -> list[str]:
        """The cell a person is projected in: district, age and gender."""
        return [self.district, self.age, self.gender]

    @property
    def filled(self) -> list[str]:
        """Attributes completed from a patient's other contacts."""
        return [self.region, self.region_name, self.age, self.gender, self.district]

    def level_keys(self, level: str) -> list[str]:
        return self.regions if check_level(level) == "region" else []

    def prefix(self, measure: str, level: str) -> str:
        head = self.region_prefix if check_level(level) == "region" else self.national_prefix
        return f"{head}_{check_measure(measure)}_"


COLS = Cols()

LEVELS = ("region", "national")
MEASURES = ("contacts", "patients")


def check_level(level: str) -> str:
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}, not {level!r}")
    return level


def check_measure(measure: str) -> str:
    name = measure.lower()
    if name not in MEASURES:
        raise ValueError(f"measure must be one of {MEASURES}, not {measure!r}")
    return name
