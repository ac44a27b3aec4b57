"""Hand-made rows for the semantics that are easy to get wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from wardcast.functions.bands import BROAD_BANDS, FINE_BANDS, band
from wardcast.functions.fy import fy_display, fy_label, fy_of_date, fy_start, fy_start_label
from wardcast.functions.measures import (
    axis_unit,
    bar_width,
    direction,
    millions,
    percent_text,
    round_even,
    signed_percent_text,
    thousands_text,
)
from wardcast.functions.recode import (
    attendance_status,
    capped_age,
    known_gender,
    recorded_service,
    region_display_name,
    service_display_name,
    sex_label,
)
from wardcast.operators import compare, counts, insights, population, prestep, quality
from wardcast.operators.clean import tidy_contacts
from wardcast.operators.fill import fill_down_up
from wardcast.operators.project import project, unmatched_counts

POPN = "year int, area_code string, age int, sex int, value double"
PATIENTS = (
    "icb22cdh string, icb22nm string, service string, patient_id long, consistent_ind int,"
    " attendance_cat int, lad18cd string, age_int int, gender_cat string, n long"
)
COUNTS = "lad18cd string, age_int int, gender_cat string, count double"


def close(actual, expected):
    assert len(actual) == len(expected)
    for a, e in zip(actual, expected):
        assert a == pytest.approx(e) if not isinstance(e, tuple) else all(
            x == pytest.approx(y) if isinstance(y, float) else x == y for x, y in zip(a, e)
        ), (a, e)


@pytest.fixture(scope="module")
def growth(spark):
    values = [(2021, 90.0), (2022, 100.0), (2023, 104.0), (2024, 108.0), (2025, 112.0)]
    popn = spark.createDataFrame([(y, "A", 40, 1, v) for y, v in values], POPN)
    return population.fy_population(popn)


@pytest.fixture(scope="module")
def shares(spark):
    regions = [(f"L{i}", "Q1") for i in (1, 2, 3, 6)] + [("L4", "Q2"), ("L5", "Q2")]
    districts = [("L1", "A"), ("L2", "A"), ("L3", "A"), ("L4", "A"), ("L5", "B")]
    return population.area_shares(
        spark.createDataFrame(regions, "lsoa11cd string, icb22cdh string"),
        spark.createDataFrame(districts, "lsoa11cd string, lad18cd string"),
    )


def test_financial_year_population_and_growth(growth):
    close(
        rows(growth, "fin_year", "fin_year_popn", "growth_coeff"),
        [("2022_23", 101.0, 1.0), ("2023_24", 105.0, 105 / 101), ("2024_25", 109.0, 109 / 101)],
    )


def test_district_shares(shares):
    assert rows(shares, "icb22cdh", "lad18cd", "proportion") == [
        ("Q1", None, 1.0), ("Q1", "A", 0.75), ("Q2", "A", 0.25), ("Q2", "B", 1.0),
    ]


def test_region_and_national_population(growth, shares):
    region = population.region_population(shares, growth)
    base = rows(region.filter("fin_year = '2022_23'"), "icb22cdh", "age_int", "proj_popn_by_fy_age")
    assert base == [("Q1", 40, 75.75), ("Q2", 40, 25.25)]
    assert rows(region.filter("fin_year IS NULL"), "icb22cdh", "proj_popn_by_fy_age") == [
        ("Q1", None), ("Q2", None),
    ]
    nation = population.national_population(growth).filter("fin_year = '2022_23'")
    assert rows(nation, "proj_popn_by_fy_age") == [(101.0,)]


def history(spark, values, schema="p long, d date, icb string, lad string"):
    return spark.createDataFrame(values, schema)


@pytest.mark.parametrize("big", [None, [1]])
def test_fill_goes_down_then_up(spark, big):
    days = [dt.date(2022, 5, d) for d in range(1, 6)]
    regions = [None, "Q1", None, "Q2", None]
    df = history(spark, [(1, d, r, "A") for d, r in zip(days, regions)])
    out = fill_down_up(df, "p", "d", ["icb", "lad"], big=big).orderBy("d")
    assert [r.icb for r in out.collect()] == ["Q1", "Q1", "Q1", "Q2", "Q2"]


@pytest.mark.parametrize("big", [None, [1]])
def test_fill_does_not_depend_on_input_order(spark, big):
    day = dt.date(2022, 5, 1)
    values = [(1, day, "Q1", None), (1, day, "Q1", "A"), (2, day, "Q3", None)]
    results = {
        tuple(rows(fill_down_up(history(spark, v), "p", "d", ["icb", "lad"], big=big)))
        for v in (values, values[::-1])
    }
    assert results == {((1, day, "Q1", "A"), (1, day, "Q1", "A"), (2, day, "Q3", None))}


def tidy(spark, values):
    schema = (
        "icb22cdh string, icb22nm string, service string, patient_id long, consistent_ind int,"
        " attendance_cat string, lad18cd string, age_int int, gender_cat string"
    )
    return spark.createDataFrame(values, schema)


def test_flags_are_raised_independently(spark):
    cell = ("A", 40, "Male")
    contacts = tidy(spark, [
        ("Q1", "One", "X", 1, 1, "Did Not Attend", *cell),
        ("Q1", "One", "X", 1, 0, "Attended", *cell),
    ])
    pc = counts.patient_counts(contacts)
    assert rows(pc, "consistent_ind", "attendance_cat", "n") == [(1, 1, 2)]
    assert counts.included_patients(pc, "region").count() == 1
    assert counts.included_contacts(counts.contact_counts(contacts), "region").count() == 0
    cells = counts.contact_cells(contacts)
    assert rows(counts.patient_counts(cells)) == rows(pc)
    assert rows(counts.contact_counts(cells)) == rows(counts.contact_counts(contacts))


def patient(region, service, district, n, pid=1, name="One"):
    return (region, name, service, pid, 1, 1, district, 40, "Male", n)


def test_service_uses_the_overall_share(spark):
    pc = spark.createDataFrame(
        [patient("Q1", "X", "A", 2), patient("Q1", "Y", "A", 1), patient("Q1", "X", "B", 1)], PATIENTS
    )
    for level in ("region", "national"):
        shares = counts.patient_lad_shares(pc, level)
        assert rows(shares, "lad18cd", "prop") == [("A", 0.75), ("B", 0.25)]
        assert rows(counts.unique_patients(pc, level), "lad18cd", "count") == [("A", 0.75), ("B", 0.25)]
        by_service = counts.unique_patients(pc, level, by_service=True)
        assert rows(by_service.groupBy("service").agg(F.sum("count"))) == [("X", 1.0), ("Y", 0.75)]


def test_region_and_nation_count_a_moved_patient_once_each(spark):
    pc = spark.createDataFrame([patient("Q1", "X", "A", 1), patient("Q2", "X", "A", 3)], PATIENTS)
    assert rows(counts.unique_patients(pc, "region"), "icb22cdh", "count") == [("Q1", 1.0), ("Q2", 1.0)]
    assert rows(counts.unique_patients(pc, "national"), "count") == [(1.0,)]


def test_patient_without_region(spark):
    pc = spark.createDataFrame([patient(None, "X", "A", 1, name=None)], PATIENTS)
    assert rows(counts.unique_patients(pc, "national"), "count") == [(1.0,)]
    assert rows(quality.patients_dq(pc, "national"), "all_unfiltd", "missing_icb", "final_count") == [(1, 1, 0)]
    assert counts.unique_patients(pc, "region").count() == 0


def test_region_without_name_has_no_share(spark):
    pc = spark.createDataFrame([patient("Q1", "X", "A", 1, name=None)], PATIENTS)
    assert rows(counts.unique_patients(pc, "region"), "icb22cdh", "count") == [("Q1", None)]


def test_counts_without_growth_stay_visible(spark, growth):
    df = spark.createDataFrame([("A", 40, "Male", 10.0), (None, 40, "Male", 5.0)], COUNTS)
    out = project(df, growth)
    close(
        rows(out, "fin_year", "age_int", "projected_count"),
        [(None, 40, None), ("2022_23", 40, 10.0), ("2023_24", 40, 1050 / 101), ("2024_25", 40, 1090 / 101)],
    )
    assert project(df, growth, unmatched="drop").filter("fin_year IS NULL").count() == 0
    assert rows(unmatched_counts(df, growth)) == [(15.0, 5.0)]
    with pytest.raises(ValueError):
        project(df, growth, unmatched="hide")


def test_zero_base_population(spark):
    popn = spark.createDataFrame(
        [(2022, "A", 1, 1, 0.0), (2023, "A", 1, 1, 0.0), (2024, "A", 1, 1, 4.0)], POPN
    )
    g = population.fy_population(popn)
    assert rows(g, "fin_year", "growth_coeff") == [("2022_23", None), ("2023_24", None)]
    assert rows(population.undefined_growth(g)) == [("A", 1, "Male")]
    df = spark.createDataFrame([("A", 1, "Male", 3.0)], COUNTS)
    assert rows(project(df, g), "fin_year", "projected_count") == [("2022_23", None), ("2023_24", None)]


def test_age_bands(spark):
    ages = [0, 1, 4, 5, 17, 18, 34, 35, 49, 50, 64, 65, 74, 75, 84, 85, 90, None]
    df = spark.createDataFrame([(a,) for a in ages], "age int")
    fine = dict(rows(df.groupBy(band(F.col("age"), FINE_BANDS)).count()))
    assert fine == {"0": 1, "1-4": 2, "5-17": 2, "18-34": 2, "35-49": 2, "50-64": 2, "65-74": 2,
                    "75-84": 2, "85+": 3}
    broad = dict(rows(df.groupBy(band(F.col("age"), BROAD_BANDS)).count()))
    assert broad == {"0-4": 3, "5-17": 2, "18-64": 6, "65-84": 4, "85+": 3}
    other = dict(rows(df.groupBy(band(F.col("age"), BROAD_BANDS, null_age="Unknown")).count()))
    assert other["Unknown"] == 1 and other["85+"] == 2


def one(spark, **columns):
    return tuple(spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first())


def test_rounding_and_texts(spark):
    assert one(
        spark,
        a=round_even(F.lit(0.25), 1), b=round_even(F.lit(2.5), 0), c=round_even(F.lit(1250000.0), -5),
        d=millions(F.lit(54944338.0)), e=thousands_text(F.lit(1234567.0)), f=percent_text(F.lit(0.12)),
        g=percent_text(F.lit(0.1254)), h=signed_percent_text(F.lit(0.031)), i=signed_percent_text(F.lit(-0.031)),
        j=direction(F.lit(0.0)), k=axis_unit(F.lit(999999.0)), l=axis_unit(F.lit(1e6)),
        m=bar_width(F.lit(1.0), F.lit(4.0)),
    ) == (0.2, 2.0, 1200000.0, 54.9, "1,235,000", "12%", "12.5%", "+3.1%", "-3.1%", "level", "k", "m", 20.0)


def test_service_and_region_names(spark):
    names = ["Adult's Nursing Service", "Children's Therapy Service", "A Service Service", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, s string").orderBy("i")
    shown = service_display_name(recorded_service(F.col("s")))
    assert [r[0] for r in df.select(shown).collect()] == [
        "Adults Nursing", "Children Therapy", "A Service", "Not recorded",
    ]
    assert one(
        spark,
        a=region_display_name(F.lit("NHS Mid Sussex Integrated Care Board")),
        b=region_display_name(F.lit("Other")),
    ) == ("Mid Sussex ICB", "Other")


def test_recodes(spark):
    codes = spark.createDataFrame([(str(i),) for i in range(2, 9)] + [(None,)], "x string")
    assert dict(rows(codes.select("x", attendance_status(F.col("x"))))) == {
        "2": "Cancelled", "3": "Did Not Attend", "4": "Cancelled", "5": "Attended", "6": "Attended",
        "7": "Did Not Attend", "8": "Unknown", None: "Unknown",
    }
    ages = spark.createDataFrame([("91",), ("90",), ("x",), (None,)], "a string")
    assert rows(ages.select("a", capped_age(F.col("a")))) == [(None, None), ("90", 90), ("91", 90), ("x", None)]
    assert one(spark, a=known_gender(F.lit("Unknown")), b=known_gender(F.lit("Male")),
               c=sex_label(F.lit(1)), d=sex_label(F.lit(2)), e=sex_label(F.lit(None).cast("int"))) == (
        None, "Male", "Male", "Female", None)


def test_financial_years(spark):
    assert one(
        spark,
        a=fy_label(F.lit(2099)), b=fy_of_date(F.lit(dt.date(2023, 3, 31))), c=fy_start(F.lit("2022_23")),
        d=fy_start_label(F.lit(dt.date(2022, 4, 1))), e=fy_display(F.lit("2022_23")),
        f=fy_of_date(F.lit(dt.date(2023, 4, 1))),
    ) == ("2099_00", "2022/23", dt.date(2022, 4, 1), "2022/23", "2022/23", "2023/24")


def mart(spark, data=(), services=(), region=None):
    """A published table of one region (or of the nation) from (year, ..) rows."""
    keys = {"icb22cdh": region, "icb22nm": f"{region} ICB"} if region else {}
    row = {**keys, "data": list(data), "service_data": list(services)}
    schema = ", ".join(f"{k} string" for k in keys) + (", " if keys else "") + (
        "data array<struct<fin_year:string,age_int:int,projected_count:double,proj_popn_by_fy_age:double>>,"
        " service_data array<struct<service:string,fin_year:string,projected_count:double>>"
    )
    return spark.createDataFrame([row], schema)


def both_years(label, base, horizon):
    return [(label, "2022_23", base), (label, "2042_43", horizon)]


def test_tied_largest_changes_are_all_kept(spark):
    values = [(0, 100.0, 110.0), (3, 200.0, 220.0), (50, 100.0, 105.0)]
    data = [r for a, b, h in values for r in (("2022_23", a, b, 1.0), ("2042_43", a, h, 1.0))]
    out = compare.top_age_change(mart(spark, data, region="Q1"))
    close(rows(out, "age_group", "pct_change"), [("0", 10.0), ("1-4", 10.0)])


def test_sums_with_a_missing_part_are_missing(spark):
    values = {"2022_23": (100.0, 50.0, None), "2032_33": (100.0, 50.0, 10.0), "2042_43": (100.0, 50.0, 60.0)}
    data = [(fy, age, v, 1.0) for fy, own in values.items() for age, v in zip((10, 70, 88), own)]
    nation = mart(spark, data)
    older = rows(compare.age_share_summary(nation).select("fin_year", "older_count").distinct())
    assert older == [("2022_23", None), ("2032_33", 60.0), ("2042_43", 110.0)]
    facts = insights.national_facts({"contacts": nation}).first()
    assert facts["baseline_millions"] is None and facts["pct_change"] is None
    assert facts["baseline_older_millions"] is None and facts["horizon_older_pct"] is not None
    assert compare.headline(nation).filter("horizon = '2042_43'").first()["pct_change"] is None


def test_incomplete_services_are_not_compared(spark):
    nation = mart(spark, services=both_years("X", 100.0, 120.0) + both_years("Y", 50.0, 50.0))
    region = mart(spark, services=both_years("X", 10.0, 13.0) + [("Y", "2022_23", 5.0)], region="Q1")
    out = compare.service_comparison(region, nation)
    close(rows(out, "service", "icb", "eng", "relative_to_national", "relative_text", "icb_bar"),
          [("X", 0.3, 0.2, 0.1, "+10%", 80.0)])
    assert rows(compare.change_by_service(region, nation), "type", "service") == [
        ("England", "X"), ("Q1 ICB", "X"),
    ]
    assert compare.service_comparison(region, nation, page=2).count() == 0


def test_services_that_clean_to_one_name_are_added(spark):
    services = both_years("X", 10.0, 20.0) + both_years("X Service", 30.0, 30.0)
    region, nation = mart(spark, services=services, region="Q1"), mart(spark, services=services)
    assert rows(compare.change_by_service(region, nation), "type", "change_frac") == [
        ("England", 0.25), ("Q1 ICB", 0.25),
    ]
    assert rows(compare.top_service_change(region), "service", "pct_change") == [("X", 25.0)]


def test_missing_service_cannot_be_the_top_one(spark):
    services = both_years(None, 1.0, 9.0) + both_years("X", 10.0, 11.0)
    out = compare.top_service_change(mart(spark, services=services, region="Q1"))
    close(rows(out, "service", "pct_change"), [("X", 10.0)])


CONTACTS = (
    "fin_year string, icb22cdh string, icb22nm string, patient_id long, contact_date date,"
    " lsoa11cd string, age_int string, gender_cat string, submitter_id string,"
    " attendance_cat string, service string"
)


def contact(**changes):
    row = dict(fin_year="2022/23", icb22cdh="Q1", icb22nm="One", patient_id=1,
               contact_date=dt.date(2022, 5, 1), lsoa11cd="L1", age_int="40", gender_cat="Male",
               submitter_id="S1", attendance_cat="5", service="X")
    return tuple({**row, **changes}.values())


def test_missing_submitter_is_neither_consistent_nor_inconsistent(spark):
    contacts = spark.createDataFrame(
        [contact(submitter_id=None), contact(patient_id=None), contact(fin_year="2021/22")], CONTACTS
    )
    lads = spark.createDataFrame([("L1", "A")], "lsoa11cd string, lad18cd string")
    subs = spark.createDataFrame([("S1",)], "provider_org_id string")
    out = tidy_contacts(contacts, lads, subs)
    assert rows(out, "patient_id", "consistent_ind", "lad18cd") == [(1, None, "A")]
    cc = counts.contact_counts(out)
    assert counts.included_contacts(cc, "national").count() == 0
    dq = quality.contacts_dq(cc, "national")
    assert rows(dq, "all_unfiltd", "inconsistnt", "missing_age") == [(1, None, 0)]


def test_consistent_submitters_need_every_month(spark):
    def year(code, absent=None):
        dates = [dt.date(2022 + (m < 4), m, 10) for m in range(1, 13)]
        return [contact(submitter_id=code, contact_date=d, attendance_cat="3" if d.month == absent else "6")
                for d in dates]

    contacts = spark.createDataFrame(year("S1") + year("S2", absent=7) + year("S3")[:11], CONTACTS)
    found = prestep.consistent_submitters(contacts)
    assert rows(found) == [("S1",)]
    assert rows(prestep.coverage(contacts, found)) == [(34, 12, 35.3)]


def test_latest_submission_wins(spark):
    df = spark.createDataFrame(
        [(1, "primary", 1, "a"), (1, "refresh", 2, None), (2, "primary", 1, "b")],
        "key int, stage string, version int, value string",
    )
    out = prestep.latest_submission(df, ["key"], ["version"])
    assert rows(out) == [(1, "refresh", 2, None), (2, "primary", 1, "b")]


def test_age_at_first_contact(spark):
    contacts = spark.createDataFrame(
        [contact(age_int=None), contact(contact_date=dt.date(2022, 6, 1), age_int="41"),
         contact(contact_date=dt.date(2022, 7, 1), age_int="40"), contact(patient_id=2, age_int=None),
         contact(contact_date=None, age_int="1"), contact(patient_id=3, contact_date=None, age_int="9")],
        CONTACTS,
    )
    assert rows(prestep.age_at_first_contact(contacts)) == [(1, 41), (2, None), (3, 9)]
    dirty = spark.createDataFrame(
        [contact(contact_date=dt.date(2022, 5, 1), age_int="20000"), contact(contact_date=dt.date(2022, 5, 2), age_int="40"),
         contact(patient_id=2, contact_date=dt.date(1960, 5, 1), age_int="-7"), contact(patient_id=2, age_int="3")],
        CONTACTS,
    )
    assert rows(prestep.age_at_first_contact(dirty)) == [(1, 20000), (2, -7)]


def test_quality_exclusions(spark):
    df = spark.createDataFrame(
        [(1, "40", "Male", "A"), (None, "116", "Unknown", None), (2, None, None, "A")],
        "patient_id long, age_int string, gender_cat string, lad18cd string",
    )
    out = prestep.quality_exclusions(df)
    assert [r.reasons for r in out.orderBy(F.size("reasons")).collect()] == [
        [], ["no gender", "no age"], ["no patient", "no gender", "age too high", "no district"],
    ]
