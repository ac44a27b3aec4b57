"""Reading, writing, nesting, and what must hold between results."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from conftest import plan, rows
from wardcast.columns import COLS, LEVELS, MEASURES, Cols
from wardcast.operators import compare, counts, population
from wardcast.operators.clean import tidy_contacts
from wardcast.operators.nest import age_data, nest, service_data
from wardcast.plans import catalog, fixtures, marts
from wardcast.sources import files, tables
from wardcast.sources.contract import Field, by_contract
from wardcast.sources import marts as store

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def space(spark):
    return catalog.workspace(spark, SF_DIR)


def total(df, column):
    return df.agg(F.sum(column)).first()[0]


# --- sources --------------------------------------------------------------


def test_population_variant_prunes_folders(spark, tmp_path):
    popn = fixtures.population(fixtures.StarTables(spark, SF_DIR)).limit(50)
    for variant, factor in (("principal_proj", 1), ("high", 2)):
        popn.withColumn("value", F.col("value") * factor).write.parquet(f"{tmp_path}/projection={variant}")
    (tmp_path / "projection=broken").mkdir()
    (tmp_path / "projection=broken" / "a.parquet").write_text("not to be opened")
    out = tables.load_population(spark, str(tmp_path))
    assert out.count() == 50
    assert {f.split("projection=")[1].split("/")[0] for f in out.inputFiles()} == {"principal_proj"}
    with pytest.raises(ValueError):
        tables.load_population(spark, str(tmp_path), "../other")


def test_contract_sets_rows_aside_with_reasons(spark, tmp_path):
    path = str(tmp_path / "raw")
    df = spark.createDataFrame(
        [("1", "2022-05-01", "x"), ("P2", "2022-05-02", "y"), ("3", None, "z"), ("bad", "31/12/2022", None), (None, "2022-05-03", "w")],
        "id string, `seen on` string, rest string",
    )
    df.write.parquet(path)
    fields = [Field("patient", "id", "bigint"), Field("day", "seen on", "date", True), Field("rest", "rest")]
    checked = by_contract(spark.read.parquet(path), fields)
    assert checked.rows.dtypes == [("patient", "bigint"), ("day", "date"), ("rest", "string")]
    assert rows(checked.rows) == [(None, dt.date(2022, 5, 3), "w"), (1, dt.date(2022, 5, 1), "x")]
    assert rows(checked.rejects, "id", "reasons") == [
        ("3", ["day: missing"]), ("P2", ["patient: not a bigint"]), ("bad", ["patient: not a bigint", "day: not a date"]),
    ]
    assert dict(rows(checked.counts())) == {
        None: 2, "day: missing": 1, "patient: not a bigint": 2, "day: not a date": 1,
    }
    assert by_contract(df.limit(0), fields).rows.count() == 0
    with pytest.raises(ValueError, match="missing columns: nowhere"):
        by_contract(df, [Field("a", "nowhere")])


def test_contacts_are_renamed_and_pruned(spark, tmp_path):
    path = str(tmp_path / "contacts")
    mapping = {"patient_id": "Person_ID", "fin_year": "Year"}
    fixtures.contacts(fixtures.StarTables(spark, SF_DIR)).select(
        "*", F.lit(1).alias("unused")
    ).withColumnsRenamed(mapping).write.parquet(path)
    out = tables.load_contacts(spark, path, mapping)
    assert "patient_id" in out.columns and "unused" not in out.columns
    first = out.filter("fin_year = '2022/23'").select("patient_id")
    assert re.search(r"PushedFilters: \[.*EqualTo\(Year,2022/23\)", plan(first))
    assert "service" not in plan(first).split("ReadSchema")[-1]
    with pytest.raises(ValueError, match="fin_year: missing"):
        tables.load_contacts(spark, path, None)


def test_contacts_are_dealt_by_rows(spark, monkeypatch):
    """A task's share of contacts does not grow with the table, however few shuffle parts the session has."""
    monkeypatch.setattr(fixtures, "TASK_ROWS", 300, raising=False)
    contacts = fixtures.contacts(fixtures.StarTables(spark, SF_DIR))
    sizes = contacts.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(r["count"] for r in sizes) < 600


def test_lookup_columns_by_name(spark, tmp_path):
    path = str(tmp_path / "lookup")
    spark.createDataFrame([("L1", "Q1", "One", 1)], "LSOA11CD string, icb22cdh string, icb22nm string, n int"
                          ).write.parquet(path)
    assert tables.load_area_lookup(spark, path).columns == ["LSOA11CD", "icb22cdh"]
    assert tables.load_area_lookup(spark, path, "cd$").columns == ["LSOA11CD"]


def test_region_codes_stay_strings_and_prune(spark, tmp_path, space):
    mart = marts.build_mart(space.base, "contacts", "region")
    code = F.when(F.col("icb22cdh") == "Q1", "42D").when(F.col("icb22cdh") == "Q2", "010").otherwise(F.col("icb22cdh"))
    mart = mart.withColumn("icb22cdh", code).persist()
    store.write_mart(mart, str(tmp_path), "Contacts", "region")
    back = store.read_mart(spark, str(tmp_path), "contacts", "region")
    assert {"42D", "010"} <= {r.icb22cdh for r in back.collect()}
    assert rows(age_data(back).drop("icb22nm")) == rows(age_data(mart).drop("icb22nm"))
    assert all(r.icb22nm.endswith(" ICB") for r in back.collect())
    one = store.one_region(back, "42D")
    assert re.search(r"PartitionFilters: \[.*icb22cdh.* = 42D", plan(one))
    assert one.count() == 1


def test_shared_folder_is_the_one_the_session_names(spark):
    assert store.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert store.Stage(spark).root.startswith(spark.conf.get("spark.checkpoint.dir"))


def folders(spark, prefix="stage-"):
    return {n for n in files.names(spark, store.shared_folder(spark)) if n.startswith(prefix)}


def test_publish_writes_four_tables_and_leaves_nothing_else(spark, tmp_path, space):
    inputs = fixtures.inputs(fixtures.StarTables(spark, SF_DIR))
    inputs.contacts.limit(0).count()
    before, tables_before = folders(spark), len(spark.catalog.listTables())
    paths = marts.publish(spark, inputs, str(tmp_path), big_patient_rows=20)
    assert folders(spark) == before and len(spark.catalog.listTables()) == tables_before
    assert len(paths) == 4
    for measure in MEASURES:
        assert store.read_mart(spark, str(tmp_path), measure, "national").count() == 1
        assert store.read_mart(spark, str(tmp_path), measure, "region").count() == 5


# --- nesting --------------------------------------------------------------


def test_nest_and_open_is_identity(spark):
    values = [("Q1", "n", "2022_23", 1, 1.0, 2.0), ("Q1", "n", None, 3, None, None), ("Q2", "m", "2023_24", 0, 4.0, 5.0)]
    names = ["icb22cdh", "icb22nm", "fin_year", "age_int", "projected_count", "proj_popn_by_fy_age"]
    df = spark.createDataFrame(values, "icb22cdh string, icb22nm string, fin_year string, age_int int,"
                                       " projected_count double, proj_popn_by_fy_age double")
    nested = nest(df, names[:2], names[2:], ["fin_year", "age_int"], "data")
    assert rows(age_data(nested)) == rows(df)
    assert nested.filter("icb22cdh = 'Q1'").first().data[-1].fin_year is None


# --- what must hold -------------------------------------------------------


def test_growth_starts_at_one(space):
    base = space.base.fy_population.filter("fin_year = '2022_23'")
    assert base.filter("growth_coeff <> 1").count() == 0 and base.count() > 0


def test_district_shares_sum_to_one(space):
    shares = population.area_shares(space.inputs.area_region, space.inputs.area_district)
    sums = shares.groupBy("lad18cd").agg(F.sum("proportion").alias("s"))
    assert sums.filter("abs(s - 1) > 1e-9").count() == 0


def test_patient_shares_sum_to_one(space):
    for level, keys in (("region", ["icb22cdh", "patient_id"]), ("national", ["patient_id"])):
        sums = counts.patient_lad_shares(space.base.patient_counts, level).groupBy(*keys).agg(F.sum("prop").alias("s"))
        assert sums.filter("abs(s - 1) > 1e-9").count() == 0


def test_quality_counts_add_up(space):
    for measure in MEASURES:
        for level in LEVELS:
            head = COLS.prefix(measure, level)
            mart = space.mart(measure, level)
            wrong = f"{head}all_unfiltd <> {head}total_excld + {head}final_count"
            assert mart.filter(wrong).count() == 0


def test_region_population_adds_up_to_the_nation(space):
    region = space.base.region_population.filter("fin_year IS NOT NULL")
    assert total(region, "proj_popn_by_fy_age") == pytest.approx(
        total(space.base.national_population, "proj_popn_by_fy_age")
    )


def test_region_contacts_add_up_to_england(space):
    sums = [total(compare.total_by_year(space.mart("contacts", lv)), "projected_count") for lv in LEVELS]
    assert sums[0] == pytest.approx(sums[1])


def test_projected_base_year_is_the_matched_count(space):
    cc = counts.included_contacts(space.base.contact_counts, "national")
    cells = space.base.fy_population.select(*COLS.person).distinct()
    matched = total(cc.join(cells, COLS.person), "count")
    base = compare.total_by_year(space.mart("contacts", "national"), "2022_23").first().projected_count
    assert base == pytest.approx(matched) == pytest.approx(277.0)


def test_reference_points(space):
    totals = {r.fin_year: r.projected_count for r in compare.total_by_year(space.mart("contacts", "national")).collect()}
    assert totals["2023_24"] == pytest.approx(279.503, abs=5e-4)
    assert totals["2042_43"] == pytest.approx(327.06, abs=5e-3)


# --- plans ----------------------------------------------------------------


def test_one_shuffle_of_contacts_up_to_patient_counts(space):
    tidy = tidy_contacts(space.inputs.contacts, space.inputs.area_district, space.inputs.submitters)
    text = plan(counts.patient_counts(counts.contact_cells(tidy)))
    assert len(re.findall(r"Exchange hashpartitioning\(patient_id", text)) == 1
    # the others are below the broadcast lookups
    above = text[: text.index("BroadcastHashJoin")]
    assert above.count("Exchange") == 1
    assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_only_the_baseline_year_is_scanned(space):
    tidy = tidy_contacts(space.inputs.contacts, space.inputs.area_district, space.inputs.submitters)
    scan = next(x for x in plan(tidy).splitlines() if "FileScan" in x and "fin_year" in x)
    assert re.search(r"PartitionFilters: \[.*fin_year.* = 2022/23", scan)
    assert "IsNotNull(patient_id)" in scan


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_query_multiplies_rows_or_runs_python(space, name):
    text = plan(catalog.QUERIES[name](space))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInPandas"):
        assert node not in text, node


# --- names ----------------------------------------------------------------


def test_columns_can_be_named_otherwise(spark):
    c = Cols(region="region_code", region_name="region", district="district", area="zone", patient="person",
             age="age", gender="sex", service="team", date="seen", fin_year="fy")
    contacts = spark.createDataFrame(
        [("2022/23", "R1", "One", 7, dt.date(2022, 5, 1), "Z1", "40", "Male", "S1", "5", "X")],
        "fy string, region_code string, region string, person long, seen date, zone string, age string, sex string,"
        " submitter_id string, attendance_cat string, team string",
    )
    zones = spark.createDataFrame([("Z1", "A")], "zone string, district string")
    subs = spark.createDataFrame([("S1",)], "provider_org_id string")
    popn = spark.createDataFrame([(2022, "A", 40, 1, 10.0), (2023, "A", 40, 1, 20.0)],
                                 "year int, area_code string, age int, sex int, value double")
    inputs = marts.Inputs(contacts, spark.createDataFrame([("Z1", "R1")], "zone string, region_code string"),
                          zones, subs, popn)
    base = marts.base_tables(inputs, c=c, big_patients=[])
    for measure in MEASURES:
        mart = marts.build_mart(base, measure, "region", c)
        assert rows(service_data(mart, c), "team", "fy", "projected_count") == [("X", "2022_23", 1.0)]
    with pytest.raises(ValueError):
        c.level_keys("planet")


def test_marts_join_growth_once_and_open_years_after_the_sum(space):
    for measure in MEASURES:
        for level in LEVELS:
            text = plan(marts.build_mart(space.base, measure, level))
            assert text.count("growths:array<double>") == 1, (measure, level)
            # Years become rows above the sums by region, and nothing else multiplies rows.
            assert text.count("Generate inline") == 1 == text.count("Generate")
            opened, joined = text.index("Generate inline"), text.index("growths#")
            assert opened < text.rindex("HashAggregate") and "HashAggregate" in text[opened:joined]


def test_one_patient_shuffle_for_both_levels(space):
    loose = space.spark.read.parquet(f"{space.stage.root}/patient_counts")  # the files, without their clustering
    both = counts.patient_shares_both(loose)
    for df in (both, *[counts.shares_of_level(both, level) for level in LEVELS]):
        assert len(re.findall(r"Exchange hashpartitioning\([^)]*patient_id", plan(df))) == 1
    for level in LEVELS:
        assert plan(counts.patient_lad_shares(loose, level)).count("Exchange") == 1
    for level in LEVELS:
        ours = counts.shares_of_level(both, level)
        assert rows(ours) == rows(space.base.patient_shares[level].select(*ours.columns))
