"""The driver's star-schema tables read as contacts, areas, submitters and population.

Line items are contacts, customers patients, suppliers submitters, part types
services; ten small areas make a nation (district), and nations make regions.
Ship dates move 24 years so that the baseline year is 2022/23. Missing and
unknown values, split districts and moves are worked in by key arithmetic.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcast.functions.fy import fy_of_date
from wardcast.plans.marts import Inputs

YEARS_AHEAD = 24
FIRST_YEAR, LAST_YEAR = 2021, 2043
OUTSIDE_LOOKUP = 24  # nation whose small areas have no district
NO_FORECAST = 23  # district without a population forecast
TOP_AGE = 90
TASK_ROWS = 500_000  # contacts that a task joins to their orders and sorts by year


class StarTables:
    """The driver's tables of one folder, each opened once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._open: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._open:
            self._open[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._open[name]


def spread(df: DataFrame) -> DataFrame:
    """Spread a table over the cores if its files make fewer tasks than there are.

    A file of one row group is one task; a table of many files stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def join_dealt(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """Join on ``key``; with more than ``TASK_ROWS`` rows a core, both sides are dealt to tasks of at most about that many.

    So a task's share does not grow with the table: neither the session's number of shuffle parts nor putting small
    parts together counts.
    """
    tasks = -(-rows // TASK_ROWS)
    if tasks > left.sparkSession.sparkContext.defaultParallelism:
        left, right = left.repartition(tasks, key), right.repartition(tasks, key)
    return left.join(right, key)


def _code(letter: str, number: Column) -> Column:
    return F.concat(F.lit(letter), number.cast("string"))


def _digit(key: Column) -> Column:
    return (key % 10).cast("int")


def small_areas(tables: StarTables) -> DataFrame:
    """Every small area: ten per nation, and wherever a customer or supplier lives."""
    nation = tables["nation"].select(
        "n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("d")
    )
    customer = tables["customer"].select(
        F.col("c_nationkey").alias("n_nationkey"), _digit(F.col("c_custkey")).alias("d")
    )
    supplier = tables["supplier"].select(
        F.col("s_nationkey").alias("n_nationkey"), _digit(F.col("s_suppkey")).alias("d")
    )
    places = reduce(DataFrame.union, [nation, customer, supplier]).distinct()
    return places.withColumn("lsoa11cd", _code("L", F.col("n_nationkey") * 10 + F.col("d")))


def area_district(tables: StarTables) -> DataFrame:
    places = small_areas(tables).filter(F.col("n_nationkey") != OUTSIDE_LOOKUP)
    return places.select("lsoa11cd", _code("E", F.col("n_nationkey")).alias("lad18cd"))


def area_region(tables: StarTables) -> DataFrame:
    """Every fourth nation gives its last two small areas to the next region."""
    regions = tables["nation"].select("n_nationkey", "n_regionkey")
    places = small_areas(tables).join(regions, "n_nationkey")
    moved = (F.col("d") >= 8) & (F.col("n_nationkey") % 4 == 0)
    region = F.when(moved, (F.col("n_regionkey") + 1) % 5).otherwise(F.col("n_regionkey"))
    return places.select("lsoa11cd", _code("Q", region).alias("icb22cdh"))


def submitters(tables: StarTables) -> DataFrame:
    rows = tables["supplier"].filter(F.col("s_suppkey") % 4 != 0)
    return rows.select(_code("S", F.col("s_suppkey")).alias("provider_org_id"))


def contacts(tables: StarTables) -> DataFrame:
    lines = spread(
        tables["lineitem"].select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"
        )
    )
    orders = tables["orders"].select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customer = tables["customer"].select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")
    )
    part = tables["part"].select(F.col("p_partkey").alias("l_partkey"), "p_type")
    supplier = tables["supplier"].select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    nation = tables["nation"].select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    region = tables["region"]
    described = lines.join(part, "l_partkey").join(supplier, "l_suppkey")
    homes = orders.join(customer, "o_custkey")
    joined = (
        join_dealt(described, homes, "l_orderkey", tables["lineitem"].count())
        .join(nation, "n_nationkey")
        .join(region, "r_regionkey")
    )
    patient, part_key, line = F.col("o_custkey"), F.col("l_partkey"), F.col("l_linenumber")
    date = F.to_date(F.add_months(F.col("l_shipdate"), 12 * YEARS_AHEAD))
    no_region = (part_key % 3 == 0) | (patient % 41 == 0)
    at_home = _code("L", F.col("n_nationkey") * 10 + patient % 10)
    away = _code("L", F.col("s_nationkey") * 10 + F.col("l_suppkey") % 10)
    even = part_key % 2 == 0
    return joined.select(
        F.when(part_key % 97 != 0, patient).alias("patient_id"),
        fy_of_date(date).alias("fin_year"),
        date.alias("contact_date"),
        F.when(part_key % 5 == 0, away).otherwise(at_home).alias("lsoa11cd"),
        F.when(~no_region, _code("Q", F.col("r_regionkey"))).alias("icb22cdh"),
        F.when(~no_region, F.concat(F.lit("NHS "), "r_name", F.lit(" Integrated Care Board"))).alias("icb22nm"),
        F.when((line != 3) & (patient % 37 != 0), ((patient * 7) % 116).cast("string")).alias("age_int"),
        F.when((line == 5) | (patient % 43 == 0), "Unknown")
        .when(patient % 2 == 0, "Male")
        .otherwise("Female")
        .alias("gender_cat"),
        F.when(part_key % 53 != 0, _code("S", F.col("l_suppkey"))).alias("submitter_id"),
        F.when(line <= 3, "5")
        .when(line == 4, "6")
        .when(line == 5, F.when(even, "3").otherwise("7"))
        .when(line == 6, F.when(even, "2").otherwise("4"))
        .alias("attendance_cat"),
        F.when(part_key % 17 != 0,
               F.when(F.col("p_type") == "SMALL", "Children's Therapy Service")
               .when(F.col("p_type") == "LARGE", "Adult's Nursing Service")
               .otherwise(F.concat("p_type", F.lit(" Service")))).alias("service"),
    )


def population(tables: StarTables) -> DataFrame:
    """Forecast by year, district, age and sex.

    A cell's forecast follows a formula of its nation, age, sex and year, times
    one more than the customers who live there at that age and sex; so its size
    comes from the customer table while its growth does not depend on it.
    """
    people = (
        tables["customer"]
        .groupBy(
            F.col("c_nationkey").alias("n_nationkey"),
            F.least((F.col("c_custkey") * 7) % 116, F.lit(TOP_AGE)).cast("int").alias("age"),
            F.when(F.col("c_custkey") % 2 == 0, 1).otherwise(2).alias("sex"),
        )
        .agg(F.count(F.lit(1)).alias("_people"))
    )
    nations = tables["nation"].filter(
        ~F.col("n_nationkey").isin(NO_FORECAST, OUTSIDE_LOOKUP)
    )
    cells = nations.select(
        "n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(TOP_AGE))).alias("age")
    ).select("*", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("sex"))
    cells = cells.join(people, ["n_nationkey", "age", "sex"], "left").withColumn(
        "_size", F.coalesce("_people", F.lit(0)) + 1
    )
    rows = cells.select("*", F.explode(F.sequence(F.lit(FIRST_YEAR), F.lit(LAST_YEAR))).alias("year"))
    nation, age, sex, step = F.col("n_nationkey"), F.col("age"), F.col("sex"), F.col("year") - FIRST_YEAR
    level = 500 + nation * 11 + (TOP_AGE - age) * 7 + (sex - 1) * 13
    drift = step * (age - 30) * F.lit(0.25)
    return rows.select(
        "year",
        _code("E", nation).alias("area_code"),
        "age",
        "sex",
        ((level + drift) * F.col("_size")).cast("double").alias("value"),
    )


def inputs(tables: StarTables) -> Inputs:
    return Inputs(
        contacts=contacts(tables),
        area_region=area_region(tables),
        area_district=area_district(tables),
        submitters=submitters(tables),
        population=population(tables),
    )
