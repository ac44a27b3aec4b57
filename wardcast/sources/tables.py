"""Reading the input tables, from the catalog or from parquet folders."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcast.columns import COLS, Cols
from wardcast.sources.contract import Checked, Field, by_contract
from wardcast.sources.schemas import check_schema, contacts_schema, population_schema


def open_table(spark: SparkSession, source: str) -> DataFrame:
    """A parquet folder if ``source`` looks like a path, else a catalog table."""
    return spark.read.parquet(source) if "/" in source else spark.table(source)


def select_renamed(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Keep and rename columns; ``mapping`` is new name -> old name."""
    return df.select(*[F.col(old).alias(new) for new, old in mapping.items()])


def select_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Keep the columns whose name matches a regular expression, whatever its case."""
    return df.select(*[n for n in df.columns if re.search(pattern, n, re.IGNORECASE)])


def load_contacts(
    spark: SparkSession, source: str, mapping: Mapping[str, str] | None = None, c: Cols = COLS
) -> DataFrame:
    """Contacts with our column names; only the mapped columns are scanned."""
    df = open_table(spark, source)
    if mapping:
        df = select_renamed(df, {n: mapping.get(n, n) for n in contacts_schema(c).names})
    return check_schema(df, contacts_schema(c), loose=(c.patient, c.date, c.age))


def check_contacts(
    spark: SparkSession, source: str, mapping: Mapping[str, str] | None = None, c: Cols = COLS
) -> Checked:
    """Contacts as they come, mostly text: rows whose patient or date can't be read are set aside with reasons.

    A missing patient is allowed (cleaning leaves such contacts out), a missing date is not. Ages stay text: what is not a
    number is an unknown age.
    """
    mapping = mapping or {}
    kinds = {c.patient: "bigint", c.date: "date"}
    fields = [Field(n, mapping.get(n, n), kinds.get(n), n == c.date) for n in contacts_schema(c).names]
    return by_contract(open_table(spark, source), fields)


def load_area_lookup(spark: SparkSession, source: str, pattern: str = "(cd|cdh)$") -> DataFrame:
    return select_matching(open_table(spark, source), pattern)


def load_submitters(
    spark: SparkSession, source: str, column: str = "provider_org_id"
) -> DataFrame:
    return open_table(spark, source).select(column)


def variant_folder(spark: SparkSession, path: str, variant: str) -> DataFrame:
    """One variant of the forecasts, from its own folder: the others are neither listed nor opened."""
    if not re.fullmatch(r"[\w.-]+", variant):
        raise ValueError(f"not the name of a variant: {variant!r}")
    return spark.read.option("basePath", path).parquet(f"{path}/projection={variant}")


def load_population(
    spark: SparkSession, path: str, variant: str = "principal_proj"
) -> DataFrame:
    """One variant of the forecasts, stored as ``projection=<variant>`` folders."""
    rows = variant_folder(spark, path, variant)
    return check_schema(rows, population_schema(), loose=("year", "age", "sex", "value"))


def check_population(spark: SparkSession, path: str, variant: str = "principal_proj") -> Checked:
    """The same with rows set aside that lack a value or have one of another type."""
    kinds = {"year": "int", "age": "int", "sex": "int", "value": "double"}
    fields = [Field(n, n, kinds.get(n), True) for n in population_schema().names]
    return by_contract(variant_folder(spark, path, variant), fields)
