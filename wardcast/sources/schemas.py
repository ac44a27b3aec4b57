"""Expected schemas, checked where data enters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wardcast.columns import COLS, Cols
from wardcast.operators.quality import dq_columns


def contacts_schema(c: Cols = COLS) -> T.StructType:
    names = [c.fin_year, *c.regions, c.patient, c.date, c.area, c.age, c.gender,
             c.submitter, c.attendance, c.service]
    kinds = {c.patient: T.LongType(), c.date: T.DateType()}
    return T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])


def population_schema() -> T.StructType:
    return T.StructType(
        [
            T.StructField("year", T.IntegerType()),
            T.StructField("area_code", T.StringType()),
            T.StructField("age", T.IntegerType()),
            T.StructField("sex", T.IntegerType()),
            T.StructField("value", T.DoubleType()),
        ]
    )


def service_data_type(c: Cols = COLS) -> T.ArrayType:
    return T.ArrayType(
        T.StructType(
            [
                T.StructField(c.service, T.StringType()),
                T.StructField(c.fin_year, T.StringType()),
                T.StructField(c.projected, T.DoubleType()),
            ]
        )
    )


def data_type(c: Cols = COLS) -> T.ArrayType:
    return T.ArrayType(
        T.StructType(
            [
                T.StructField(c.fin_year, T.StringType()),
                T.StructField(c.age, T.IntegerType()),
                T.StructField(c.projected, T.DoubleType()),
                T.StructField(c.age_population, T.DoubleType()),
            ]
        )
    )


def mart_schema(measure: str, level: str, c: Cols = COLS) -> T.StructType:
    """Published table; codes are strings even where they look like numbers."""
    fields = [T.StructField(k, T.StringType()) for k in c.level_keys(level)]
    fields += [T.StructField("service_data", service_data_type(c)), T.StructField("data", data_type(c))]
    fields += [T.StructField(n, T.LongType()) for n in dq_columns(measure, level, c)]
    return T.StructType(fields)


def check_schema(df: DataFrame, expected: T.StructType, loose: tuple[str, ...] = ()) -> DataFrame:
    """Select the expected columns; raise on a missing one or on a wrong type.

    Columns in ``loose`` may have any type (patient keys, dates, ages to be cast).
    """
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: missing" for f in expected if f.name not in have]
    wrong += [
        f"{f.name}: {have[f.name].simpleString()} instead of {f.dataType.simpleString()}"
        for f in expected
        if f.name in have and f.name not in loose and have[f.name] != f.dataType
    ]
    if wrong:
        raise ValueError("unexpected schema: " + "; ".join(wrong))
    return df.select(*[f.name for f in expected])
