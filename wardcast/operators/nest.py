"""Nested columns of the published tables: building them and opening them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.columns import COLS, Cols


def nested(fields: Sequence[str], order: Sequence[str], only: Column | None = None) -> Column:
    """The ``fields`` of a group's rows as a sorted array of structs, missing values last; of ``only`` some rows, if given.

    Meant for rows already summed to the grain of the fields (one per year and
    age, one per service and year), so an array has as many entries as those
    have combinations, however many contacts stand behind them.
    """
    sort = [x for o in order for x in (F.col(o).isNull().alias(f"_{o}"), F.col(o).alias(f"_v_{o}"))]
    entry = F.struct(*sort, F.struct(*fields).alias("entry"))
    collected = F.collect_list(entry if only is None else F.when(only, entry))
    return F.transform(F.array_sort(collected), lambda e: e["entry"])


def nest(
    rows: DataFrame, keys: Sequence[str], fields: Sequence[str], order: Sequence[str], name: str
) -> DataFrame:
    """One row per key with its ``fields`` as an array (see ``nested``)."""
    return rows.groupBy(*keys).agg(nested(fields, order).alias(name))


def age_data(mart: DataFrame, c: Cols = COLS) -> DataFrame:
    """Rows of ``data``: year, age, projected count and population, with the region keys."""
    return mart.select(*[k for k in c.regions if k in mart.columns], F.inline("data"))


def service_data(mart: DataFrame, c: Cols = COLS) -> DataFrame:
    """Rows of ``service_data``: service, year and projected count, with the region keys."""
    return mart.select(*[k for k in c.regions if k in mart.columns], F.inline("service_data"))


def as_map(rows: DataFrame, key: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Two columns as one map per group; for short result tables."""
    pairs = F.array_sort(F.collect_list(F.struct(key, value)))
    return rows.filter(F.col(key).isNotNull()).groupBy(*by).agg(
        F.map_from_entries(pairs).alias("values")
    )
