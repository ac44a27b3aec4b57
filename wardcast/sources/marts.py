"""Writing and reading the published tables, version by version."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcast.columns import COLS, Cols, check_measure
from wardcast.functions.recode import region_display_name
from wardcast.sources import files
from wardcast.sources.schemas import mart_schema
from wardcast.sources.stages import Stage, shared_folder

__all__ = ["Stage", "mart_path", "one_region", "read_mart", "shared_folder", "versions", "write_mart"]

#: The file beside the versions that names the one in force.
MANIFEST = "_published.json"


def mart_path(root: str, measure: str, level: str, c: Cols = COLS) -> str:
    return f"{root}/{c.prefix(measure, level)}final"


def versions(spark: SparkSession, root: str, measure: str, level: str, c: Cols = COLS) -> list[str]:
    """Versions of a published table, the oldest first; the last is in force."""
    found = files.read_json(spark, f"{mart_path(root, measure, level, c)}/{MANIFEST}")
    return found["versions"] if found else []


def write_mart(
    mart: DataFrame,
    root: str,
    measure: str,
    level: str,
    c: Cols = COLS,
    *,
    display_name: Callable[[Column], Column] = region_display_name,
    keep: int = 2,
) -> str:
    """Publish a table: regions by code folder, with their display names.

    The table is written whole into a folder of its own; then one small file is replaced, which names the version
    in force. Until then, and if the write fails, readers open the version before. The last ``keep`` versions
    stay, so that a reader who has opened one can finish; older ones, and remains of failed writes, are
    removed. One job at a time publishes a table. ``display_name`` turns a region's name into the one shown.
    """
    spark, path = mart.sparkSession, mart_path(root, measure, level, c)
    if keep < 1:
        raise ValueError("the version in force has to stay")
    version = f"v{datetime.now(timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    if level == "region":
        named = mart.withColumn(c.region_name, display_name(F.col(c.region_name)))
        named.write.partitionBy(c.region).parquet(f"{path}/{version}")
    else:
        mart.write.parquet(f"{path}/{version}")
    kept = [*versions(spark, root, measure, level, c), version][-keep:]
    files.write_json(spark, f"{path}/{MANIFEST}", {"versions": kept})
    for name in files.names(spark, path):
        if name != MANIFEST and name not in kept:
            files.remove(spark, f"{path}/{name}")
    return path


def read_mart(
    spark: SparkSession, root: str, measure: str, level: str, c: Cols = COLS, *, version: str | None = None
) -> DataFrame:
    """Lazily open a published table, the version in force unless another is named.

    A filter on the region code prunes folders. The schema is given, so a code such as ``010`` is not read as a number.
    """
    check_measure(measure)
    known = versions(spark, root, measure, level, c)
    if not known or version is not None and version not in known:
        raise ValueError(f"not published: {mart_path(root, measure, level, c)}, version {version or 'in force'}")
    path = f"{mart_path(root, measure, level, c)}/{version or known[-1]}"
    schema = mart_schema(measure, level, c)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def one_region(mart: DataFrame, code: str, c: Cols = COLS) -> DataFrame:
    return mart.filter(F.col(c.region) == code)
