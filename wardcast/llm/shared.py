"""What several operators of this folder use: tables, staging, words, tokenizer files."""

from __future__ import annotations

import base64
import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcast.sources.marts import shared_folder

#: ASCII white space as the contracts define it.
SPACE = "[\\x20\\x09-\\x0D]+"
VOCABULARIES = "/opt/tokenizers"
#: Split pattern of the byte-level vocabularies (fixed value of the public files).
PATTERN_FILE = "__init__.py"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later work restarts from there."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores added until ``df`` has no such column (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8, split at ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "replace").lower().split() if text else []


@lru_cache(maxsize=4)
def encoding(path: str):
    """A tiktoken encoding from a rank file; ``path`` must exist on every executor."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(path, pat_str=split_pattern(path), mergeable_ranks=ranks, special_tokens={})


def split_pattern(path: str) -> str:
    """The split pattern that lies beside a rank file, as ``PATTERN``."""
    with open(f"{path.rpartition('/')[0]}/{PATTERN_FILE}") as file:
        found = re.search(r"^PATTERN\s*=\s*(.+)$", file.read(), re.M)
    if not found:
        raise ValueError(f"no PATTERN beside {path}")
    import ast

    return ast.literal_eval(found[1])


_shipped: set[str] = set()


def ship() -> None:
    """Hand the package to the executors' Python, unless it is on the path that they get anyway."""
    spark, root = SparkSession.active(), Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    to = Path(tempfile.mkdtemp(prefix="wardcast-code-")) / "wardcast.zip"  # the driver serves it from there
    with zipfile.ZipFile(to, "w") as archive:
        for file in sorted((root / "wardcast").rglob("*.py")):
            archive.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(to))
    _shipped.add(app)


@lru_cache(maxsize=1)
def trimmer() -> Callable | None:
    """The C library's call that gives free memory back; None where it has none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return what Arrow and the C library hold free: a Python worker lives on between tasks, beside those that work."""
    pa.default_memory_pool().release_unused()
    if trim := trimmer():
        trim(0)


def fields_udf(function: Callable, returns: str, *fixed) -> Callable:
    """A pandas UDF of one column that gives several: ``function(*fixed, values)`` returns a frame."""

    ship()

    def fields(values: pd.Series) -> pd.DataFrame:
        found = function(*fixed, values)
        give_back()
        return found

    return F.pandas_udf(fields, returns)


def value_udf(function: Callable, returns: str, *fixed) -> Callable:
    """A pandas UDF of one column: ``function(*fixed, values)`` returns a series."""

    ship()

    def value(values: pd.Series) -> pd.Series:
        found = function(*fixed, values)
        give_back()
        return found

    return F.pandas_udf(value, returns)


_made: dict[str, object] = {}


class Sent:
    """A broadcast value of bounded size, and what a Python worker makes of it, made once."""

    def __init__(self, spark: SparkSession, value):
        self.key, self.value = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    def made(self, make: Callable):
        if self.key not in _made:
            _made.clear()
            _made[self.key] = make(self.value.value)
            give_back()
        return _made[self.key]
