"""Finding keys that hold very many rows, and spreading them in a join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardcast.operators.size import fits
from wardcast.sources.stages import Stage

# A key is big from this many rows on: more than one task should sort.
BIG_KEY_ROWS = 2_000_000


def big_keys(
    rows: DataFrame, key: str | Column, min_rows: int = BIG_KEY_ROWS, stage: Stage | None = None
) -> DataFrame:
    """(_key, _n) of every key with at least ``min_rows`` rows, however many there are.

    Reads the key only and counts map-side before the shuffle. The table is written
    down, so that it is counted once; it has at most one row per ``min_rows`` rows.
    """
    value = F.col(key) if isinstance(key, str) else key
    counts = rows.groupBy(value.alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    big = counts.filter((F.col("_n") >= min_rows) & F.col("_key").isNotNull())
    return (stage or Stage(rows.sparkSession)).scratch(big, "big_keys")


def known_keys(rows: DataFrame, key: str, values: Sequence) -> DataFrame:
    """A table like that of ``big_keys`` from keys that are known; their counts are left at 1."""
    kind = rows.schema[key].dataType.simpleString()
    return rows.sparkSession.createDataFrame([(v, 1) for v in values], f"_key {kind}, _n long")


def with_big(rows: DataFrame, value: Column, big: DataFrame) -> DataFrame:
    """``rows`` with ``_n``, the count of a big key, missing for all others.

    ``big`` is broadcast if its measured size allows, else the planner splits what is skewed.
    """
    keyed = rows.withColumn("_key", value)
    return keyed.join(F.broadcast(big) if fits(big) else big, "_key", "left").drop("_key")


def key_code(keys: Sequence[str]) -> Column:
    """One number per key, the same on both sides of a join whatever their integer types."""
    return F.xxhash64(*[F.col(k).cast("string") for k in keys])


def _countable(kind: T.DataType) -> bool:
    """Can rows be grouped by a column of this type? Maps can't, nor what holds them."""
    if isinstance(kind, T.StructType):
        return all(_countable(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _countable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def _row_code(rows: DataFrame) -> Column:
    """One number for equal rows, from all columns that can be hashed."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in rows.schema if _countable(f.dataType)])


def salted(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    lookup_keys: Sequence[str],
    min_rows: int = BIG_KEY_ROWS,
    big: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Add a join key ``_salt`` / ``_r_salt`` that spreads a big key over a task per ``min_rows`` rows.

    Only lookup rows of big keys are repeated. The salt is taken from the
    whole row, never from chance or row position, so that a task which runs
    again puts every row where it was. ``big`` hands in the big keys if they are known.
    """
    code, lookup_code = key_code(keys), key_code(lookup_keys)
    if big is None:
        big = big_keys(rows, code, min_rows)
    if big.isEmpty():
        return rows.withColumn("_salt", F.lit(0)), lookup.withColumn("_r_salt", F.lit(0))
    salts = F.coalesce(F.ceil(F.col("_n") / F.lit(min_rows)), F.lit(1)).cast("int")
    left = with_big(rows, code, big)
    left = left.withColumn("_salt", F.pmod(_row_code(rows), salts).cast("int")).drop("_n")
    right = with_big(lookup, lookup_code, big)
    right = right.withColumn("_r_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_n")
    return left, right


def counted(rows: DataFrame, name: str = "_copies") -> DataFrame:
    """Different rows with the number of their copies, counted map-side: a row's copies become one row a task."""
    if not all(_countable(f.dataType) for f in rows.schema):
        return rows.withColumn(name, F.lit(1).cast("long"))
    return rows.groupBy(*[f"`{n}`" for n in rows.columns]).agg(F.count(F.lit(1)).alias(name))


def spread_copies(rows: DataFrame, size: int = BIG_KEY_ROWS, name: str = "_copies") -> DataFrame:
    """As many copies of each row as ``name`` says, those of one row in pieces of ``size`` over the tasks.

    A copy's piece is its ordinal among the copies, so it lands in the same task if that runs again.
    """
    copies = F.col(name)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = rows.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((copies - 1) / size))))
    dealt = pieces.repartition(parts, _row_code(rows), "_piece")
    here = F.least(F.lit(size).cast("long"), copies - F.col("_piece") * size)
    each = dealt.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), here)))
    return each.drop("_copy", "_piece", name)
