"""Joins to lookup tables, with the broadcast decided by a counted size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.operators.size import MAX_BROADCAST_ROWS, fits
from wardcast.operators.skew import (
    BIG_KEY_ROWS,
    big_keys,
    counted,
    key_code,
    salted,
    spread_copies,
    with_big,
)

def _keys_match(left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool) -> Column:
    out = F.lit(True)
    for k in keys:
        pair = left[k].eqNullSafe(right[f"_r_{k}"]) if null_safe else left[k] == right[f"_r_{k}"]
        out = out & pair
    return out


def join_lookup(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    *,
    null_safe: bool = False,
    max_rows: int = MAX_BROADCAST_ROWS,
    big_rows: int = BIG_KEY_ROWS,
    small: bool | None = None,
) -> DataFrame:
    """Left join of ``rows`` to ``lookup``.

    A lookup of a checked small size is broadcast, so ``rows`` are not
    shuffled. Beyond that the join shuffles on the keys, and keys with at least
    ``big_rows`` rows are salted by the row. Copies of one row can't be told apart by that, so rows of such
    keys are counted first, joined once each, and spread over the tasks again after the join. ``small`` hands in an
    earlier measurement of the same lookup (see ``fits``).
    """
    right = lookup.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    right_keys = [f"_r_{k}" for k in keys]
    if fits(lookup, max_rows) if small is None else small:
        right = F.broadcast(right)
        return rows.join(right, _keys_match(rows, right, keys, null_safe), "left").drop(*right_keys)
    code = key_code(keys)
    big = big_keys(rows, code, big_rows)
    if big.isEmpty():
        return rows.join(right, _keys_match(rows, right, keys, null_safe), "left").drop(*right_keys)
    marked = with_big(rows, code, big)
    plain = marked.filter("_n IS NULL").drop("_n")
    plain = plain.join(right, _keys_match(plain, right, keys, null_safe), "left").drop(*right_keys)
    hot = counted(marked.filter("_n IS NOT NULL").drop("_n"))
    left, right = salted(hot, right, keys, right_keys, big_rows, big)
    match = _keys_match(left, right, keys, null_safe) & (left["_salt"] == right["_r_salt"])
    hot = left.join(right, match, "left").drop("_salt", "_r_salt", *right_keys)
    return plain.unionByName(spread_copies(hot, big_rows))


def join_results(
    rows: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Null-safe join of two results already summed to their keys.

    Neither side is hinted: the planner broadcasts by the size it measures.
    """
    right = other.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    out = rows.join(right, _keys_match(rows, right, keys, null_safe=True), how)
    return out.drop(*[f"_r_{k}" for k in keys])


def flag_membership(rows: DataFrame, column: str, members: DataFrame, name: str) -> DataFrame:
    """0/1 flag: is ``column`` among the first column of ``members``? Missing stays missing."""
    listed = (
        members.select(F.col(members.columns[0]).alias(column))
        .filter(F.col(column).isNotNull())
        .distinct()
        .withColumn("_listed", F.lit(1))
    )
    flag = F.when(F.col(column).isNotNull(), F.coalesce(F.col("_listed"), F.lit(0)))
    return join_lookup(rows, listed, [column]).withColumn(name, flag).drop("_listed")
