"""Fill gaps down, then up, within a key in date order.

``fill_down_up`` completes missing values of several columns from the nearest
earlier row of the same key, or else from its first later row. Rows are
ordered by ``order`` and then by the filled columns themselves, nulls first,
so that the result does not depend on input order.

Ordinary keys are filled by one window, hence one shuffle on the key. A key
which holds more rows than a task should sort goes another way with the same
result. Because the order ends in the filled columns, rows that tie agree in
all of them, so that ties may be parted anywhere. The rows of big keys are
dealt by ranges of (key, order, filled columns) and written so; a key's rows
within one part are a piece, however many rows tie. Pieces are filled in
parallel. Only where a key goes on in another part are values carried from
piece to piece, over one row per piece, of which there are few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardcast.operators.skew import known_keys, with_big
from wardcast.sources.stages import Stage


def _order(order: str, cols: Sequence[str]) -> list[Column]:
    return [F.asc_nulls_first(c) for c in (order, *cols)]


def _fill_by_window(rows: DataFrame, key: str, order: str, cols: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*_order(order, cols))
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # A null running value means that all earlier rows are null as well, so the
    # next value is the first of the whole key. Both frames cost linear time.
    return rows.withColumns(
        {
            c: F.coalesce(
                F.last(c, ignorenulls=True).over(so_far), F.first(c, ignorenulls=True).over(whole)
            )
            for c in cols
        }
    )


def _fill_by_piece(rows: DataFrame, key: str, order: str, cols: Sequence[str], kept: Stage) -> DataFrame:
    # Rows are dealt by ranges of the order, those that tie by their place in the written table.
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(key, *_order(order, cols), "_tie").drop("_tie")
    parts = kept.scratch(dealt.withColumn("_part", F.spark_partition_id()), "parts")

    # Only keys that go on from one part to the next are carried: no more pieces than twice the parts.
    ends = parts.groupBy(key).agg(F.min("_part").alias("_from"), F.max("_part").alias("_to"))
    cut = kept.scratch(ends.filter("_from < _to").select(F.col(key).alias("_key")), "cut")
    rank = F.struct(order, *cols)
    known = []
    for c in cols:
        seen = F.when(F.col(c).isNotNull(), rank)
        known += [F.min_by(c, seen).alias(f"_first_{c}"), F.max_by(c, seen).alias(f"_last_{c}")]
    of_cut = parts.join(F.broadcast(cut), F.col(key) == F.col("_key"), "left_semi")
    pieces = of_cut.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_piece")).agg(*known)
    w = Window.partitionBy("_key").orderBy("_piece")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carry = {}
    for c in cols:
        carry[f"_before_{c}"] = F.last(f"_last_{c}", ignorenulls=True).over(before)
        carry[f"_any_{c}"] = F.first(f"_first_{c}", ignorenulls=True).over(whole)
    carried = kept.scratch(pieces.withColumns(carry).select("_key", "_piece", *carry), "carried")

    here = Window.partitionBy(key, "_part").orderBy(*_order(order, cols))
    so_far = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_piece = here.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = {}
    for c in cols:
        own[f"_so_far_{c}"] = F.last(c, ignorenulls=True).over(so_far)
        own[f"_next_{c}"] = F.first(c, ignorenulls=True).over(in_piece)
    match = (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_piece"))
    out = parts.withColumns(own).join(F.broadcast(carried), match, "left")
    # Earlier pieces come before the rest of the own one, which holds the next value if no other piece has any before.
    return out.withColumns(
        {c: F.coalesce(f"_so_far_{c}", f"_before_{c}", f"_any_{c}", f"_next_{c}") for c in cols}
    )


def fill_down_up(
    rows: DataFrame,
    key: str,
    order: str,
    cols: Sequence[str],
    *,
    big: DataFrame | Sequence | None = None,
    stage: Stage | None = None,
) -> DataFrame:
    """Fill ``cols`` within ``key``; ``big`` holds the keys to split (a list, or see ``big_keys``).

    Rows of big keys are written down once, since the split way reads them several times.
    """
    columns = rows.columns
    if big is not None and not isinstance(big, DataFrame):
        big = known_keys(rows, key, big)
    if big is None or big.isEmpty():
        return _fill_by_window(rows, key, order, cols).select(*columns)
    marked = with_big(rows, F.col(key), big)
    plain = _fill_by_window(marked.filter("_n IS NULL").drop("_n"), key, order, cols)
    kept = stage or Stage(rows.sparkSession)
    hot = kept.scratch(marked.filter("_n IS NOT NULL").drop("_n"), "hot")
    split = _fill_by_piece(hot, key, order, cols, kept)
    return plain.select(*columns).unionByName(split.select(*columns))
