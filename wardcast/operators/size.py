"""Measuring a table before it is broadcast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What every executor can hold beside its work. The row limit also covers the
# overhead of a hash table over short rows.
MAX_BROADCAST_ROWS = 1_500_000
MAX_BROADCAST_BYTES = 256 * 1024 * 1024
BYTES_PER_FIELD = 16


def fits(
    table: DataFrame,
    max_rows: int = MAX_BROADCAST_ROWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> bool:
    """Measure a lookup: is it small enough to broadcast, by rows and by bytes?

    One aggregation over the table, combined map-side.
    """
    text = [F.coalesce(F.octet_length(F.col(n).cast("string")), F.lit(0)) for n in table.columns]
    width = reduce(lambda a, b: a + b, text, F.lit(BYTES_PER_FIELD * len(text)))
    n, size = table.agg(F.count(F.lit(1)), F.sum(width.cast("long"))).first()
    return n <= max_rows and (size or 0) <= max_bytes
