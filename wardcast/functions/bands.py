"""Age bands, each with an explicit order for sorting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (label, first age, last age) in display order. The last band
# also takes whatever no other band holds.
FINE_BANDS = (
    ("0", 0, 0),
    ("1-4", 1, 4),
    ("5-17", 5, 17),
    ("18-34", 18, 34),
    ("35-49", 35, 49),
    ("50-64", 50, 64),
    ("65-74", 65, 74),
    ("75-84", 75, 84),
    ("85+", 85, None),
)
BROAD_BANDS = (
    ("0-4", 0, 4),
    ("5-17", 5, 17),
    ("18-64", 18, 64),
    ("65-84", 65, 84),
    ("85+", 85, None),
)
OLDER_BANDS = ("65-84", "85+")

Bands = Sequence[tuple[str, int, int | None]]


def _pick(age: Column, bands: Bands, values: list, unknown) -> Column:
    out = F.when(age.isNull(), F.lit(unknown))
    for (_, low, high), value in zip(bands[:-1], values[:-1]):
        out = out.when(age.between(low, high), F.lit(value))
    return out.otherwise(F.lit(values[-1]))


def band(age: Column, bands: Bands = FINE_BANDS, null_age: str | None = None) -> Column:
    """Band label. A missing age falls into the last band unless ``null_age`` names another."""
    labels = [b[0] for b in bands]
    return _pick(age, bands, labels, labels[-1] if null_age is None else null_age)


def band_order(age: Column, bands: Bands = FINE_BANDS, null_age: str | None = None) -> Column:
    """1-based position of the band; a separate missing-age band comes last."""
    n = len(bands)
    return _pick(age, bands, list(range(1, n + 1)), n if null_age is None else n + 1)
