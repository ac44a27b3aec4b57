"""Reading a table by a contract: names, types and needed values; rows that break it go aside with their reasons."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A column of the result: where it comes from, its type (none: as it is), and whether it must have a value."""

    name: str
    source: str
    kind: str | None = None
    required: bool = False

    def value(self) -> Column:
        column = F.col(f"`{self.source}`")
        return column.try_cast(self.kind) if self.kind else column

    def reason(self) -> Column:
        """Why a row's value can't be taken; missing if it can."""
        column = F.col(f"`{self.source}`")
        out = F.lit(None).cast("string")
        if self.kind:
            out = F.when(column.isNotNull() & self.value().isNull(), f"{self.name}: not a {self.kind}")
        if self.required:
            absent = F.when(column.isNull(), f"{self.name}: missing")
            out = F.coalesce(out, absent)
        return out


@dataclass(frozen=True)
class Checked:
    """Both sides of a table read by a contract; each is a plan over the same scan, nothing has been read yet."""

    source: DataFrame
    fields: tuple[Field, ...]

    def _marked(self) -> DataFrame:
        reasons = F.array_compact(F.array(*[f.reason() for f in self.fields]))
        return self.source.withColumn("_reasons", reasons)

    @property
    def rows(self) -> DataFrame:
        """Rows that keep the contract, under its names and types."""
        return self._marked().filter(F.size("_reasons") == 0).select(*[f.value().alias(f.name) for f in self.fields])

    @property
    def rejects(self) -> DataFrame:
        """Rows that break it, as they came, with ``reasons`` in order of the fields."""
        sources = list(dict.fromkeys(f.source for f in self.fields))
        raw = [F.col(f"`{s}`") for s in sources]
        return self._marked().filter(F.size("_reasons") > 0).select(*raw, F.col("_reasons").alias("reasons"))

    def counts(self) -> DataFrame:
        """Rows by reason, one pass: a row with several is in each; those without are under a missing reason."""
        each = self._marked().select(F.explode_outer("_reasons").alias("reason"))
        return each.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def by_contract(df: DataFrame, fields: Sequence[Field]) -> Checked:
    """Check that all columns are there, whatever their type; values are checked row by row."""
    missing = sorted({f.source for f in fields} - set(df.columns))
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return Checked(df, tuple(fields))
