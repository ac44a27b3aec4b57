"""The figures quoted in text panels, one row per region, measure and horizon."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardcast.columns import COLS, Cols, check_measure
from wardcast.functions.fy import fy_display
from wardcast.functions.measures import change_percent, millions, round_even, strict_sum
from wardcast.operators.compare import (
    BASE,
    HORIZON,
    MIDPOINT,
    age_share_summary,
    headline,
    top_age_change,
    top_service_change,
)
from wardcast.operators.lookup import join_results
from wardcast.operators.quality import dq_exclusion_rate


def _names(rows: DataFrame, keys: list[str], column: str, prefix: str) -> DataFrame:
    """Tied winners of a ranking on one row: their names in order, and their common change."""
    return rows.groupBy(*keys).agg(
        F.concat_ws(" / ", F.array_sort(F.collect_list(column))).alias(prefix),
        round_even(F.max("pct_change"), 1).alias(f"{prefix}_pct_change"),
    )


def region_facts(
    mart: DataFrame, measure: str, base: str = BASE, horizon: str | None = None, c: Cols = COLS
) -> DataFrame:
    keys = [*c.regions, "horizon"]
    totals = headline(mart, base, horizon, c).select(
        *keys, "baseline_count", "horizon_count", "pct_change", "baseline_text", "horizon_text"
    )
    ages = _names(top_age_change(mart, base, horizon, c), keys, "age_group", "top_age_group")
    services = _names(top_service_change(mart, base, horizon, c), keys, c.service, "top_service")
    out = join_results(join_results(totals, ages, keys), services, keys)
    out = join_results(out, dq_exclusion_rate(mart, measure, "region", c), c.regions)
    return out.withColumns(
        {"measure": F.lit(check_measure(measure)), "horizon_label": fy_display(F.col("horizon"))}
    )


def insight_facts(
    region_marts: dict[str, DataFrame],
    base: str = BASE,
    horizon: str | None = None,
    c: Cols = COLS,
) -> DataFrame:
    """``region_marts`` maps a measure to its regional table."""
    parts = [region_facts(mart, m, base, horizon, c) for m, mart in region_marts.items()]
    return reduce(DataFrame.unionByName, parts)


def national_facts(
    national_marts: dict[str, DataFrame],
    base: str = BASE,
    midpoint: str = MIDPOINT,
    horizon: str = HORIZON,
    c: Cols = COLS,
) -> DataFrame:
    """Totals of a measure and what the older age groups make of them in three years."""

    def facts(measure: str, mart: DataFrame) -> DataFrame:
        older = age_share_summary(mart, (base, midpoint, horizon), c)
        fy = F.col(c.fin_year)
        columns = {"baseline": base, "midpoint": midpoint, "horizon": horizon}
        total = older.withColumn("_all", F.col(c.projected)).groupBy(c.fin_year).agg(
            strict_sum(F.col("_all")).alias("_all"),
            F.max("older_millions").alias("older_millions"),
            F.max("older_pct").alias("older_pct"),
        )
        picked = []
        for name, year in columns.items():
            for value in ("_all", "older_millions", "older_pct"):
                picked.append(F.max(F.when(fy == year, F.col(value))).alias(f"{name}_{value}"))
        row = total.agg(*picked)
        b, h = F.col("baseline__all"), F.col("horizon__all")
        return row.select(
            F.lit(check_measure(measure)).alias("measure"),
            millions(b).alias("baseline_millions"),
            millions(h).alias("horizon_millions"),
            change_percent(b, h).alias("pct_change"),
            *[f"{n}_{v}" for n in columns for v in ("older_millions", "older_pct")],
        )

    return reduce(DataFrame.unionByName, [facts(m, mart) for m, mart in national_marts.items()])
