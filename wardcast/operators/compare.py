"""Questions asked of the published tables: totals, changes, rates and rankings.

All work on opened nested rows, which are bounded by regions x years x ages
(or services), and answer for every region and every horizon year at once.
``horizon=`` picks one; a filter on the region prunes folders at the source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardcast.columns import COLS, Cols
from wardcast.functions.bands import BROAD_BANDS, FINE_BANDS, OLDER_BANDS, band, band_order
from wardcast.functions.fy import fy_display, fy_start, fy_start_label
from wardcast.functions.measures import (
    axis_scale,
    axis_unit,
    bar_width,
    change_fraction,
    change_percent,
    direction,
    millions,
    percent_text,
    ratio,
    round_even,
    signed_percent_text,
    strict_sum,
    thousands_text,
)
from wardcast.functions.recode import recorded_service, service_display_name
from wardcast.operators.nest import age_data, service_data

BASE = "2022_23"
MIDPOINT = "2032_33"
HORIZON = "2042_43"
NATION = "England"
SHORTEST_HORIZON = 3
PAGE_SIZE = 15


def _keys(mart: DataFrame, c: Cols) -> list[str]:
    return [k for k in c.regions if k in mart.columns]


def _against_base(
    rows: DataFrame, keys: Sequence[str], value: str, base: str, horizon: str | None, c: Cols
) -> DataFrame:
    """Rows of the horizon year(s) with the base year's value of the same key beside them."""
    fy = F.col(c.fin_year)
    if horizon is not None:
        rows = rows.filter(fy.isin(base, horizon))
    at_base = F.max(F.when(fy == base, F.col(value))).over(Window.partitionBy(*keys))
    out = rows.withColumn("_base", at_base).filter(fy != base)
    return out.withColumnRenamed(c.fin_year, "horizon")


def _by_band(rows: DataFrame, keys: Sequence[str], bands, values: Sequence[str], c: Cols) -> DataFrame:
    age = F.col(c.age)
    return rows.groupBy(
        *keys, band(age, bands).alias("age_group"), band_order(age, bands).alias("age_group_ord")
    ).agg(*[strict_sum(F.col(v)).alias(v) for v in values])


def _with_nation(regions: DataFrame, nation: DataFrame, c: Cols) -> DataFrame:
    """England's rows and the regions' rows, labelled and ordered by ``type``."""
    eng = nation.withColumns({"type": F.lit(NATION), "type_ord": F.lit(1)})
    reg = regions.withColumns({"type": F.col(c.region_name), "type_ord": F.lit(2)})
    return eng.unionByName(reg, allowMissingColumns=True)


# --- choices ---------------------------------------------------------------


def region_list(mart: DataFrame, c: Cols = COLS) -> DataFrame:
    return mart.select(c.region_name, c.region).orderBy(c.region_name)


def _years(mart: DataFrame, c: Cols) -> Column:
    return F.array_sort(F.collect_set(F.col(c.fin_year)))


def year_list(mart: DataFrame, c: Cols = COLS) -> DataFrame:
    """Financial years in order, with their display labels."""
    years = age_data(mart, c).agg(_years(mart, c).alias("_years"))
    rows = years.select(F.posexplode("_years").alias("_pos", c.fin_year))
    return rows.select(
        (F.col("_pos") + 1).alias("year_ord"),
        c.fin_year,
        fy_display(F.col(c.fin_year)).alias("label"),
    )


def horizon_list(mart: DataFrame, skip: int = SHORTEST_HORIZON, c: Cols = COLS) -> DataFrame:
    """Years that may be chosen as horizon: all but the first ``skip``; the last is the default."""
    years = age_data(mart, c).agg(_years(mart, c).alias("_years"))
    rows = years.select(
        F.element_at("_years", -1).alias("_last"),
        F.explode(F.slice("_years", skip + 1, F.size("_years"))).alias(c.fin_year),
    )
    return rows.select(
        c.fin_year,
        fy_display(F.col(c.fin_year)).alias("label"),
        (F.col(c.fin_year) == F.col("_last")).alias("is_default"),
    )


# --- totals ----------------------------------------------------------------


def total_by_year(mart: DataFrame, fy: str | None = None, c: Cols = COLS) -> DataFrame:
    rows = age_data(mart, c).filter(F.col(c.fin_year).isNotNull())
    if fy is not None:
        rows = rows.filter(F.col(c.fin_year) == fy)
    return rows.groupBy(*_keys(mart, c), c.fin_year).agg(
        strict_sum(F.col(c.projected)).alias(c.projected)
    )


def headline(
    mart: DataFrame, base: str = BASE, horizon: str | None = HORIZON, c: Cols = COLS
) -> DataFrame:
    """Baseline, horizon and per cent change, for the nation or for every region."""
    keys = _keys(mart, c)
    rows = _against_base(total_by_year(mart, c=c), keys, c.projected, base, horizon, c)
    b, h = F.col("_base"), F.col(c.projected)
    return rows.select(
        *keys,
        "horizon",
        b.alias("baseline_count"),
        h.alias("horizon_count"),
        change_percent(b, h).alias("pct_change"),
        round_even(b / 1e6, 1).alias("baseline_millions"),
        round_even(h / 1e6, 1).alias("horizon_millions"),
        thousands_text(b).alias("baseline_text"),
        thousands_text(h).alias("horizon_text"),
    )


def age_share_summary(
    mart: DataFrame, years: Sequence[str] = (BASE, MIDPOINT, HORIZON), c: Cols = COLS
) -> DataFrame:
    """Counts and shares by broad age group in a few years, with those of the older groups."""
    keys = [*_keys(mart, c), c.fin_year]
    rows = age_data(mart, c).filter(F.col(c.fin_year).isin(*years))
    rows = _by_band(rows, keys, BROAD_BANDS, [c.projected], c)
    year = Window.partitionBy(*keys)
    value = F.col(c.projected)
    is_older = F.col("age_group").isin(*OLDER_BANDS)
    unknown = F.count(F.when(is_older & value.isNull(), F.lit(1))).over(year)
    older = F.when(unknown == 0, F.sum(F.when(is_older, value)).over(year))
    missing = F.count(F.when(value.isNull(), F.lit(1))).over(year)
    whole = F.when(missing == 0, F.sum(value).over(year))
    rows = rows.withColumns({"_all": whole, "_older": older})
    return rows.select(
        *keys,
        "age_group",
        "age_group_ord",
        c.projected,
        ratio(value, F.col("_all")).alias("share"),
        F.col("_older").alias("older_count"),
        millions(F.col("_older")).alias("older_millions"),
        round_even(ratio(F.col("_older"), F.col("_all")) * 100, 1).alias("older_pct"),
    )


def projection_series(mart: DataFrame, horizon: str = HORIZON, c: Cols = COLS) -> DataFrame:
    """Every year by broad age group, with the year's date, the part up to the horizon and a unit."""
    keys = _keys(mart, c)
    rows = age_data(mart, c).filter(F.col(c.fin_year).isNotNull())
    rows = _by_band(rows, [*keys, c.fin_year], BROAD_BANDS, [c.projected], c)
    largest = F.max(c.projected).over(Window.partitionBy(*keys))
    start = fy_start(F.col(c.fin_year))
    return rows.select(
        *keys,
        c.fin_year,
        start.alias("fy_start"),
        fy_start_label(start).alias("fy_label"),
        "age_group",
        "age_group_ord",
        c.projected,
        (start <= fy_start(F.lit(horizon))).alias("within_horizon"),
        axis_unit(largest).alias("unit"),
        (F.col(c.projected) * axis_scale(largest)).alias("scaled"),
    )


# --- by age ----------------------------------------------------------------


def _age_change(mart: DataFrame, base: str, horizon: str | None, c: Cols) -> DataFrame:
    keys = _keys(mart, c)
    rows = age_data(mart, c).filter(F.col(c.fin_year).isNotNull())
    if horizon is not None:
        rows = rows.filter(F.col(c.fin_year).isin(base, horizon))
    rows = _by_band(rows, [*keys, c.fin_year], FINE_BANDS, [c.projected], c)
    rows = _against_base(rows, [*keys, "age_group"], c.projected, base, horizon, c)
    change = change_fraction(F.col("_base"), F.col(c.projected))
    return rows.select(*keys, "horizon", "age_group", "age_group_ord", change.alias("change_frac"))


def change_by_age(
    region_mart: DataFrame,
    national_mart: DataFrame,
    base: str = BASE,
    horizon: str | None = HORIZON,
    c: Cols = COLS,
) -> DataFrame:
    """Change by fine age group: one set of rows for England and one per region."""
    return _with_nation(
        _age_change(region_mart, base, horizon, c), _age_change(national_mart, base, horizon, c), c
    )


def _top(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows with the largest value per key, ties kept."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(value))
    return rows.withColumn("_rank", F.rank().over(w)).filter("_rank = 1").drop("_rank")


def top_age_change(
    mart: DataFrame, base: str = BASE, horizon: str | None = HORIZON, c: Cols = COLS
) -> DataFrame:
    """Age group(s) with the largest change, in per cent."""
    keys = [*_keys(mart, c), "horizon"]
    rows = _top(_age_change(mart, base, horizon, c), keys, "change_frac")
    return rows.select(*keys, "age_group", (F.col("change_frac") * 100).alias("pct_change"))


def usage_rate(
    region_mart: DataFrame, national_mart: DataFrame, base: str = BASE, c: Cols = COLS
) -> DataFrame:
    """Count per head of population by age group in one year."""

    def rates(mart: DataFrame) -> DataFrame:
        keys = _keys(mart, c)
        rows = age_data(mart, c).filter(F.col(c.fin_year) == base)
        rows = _by_band(rows, keys, FINE_BANDS, [c.projected, c.age_population], c)
        rate = ratio(F.col(c.projected), F.col(c.age_population))
        return rows.select(*keys, "age_group", "age_group_ord", rate.alias("rate"))

    return _with_nation(rates(region_mart), rates(national_mart), c)


def contacts_per_patient(
    region_contacts: DataFrame,
    region_patients: DataFrame,
    national_contacts: DataFrame,
    national_patients: DataFrame,
    base: str = BASE,
    c: Cols = COLS,
) -> DataFrame:
    """Contacts per 1,000 patients by age group in one year, England and regions."""

    def rates(contacts: DataFrame, patients: DataFrame) -> DataFrame:
        keys = _keys(contacts, c)
        both = (
            age_data(contacts, c).withColumn("measure", F.lit("contacts"))
            .unionByName(age_data(patients, c).withColumn("measure", F.lit("patients")))
            .filter(F.col(c.fin_year) == base)
        )
        rows = _by_band(both, [*keys, "measure"], FINE_BANDS, [c.projected], c)
        value = {
            m: F.max(F.when(F.col("measure") == m, F.col(c.projected))).alias(m)
            for m in ("contacts", "patients")
        }
        rows = rows.groupBy(*keys, "age_group", "age_group_ord").agg(*value.values())
        rate = ratio(F.col("contacts"), F.col("patients")) * 1000
        return rows.select(*keys, "age_group", "age_group_ord", rate.alias("per_1000_patients"))

    return _with_nation(
        rates(region_contacts, region_patients), rates(national_contacts, national_patients), c
    )


# --- by service ------------------------------------------------------------


def _service_change(rows: DataFrame, keys: Sequence[str], base: str, horizon: str | None, c: Cols) -> DataFrame:
    """Change per cleaned service name; services that clean to one name are added up."""
    name = service_display_name(F.col(c.service))
    rows = (
        rows.filter(F.col(c.fin_year).isNotNull())
        .groupBy(*keys, c.fin_year, name.alias(c.service))
        .agg(strict_sum(F.col(c.projected)).alias(c.projected))
    )
    return _against_base(rows, [*keys, c.service], c.projected, base, horizon, c)


def _service_pairs(
    region_mart: DataFrame, national_mart: DataFrame, base: str, horizon: str | None, c: Cols
) -> DataFrame:
    """Region's and England's change side by side.

    A service counts for a region only if both have it in both years. Rather
    than completing the grid of type, year and service and then dropping
    services with gaps, the inner join keeps exactly the complete ones.
    """

    def changes(mart: DataFrame) -> DataFrame:
        rows = service_data(mart, c).withColumn(c.service, recorded_service(F.col(c.service)))
        rows = _service_change(rows, _keys(mart, c), base, horizon, c)
        return rows.filter(F.col("_base").isNotNull() & F.col(c.projected).isNotNull())

    change = change_fraction(F.col("_base"), F.col(c.projected))
    reg = changes(region_mart).select(*c.regions, "horizon", c.service, change.alias("icb"))
    eng = changes(national_mart).select("horizon", c.service, change.alias("eng"))
    return reg.join(eng, ["horizon", c.service])


def change_by_service(
    region_mart: DataFrame,
    national_mart: DataFrame,
    base: str = BASE,
    horizon: str | None = HORIZON,
    c: Cols = COLS,
) -> DataFrame:
    """Change by service, one row for England and one for the region each."""
    pairs = _service_pairs(region_mart, national_mart, base, horizon, c)
    rows = F.array(
        F.struct(F.lit(NATION).alias("type"), F.lit(1).alias("type_ord"), F.col("eng").alias("change_frac")),
        F.struct(F.col(c.region_name).alias("type"), F.lit(2).alias("type_ord"), F.col("icb").alias("change_frac")),
    )
    return pairs.select(*c.regions, "horizon", c.service, F.inline(rows))


def service_comparison(
    region_mart: DataFrame,
    national_mart: DataFrame,
    base: str = BASE,
    horizon: str | None = HORIZON,
    page: int | None = None,
    c: Cols = COLS,
) -> DataFrame:
    """Region against England by service, with table texts, bar width, rank and page.

    Rows are ranked by the region's change, largest first; ``page`` picks one
    page of each region's table.
    """
    pairs = _service_pairs(region_mart, national_mart, base, horizon, c)
    group = Window.partitionBy(*c.regions, "horizon")
    icb, eng, diff = F.col("icb"), F.col("eng"), F.col("relative_to_national")
    rank = F.row_number().over(group.orderBy(F.desc_nulls_last("icb"), c.service))
    rows = pairs.withColumns({"relative_to_national": icb - eng, "rank": rank}).select(
        *c.regions,
        "horizon",
        c.service,
        "icb",
        "eng",
        (icb - eng).alias("relative_to_national"),
        "rank",
        F.ceil(F.col("rank") / PAGE_SIZE).cast("int").alias("page"),
        bar_width(icb, F.max("icb").over(group)).alias("icb_bar"),
        percent_text(icb).alias("icb_text"),
        percent_text(eng).alias("eng_text"),
        signed_percent_text(icb - eng).alias("relative_text"),
        direction(icb - eng).alias("direction"),
    )
    return rows if page is None else rows.filter(F.col("page") == page)


def service_order(
    region_mart: DataFrame,
    national_mart: DataFrame,
    base: str = BASE,
    horizon: str | None = HORIZON,
    c: Cols = COLS,
) -> DataFrame:
    """Display order of a region's services: by England's change, smallest first."""
    pairs = _service_pairs(region_mart, national_mart, base, horizon, c)
    w = Window.partitionBy(*c.regions, "horizon").orderBy(F.asc_nulls_last("eng"))
    return pairs.select(
        *c.regions, "horizon", c.service, F.dense_rank().over(w).alias("service_ord")
    )


def top_service_change(
    mart: DataFrame, base: str = BASE, horizon: str | None = HORIZON, c: Cols = COLS
) -> DataFrame:
    """Service(s) with the largest change, in per cent; contacts without a service are left out."""
    keys = [*_keys(mart, c), "horizon"]
    rows = service_data(mart, c).filter(F.col(c.service).isNotNull())
    rows = _service_change(rows, _keys(mart, c), base, horizon, c)
    pct = change_percent(F.col("_base"), F.col(c.projected), digits=None)
    return _top(rows.withColumn("pct_change", pct), keys, "pct_change").select(
        *keys, c.service, "pct_change"
    )

