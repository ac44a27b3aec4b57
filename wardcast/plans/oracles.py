"""SQL equivalents of the registered queries, for an independent engine.

Each query is written from the semantics, not from our plans: joins where we
use windows, grids where we use inner joins, ranks where we use aggregates.
``all_sql`` puts the common table expressions a query names in front of it.
"""

from __future__ import annotations

import re

BASE, MIDPOINT, HORIZON = "2022_23", "2032_33", "2042_43"
REG = "icb22cdh, icb22nm"
PERSON = "lad18cd, age_int, gender_cat"
LEVELS = ("region", "national")
MEASURES = ("contacts", "patients")


def rnd(expr: str, digits: int = 6) -> str:
    """Round half to even; adding zero turns a negative zero into a plain one."""
    return f"(round_even({expr}, {digits}) + 0.0)"


CTE: dict[str, str] = {}

# --- the driver's tables as contacts, areas, submitters and population ---------

CTE["digits"] = "SELECT CAST(p_partkey AS INT) AS d FROM part WHERE p_partkey < 10"
CTE["fx_lsoa_lad"] = """
SELECT 'L' || CAST(n_nationkey * 10 + d AS VARCHAR) AS lsoa11cd, 'E' || CAST(n_nationkey AS VARCHAR) AS lad18cd
FROM nation CROSS JOIN digits WHERE n_nationkey <> 24"""
CTE["fx_lsoa_icb"] = """
SELECT 'L' || CAST(n_nationkey * 10 + d AS VARCHAR) AS lsoa11cd,
 'Q' || CAST(CASE WHEN d >= 8 AND n_nationkey % 4 = 0 THEN (n_regionkey + 1) % 5 ELSE n_regionkey END AS VARCHAR) AS icb22cdh
FROM nation CROSS JOIN digits"""
CTE["fx_consistent"] = """
SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS provider_org_id FROM supplier WHERE s_suppkey % 4 <> 0"""
CTE["fx_contacts"] = """
SELECT CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE o_custkey END AS patient_id,
 CASE WHEN month(l_shipdate) >= 4
  THEN CAST(year(l_shipdate) + 24 AS VARCHAR) || '/' || lpad(CAST((year(l_shipdate) + 25) % 100 AS VARCHAR), 2, '0')
  ELSE CAST(year(l_shipdate) + 23 AS VARCHAR) || '/' || lpad(CAST((year(l_shipdate) + 24) % 100 AS VARCHAR), 2, '0') END AS fin_year,
 CAST(l_shipdate + INTERVAL '24' YEAR AS DATE) AS contact_date,
 CASE WHEN l_partkey % 5 = 0 THEN 'L' || CAST(s_nationkey * 10 + l_suppkey % 10 AS VARCHAR)
  ELSE 'L' || CAST(c_nationkey * 10 + c_custkey % 10 AS VARCHAR) END AS lsoa11cd,
 CASE WHEN l_partkey % 3 = 0 OR c_custkey % 41 = 0 THEN NULL ELSE 'Q' || CAST(n_regionkey AS VARCHAR) END AS icb22cdh,
 CASE WHEN l_partkey % 3 = 0 OR c_custkey % 41 = 0 THEN NULL ELSE 'NHS ' || r_name || ' Integrated Care Board' END AS icb22nm,
 CASE WHEN l_linenumber = 3 OR c_custkey % 37 = 0 THEN NULL ELSE CAST((c_custkey * 7) % 116 AS VARCHAR) END AS age_int,
 CASE WHEN l_linenumber = 5 OR c_custkey % 43 = 0 THEN 'Unknown' WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender_cat,
 CASE WHEN l_partkey % 53 = 0 THEN NULL ELSE 'S' || CAST(l_suppkey AS VARCHAR) END AS submitter_id,
 CASE WHEN l_linenumber <= 3 THEN '5' WHEN l_linenumber = 4 THEN '6' WHEN l_linenumber = 5 AND l_partkey % 2 = 0 THEN '3'
  WHEN l_linenumber = 5 THEN '7' WHEN l_linenumber = 6 AND l_partkey % 2 = 0 THEN '2' WHEN l_linenumber = 6 THEN '4' END AS attendance_cat,
 CASE WHEN l_partkey % 17 = 0 THEN NULL WHEN p_type = 'SMALL' THEN 'Children''s Therapy Service'
  WHEN p_type = 'LARGE' THEN 'Adult''s Nursing Service' ELSE p_type || ' Service' END AS service
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
CTE["people"] = """
SELECT c_nationkey AS nation, CASE WHEN (c_custkey * 7) % 116 > 90 THEN 90 ELSE (c_custkey * 7) % 116 END AS age,
 CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END AS sex, count(*) AS n FROM customer GROUP BY ALL"""
CTE["popn_cells"] = """
SELECT n_nationkey, age, unnest(range(1, 3)) AS sex
FROM (SELECT n_nationkey, unnest(range(0, 91)) AS age FROM nation WHERE n_nationkey NOT IN (23, 24))"""
CTE["fx_popn"] = """
SELECT CAST(2021 + step AS INT) AS year, 'E' || CAST(n_nationkey AS VARCHAR) AS area_code, CAST(age AS INT) AS age, CAST(sex AS INT) AS sex,
 CAST((500 + n_nationkey * 11 + (90 - age) * 7 + (sex - 1) * 13 + step * (age - 30) * 0.25) * size AS DOUBLE) AS value
FROM (SELECT n_nationkey, c.age, c.sex, 1 + coalesce(n, 0) AS size, unnest(range(0, 23)) AS step
 FROM popn_cells c LEFT JOIN people p ON p.nation = n_nationkey AND p.age = c.age AND p.sex = c.sex)"""

# --- cleaning ------------------------------------------------------------------

STATUS = """CASE WHEN attendance_cat IN ('5', '6') THEN 'Attended' WHEN attendance_cat IN ('3', '7') THEN 'Did Not Attend'
 WHEN attendance_cat IN ('2', '4') THEN 'Cancelled' ELSE 'Unknown' END"""
LISTED = """CASE WHEN submitter_id IS NULL THEN NULL
 WHEN submitter_id IN (SELECT provider_org_id FROM fx_consistent) THEN 1 ELSE 0 END"""


def fill(cols: list[str], source: str, rest: str) -> str:
    order = ", ".join(f"{x} ASC NULLS FIRST" for x in ["contact_date", *cols])
    window = f"PARTITION BY patient_id ORDER BY {order}"
    filled = ",\n ".join(
        f"""coalesce(last_value({x} IGNORE NULLS) OVER ({window} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value({x} IGNORE NULLS) OVER ({window} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {x}"""
        for x in cols
    )
    return f"SELECT {rest},\n {filled}\nFROM {source}"


CTE["before_fill"] = f"""
SELECT patient_id, contact_date, icb22cdh, icb22nm, service, lad18cd,
 CASE WHEN TRY_CAST(age_int AS INT) > 90 THEN 90 ELSE TRY_CAST(age_int AS INT) END AS age_int,
 CASE WHEN gender_cat = 'Unknown' THEN NULL ELSE gender_cat END AS gender_cat,
 {STATUS} AS attendance_cat, {LISTED} AS consistent_ind
FROM fx_contacts LEFT JOIN fx_lsoa_lad USING (lsoa11cd)
WHERE patient_id IS NOT NULL AND fin_year = '2022/23'"""
CTE["tidy"] = fill(
    ["icb22cdh", "icb22nm", "age_int", "gender_cat", "lad18cd"],
    "before_fill",
    "patient_id, contact_date, service, attendance_cat, consistent_ind",
)

# --- population ----------------------------------------------------------------

CTE["cal_popn"] = """
SELECT year AS cal_yr, area_code AS lad18cd, age AS age_int,
 CASE WHEN sex = 1 THEN 'Male' ELSE 'Female' END AS gender_cat, value FROM fx_popn WHERE year >= 2022"""
CTE["fy_blend"] = f"""
SELECT {PERSON}, cal_yr, CAST(cal_yr AS VARCHAR) || '_' || lpad(CAST((cal_yr + 1) % 100 AS VARCHAR), 2, '0') AS fin_year,
 value * 0.75 + lead(value) OVER (PARTITION BY {PERSON} ORDER BY cal_yr) * 0.25 AS fin_year_popn
FROM cal_popn"""
CTE["fy_popn"] = f"""
SELECT {PERSON}, fin_year, fin_year_popn,
 fin_year_popn / NULLIF(first_value(fin_year_popn) OVER (PARTITION BY {PERSON} ORDER BY cal_yr), 0) AS growth_coeff
FROM fy_blend WHERE fin_year_popn IS NOT NULL"""
CTE["shares"] = """
SELECT icb22cdh, p.lad18cd, p.n * 1.0 / t.n AS proportion
FROM (SELECT icb22cdh, lad18cd, count(*) AS n FROM fx_lsoa_icb LEFT JOIN fx_lsoa_lad USING (lsoa11cd) GROUP BY ALL) p
JOIN (SELECT lad18cd, count(*) AS n FROM fx_lsoa_icb LEFT JOIN fx_lsoa_lad USING (lsoa11cd) GROUP BY ALL) t
 ON p.lad18cd IS NOT DISTINCT FROM t.lad18cd"""
CTE["popn_region"] = """
SELECT icb22cdh, fin_year, age_int, sum(fin_year_popn * proportion) AS proj_popn_by_fy_age
FROM shares LEFT JOIN fy_popn USING (lad18cd) GROUP BY ALL"""
CTE["popn_national"] = """
SELECT fin_year, age_int, sum(fin_year_popn) AS proj_popn_by_fy_age FROM fy_popn GROUP BY ALL"""

# --- counts --------------------------------------------------------------------

CTE["contact_counts"] = f"""
SELECT {REG}, service, consistent_ind, attendance_cat, {PERSON}, count(*) AS count FROM tidy GROUP BY ALL"""
CTE["patient_flags"] = f"""
SELECT {REG}, service, patient_id, max(consistent_ind) AS any_consistent,
 max(CASE WHEN attendance_cat = 'Attended' THEN 1 ELSE 0 END) AS any_attended FROM tidy GROUP BY ALL"""
CTE["patient_counts"] = f"""
SELECT t.icb22cdh, t.icb22nm, t.service, t.patient_id, any_consistent AS consistent_ind, any_attended AS attendance_cat,
 {PERSON}, count(*) AS n
FROM tidy t JOIN patient_flags f ON t.patient_id = f.patient_id AND t.icb22cdh IS NOT DISTINCT FROM f.icb22cdh
 AND t.icb22nm IS NOT DISTINCT FROM f.icb22nm AND t.service IS NOT DISTINCT FROM f.service GROUP BY ALL"""
for level, keys, need in (("region", REG + ", ", "icb22cdh IS NOT NULL AND "), ("national", "", "")):
    CTE[f"filt_{level}"] = f"""
SELECT * FROM patient_counts WHERE consistent_ind = 1 AND attendance_cat = 1
 AND {need}lad18cd IS NOT NULL AND age_int IS NOT NULL AND gender_cat IS NOT NULL"""
    CTE[f"prop_{level}"] = f"""
SELECT {keys}lad18cd, patient_id, sum(n) / max(total) AS prop
FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}patient_id) AS total FROM filt_{level}) GROUP BY ALL"""
    CTE[f"mid_{level}"] = f"""
SELECT * FROM (SELECT DISTINCT {keys}service, {PERSON}, patient_id FROM filt_{level})
LEFT JOIN prop_{level} USING ({keys}lad18cd, patient_id)"""
    CTE[f"patients_{level}"] = f"""
SELECT {keys}{PERSON}, sum(prop) AS count
FROM (SELECT DISTINCT {keys}{PERSON}, patient_id, prop FROM mid_{level}) GROUP BY ALL"""
    CTE[f"patients_sv_{level}"] = f"""
SELECT {keys}service, {PERSON}, sum(prop) AS count FROM mid_{level} GROUP BY ALL"""
CTE["contacts_sv_region"] = f"""
SELECT {REG}, service, {PERSON}, CAST(sum(count) AS BIGINT) AS count FROM contact_counts
WHERE consistent_ind = 1 AND attendance_cat = 'Attended' AND gender_cat IN ('Male', 'Female')
 AND age_int IS NOT NULL AND icb22cdh IS NOT NULL GROUP BY ALL"""
CTE["contacts_sv_national"] = f"""
SELECT service, {PERSON}, CAST(sum(count) AS BIGINT) AS count FROM contacts_sv_region GROUP BY ALL"""

# --- projections and published tables -------------------------------------------

CLEAN_NAME = r"regexp_replace(icb22nm, '^(NHS )(.*)( Integ.*)$', '\2 ICB') AS icb22nm"


def keyed(level: str) -> str:
    return REG + ", " if level == "region" else ""


for measure in MEASURES:
    for level in LEVELS:
        keys = keyed(level)
        overall = "patients_" + level if measure == "patients" else "contacts_sv_" + level
        CTE[f"proj_{measure}_{level}"] = f"""
SELECT {keys}fin_year, age_int, sum(count * growth_coeff) AS projected_count
FROM {overall} LEFT JOIN fy_popn USING ({PERSON}) GROUP BY ALL"""
        CTE[f"sv_{measure}_{level}"] = f"""
SELECT {keys}service, fin_year, sum(projected_count) AS projected_count FROM (
 SELECT {keys}service, fin_year, age_int, sum(count * growth_coeff) AS projected_count
 FROM {measure}_sv_{level} LEFT JOIN fy_popn USING ({PERSON}) GROUP BY ALL) GROUP BY ALL"""
        same_region = "p.icb22cdh = q.icb22cdh AND " if keys else ""
        popn_columns = "p.*, q.proj_popn_by_fy_age"
        CTE[f"data_{measure}_{level}"] = f"""
SELECT {popn_columns} FROM proj_{measure}_{level} p LEFT JOIN popn_{level} q
 ON {same_region}p.fin_year IS NOT DISTINCT FROM q.fin_year AND p.age_int IS NOT DISTINCT FROM q.age_int"""
        pub = f"icb22cdh, {CLEAN_NAME}, " if keys else ""
        CTE[f"pub_data_{measure}_{level}"] = f"""
SELECT {pub}fin_year, age_int, projected_count, proj_popn_by_fy_age FROM data_{measure}_{level}"""
        CTE[f"pub_sv_{measure}_{level}"] = f"""
SELECT {pub}service, fin_year, projected_count FROM sv_{measure}_{level}"""
        CTE[f"total_{measure}_{level}"] = f"""
SELECT {keys}fin_year, sum(projected_count) AS total FROM pub_data_{measure}_{level}
WHERE fin_year IS NOT NULL GROUP BY ALL"""
CTE["years"] = "SELECT DISTINCT fin_year FROM pub_data_contacts_national WHERE fin_year IS NOT NULL"
CTE["horizons"] = f"SELECT fin_year AS horizon FROM years WHERE fin_year <> '{BASE}'"

# --- bands ----------------------------------------------------------------------

CTE["fine"] = """
SELECT * FROM (VALUES ('0', 1, 0, 0), ('1-4', 2, 1, 4), ('5-17', 3, 5, 17), ('18-34', 4, 18, 34), ('35-49', 5, 35, 49),
 ('50-64', 6, 50, 64), ('65-74', 7, 65, 74), ('75-84', 8, 75, 84)) AS t (label, ord, low, high)"""
CTE["broad"] = """
SELECT * FROM (VALUES ('0-4', 1, 0, 4), ('5-17', 2, 5, 17), ('18-64', 3, 18, 64), ('65-84', 4, 65, 84))
 AS t (label, ord, low, high)"""


def banded(bands: str, source: str, keys: str, values: str) -> str:
    last = 9 if bands == "fine" else 5
    return f"""SELECT {keys}coalesce(label, '85+') AS age_group, coalesce(ord, {last}) AS age_group_ord, {values}
FROM {source} LEFT JOIN {bands} ON age_int BETWEEN low AND high GROUP BY ALL"""


for measure in MEASURES:
    for level in LEVELS:
        keys = keyed(level)
        year_rows = f"(SELECT * FROM pub_data_{measure}_{level} WHERE fin_year IS NOT NULL)"
        CTE[f"fine_{measure}_{level}"] = banded(
            "fine", year_rows, keys + "fin_year, ",
            "sum(projected_count) AS value, sum(proj_popn_by_fy_age) AS popn",
        )
        CTE[f"broad_{measure}_{level}"] = banded(
            "broad", year_rows, keys + "fin_year, ", "sum(projected_count) AS value"
        )
        join_keys = keys + "age_group, age_group_ord"
        CTE[f"age_change_{measure}_{level}"] = f"""
SELECT {join_keys}, h.fin_year AS horizon, (h.value - b.value) / NULLIF(b.value, 0) AS change
FROM fine_{measure}_{level} h JOIN (SELECT {join_keys}, value FROM fine_{measure}_{level} WHERE fin_year = '{BASE}') b
 USING ({join_keys}) WHERE h.fin_year <> '{BASE}'"""

# --- services -------------------------------------------------------------------


def service_name(expr: str) -> str:
    """First match only, as the default of this engine's ``regexp_replace``."""
    out = f"regexp_replace({expr}, ' Service', '')"
    out = f"regexp_replace({out}, 'Adult''s', 'Adults')"
    return f"regexp_replace({out}, 'Children''s', 'Children')"


for measure in MEASURES:
    for level in LEVELS:
        keys = keyed(level)
        name = service_name("coalesce(service, 'Not recorded')")
        CTE[f"cell_{measure}_{level}"] = f"""
SELECT {keys}fin_year, {name} AS service, sum(projected_count) AS value
FROM pub_sv_{measure}_{level} WHERE fin_year IS NOT NULL GROUP BY ALL"""
    CTE[f"grid_{measure}"] = f"""
SELECT {REG}, horizon, 'England' AS type, n.fin_year, n.service, n.value
FROM (SELECT DISTINCT {REG} FROM pub_sv_{measure}_region) CROSS JOIN horizons
 JOIN cell_{measure}_national n ON n.fin_year IN ('{BASE}', horizon)
UNION ALL
SELECT {REG}, horizon, 'region' AS type, fin_year, service, value
FROM cell_{measure}_region JOIN horizons ON fin_year IN ('{BASE}', horizon)"""
    CTE[f"pairs_{measure}"] = f"""
SELECT {REG}, horizon, service,
 (max(value) FILTER (type = 'region' AND fin_year = horizon) - max(value) FILTER (type = 'region' AND fin_year = '{BASE}'))
  / NULLIF(max(value) FILTER (type = 'region' AND fin_year = '{BASE}'), 0) AS icb,
 (max(value) FILTER (type = 'England' AND fin_year = horizon) - max(value) FILTER (type = 'England' AND fin_year = '{BASE}'))
  / NULLIF(max(value) FILTER (type = 'England' AND fin_year = '{BASE}'), 0) AS eng
FROM grid_{measure} GROUP BY ALL HAVING count(value) = 4"""
    CTE[f"sv_change_{measure}"] = f"""
SELECT {REG}, h.fin_year AS horizon, service, (h.value - b.value) * 100 / NULLIF(b.value, 0) AS pct_change
FROM (SELECT {REG}, fin_year, {service_name('service')} AS service, sum(projected_count) AS value
 FROM pub_sv_{measure}_region WHERE service IS NOT NULL GROUP BY ALL) h
JOIN (SELECT {REG}, {service_name('service')} AS service, sum(projected_count) AS value
 FROM pub_sv_{measure}_region WHERE service IS NOT NULL AND fin_year = '{BASE}' GROUP BY ALL) b
 USING ({REG}, service) WHERE h.fin_year <> '{BASE}'"""
    CTE[f"sv_top_{measure}"] = f"""
SELECT * FROM sv_change_{measure} QUALIFY rank() OVER (PARTITION BY {REG}, horizon ORDER BY pct_change DESC NULLS LAST) = 1"""
    CTE[f"age_top_{measure}"] = f"""
SELECT * FROM age_change_{measure}_region
QUALIFY rank() OVER (PARTITION BY {REG}, horizon ORDER BY change DESC NULLS LAST) = 1"""

# --- data quality ----------------------------------------------------------------


def when(test: str, name: str) -> str:
    return f"CAST(sum(CASE WHEN {test} THEN count ELSE 0 END) AS BIGINT) AS {name}"


def contacts_quality(level: str) -> str:
    region = level == "region"
    need = "" if region else "icb22cdh IS NOT NULL AND "
    final = (
        f"CAST(sum(CASE WHEN {need}lad18cd IS NOT NULL AND age_int IS NOT NULL AND gender_cat IS NOT NULL"
        " AND consistent_ind = 1 AND attendance_cat = 'Attended' THEN count ELSE 0 END) AS BIGINT)"
    )
    measures = [
        "CAST(sum(count) AS BIGINT) AS all_unfiltd",
        *([] if region else [when("icb22cdh IS NULL", "missing_icb")]),
        when("consistent_ind = 0", "inconsistnt"),
        when("attendance_cat = 'Did Not Attend'", "not_attnded"),
        when("attendance_cat = 'Cancelled'", "app_canclld"),
        when("attendance_cat = 'Unknown'", "app_unknown"),
        when("age_int IS NULL", "missing_age"),
        when("gender_cat IS NULL", "missing_gen"),
        f"CAST(sum(count) AS BIGINT) - {final} AS total_excld",
        f"{final} AS final_count",
    ]
    tail = "WHERE icb22cdh IS NOT NULL GROUP BY icb22cdh" if region else ""
    return f"SELECT {'icb22cdh, ' if region else ''}{', '.join(measures)} FROM contact_counts {tail}"


def patients_quality(level: str) -> str:
    region = level == "region"
    key = "icb22cdh, " if region else ""
    icb = "count(icb22cdh) > 0 AND " if not region else ""
    per = f"""SELECT {key}patient_id,
 CASE WHEN count(icb22cdh) = 0 THEN 1 ELSE 0 END AS missing_icb,
 CASE WHEN min(consistent_ind) = 0 AND max(consistent_ind) = 0 THEN 1 ELSE 0 END AS inconsistnt,
 CASE WHEN max(attendance_cat) = 0 THEN 1 ELSE 0 END AS not_attnded,
 CASE WHEN count(age_int) = 0 THEN 1 ELSE 0 END AS missing_age,
 CASE WHEN count(gender_cat) = 0 THEN 1 ELSE 0 END AS missing_gen,
 CASE WHEN {icb}max(consistent_ind) = 1 AND max(attendance_cat) = 1 AND count(age_int) > 0
  AND count(gender_cat) > 0 AND count(lad18cd) > 0 THEN 1 ELSE 0 END AS final_count
FROM patient_counts {'WHERE icb22cdh IS NOT NULL' if region else ''} GROUP BY ALL"""
    names = [*([] if region else ["missing_icb"]), "inconsistnt", "not_attnded", "missing_age", "missing_gen"]
    sums = ", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in names)
    return f"""SELECT {key}count(*) AS all_unfiltd, {sums},
 count(*) - CAST(sum(final_count) AS BIGINT) AS total_excld, CAST(sum(final_count) AS BIGINT) AS final_count
FROM ({per}) {'GROUP BY icb22cdh' if region else ''}"""


for level in LEVELS:
    CTE[f"dq_contacts_{level}"] = contacts_quality(level)
    CTE[f"dq_patients_{level}"] = patients_quality(level)

# Report labels in order.
LABELS = {
    "contacts": (
        ("all_unfiltd", "All contacts in initial dataset"),
        ("missing_icb", "Contacts not attributed to an ICB"),
        ("inconsistnt", "Contacts from inconsistent submitters"),
        ("not_attnded", "Contacts where the patient did not attend"),
        ("app_canclld", "Contacts where the appointment was cancelled"),
        ("app_unknown", "Contacts where the appointment status is unknown"),
        ("missing_age", "Contacts with unknown patient age"),
        ("missing_gen", "Contacts with unknown patient gender"),
        ("total_excld", "Total contacts excluded"),
        ("final_count", "Remaining contacts included in projections"),
    ),
    "patients": (
        ("all_unfiltd", "All patients in initial dataset"),
        ("missing_icb", "Patients not attributed to an ICB"),
        ("inconsistnt", "Patients from inconsistent submitters"),
        ("not_attnded", "Patients who did not attend any appointments"),
        ("missing_age", "Patients with unknown patient age"),
        ("missing_gen", "Patients with unknown patient gender"),
        ("total_excld", "Total patients excluded"),
        ("final_count", "Remaining patients included in projections"),
    ),
}
CTE["region_names"] = f"SELECT DISTINCT icb22cdh, {CLEAN_NAME} FROM contacts_sv_region"


def report(measure: str, level: str) -> str:
    labels = [x for x in LABELS[measure] if level == "national" or x[0] != "missing_icb"]
    source = f"dq_{measure}_{level}" + (" JOIN region_names USING (icb22cdh)" if level == "region" else "")
    return "\nUNION ALL\n".join(
        f"SELECT '{measure}' AS measure, {keyed(level)}{i} AS category_ord, '{label}' AS category, {name} AS n, "
        f"{rnd(f'{name} * 100.0 / NULLIF(all_unfiltd, 0)', 1)} AS pct FROM {source}"
        for i, (name, label) in enumerate(labels, start=1)
    )


# --- the queries -----------------------------------------------------------------

SQL: dict[str, str] = {}

SQL["tidy_contacts"] = "SELECT * FROM tidy"
SQL["fill_down_up"] = SQL["fill_down_up_split"] = fill(
    ["icb22cdh", "icb22nm", "age_int", "gender_cat"],
    "fx_contacts WHERE patient_id IS NOT NULL",
    "patient_id, contact_date",
)
SQL["attendance_recode"] = f"SELECT attendance_cat, {STATUS} AS status, count(*) AS contacts FROM fx_contacts GROUP BY ALL"
SQL["consistent_flag"] = (
    f"SELECT submitter_id, {LISTED} AS consistent_ind, count(*) AS contacts FROM fx_contacts GROUP BY submitter_id"
)
SQL["age_bands"] = """
SELECT coalesce(f.label, '85+') AS fine, coalesce(f.ord, 9) AS fine_ord, coalesce(b.label, '85+') AS broad,
 CASE WHEN age IS NULL THEN 'Unknown' ELSE coalesce(b.label, '85+') END AS broad_or_unknown, count(*) AS contacts
FROM (SELECT TRY_CAST(age_int AS INT) AS age FROM fx_contacts)
LEFT JOIN fine f ON age BETWEEN f.low AND f.high LEFT JOIN broad b ON age BETWEEN b.low AND b.high GROUP BY ALL"""
SQL["fy_labels"] = """
SELECT replace(fin_year, '/', '_') AS label, fin_year AS shown, make_date(CAST(left(fin_year, 4) AS INT), 4, 1) AS start,
 fin_year AS start_label, count(*) AS contacts FROM fx_contacts GROUP BY ALL"""
SQL["display_names"] = f"""
SELECT {CLEAN_NAME.replace('AS icb22nm', 'AS region_shown')},
 {service_name("coalesce(service, 'Not recorded')")} AS service_shown, count(*) AS contacts FROM fx_contacts GROUP BY ALL"""
SQL["fy_population"] = (
    f"SELECT {PERSON}, fin_year, {rnd('fin_year_popn')} AS fin_year_popn, {rnd('growth_coeff')} AS growth_coeff FROM fy_popn"
)
SQL["growth_coefficients"] = f"SELECT {PERSON}, fin_year, {rnd('growth_coeff')} AS growth_coeff FROM fy_popn"
SQL["area_shares"] = f"SELECT icb22cdh, lad18cd, {rnd('proportion')} AS proportion FROM shares"
SQL["region_population"] = f"""
SELECT icb22cdh, fin_year, age_int, {rnd('proj_popn_by_fy_age')} AS proj_popn_by_fy_age FROM popn_region"""
SQL["national_population"] = f"""
SELECT fin_year, age_int, {rnd('proj_popn_by_fy_age')} AS proj_popn_by_fy_age FROM popn_national"""
SQL["contact_cells"] = f"""
SELECT t.icb22cdh, t.icb22nm, t.service, t.patient_id, consistent_ind, attendance_cat, {PERSON},
 any_consistent, any_attended, count(*) AS n
FROM tidy t JOIN patient_flags f ON t.patient_id = f.patient_id AND t.icb22cdh IS NOT DISTINCT FROM f.icb22cdh
 AND t.icb22nm IS NOT DISTINCT FROM f.icb22nm AND t.service IS NOT DISTINCT FROM f.service GROUP BY ALL"""
SQL["patient_shares"] = f"""
SELECT {REG}, service, {PERSON}, {rnd('sum(prop)')} AS count,
 {rnd('sum(CASE WHEN service IS NOT DISTINCT FROM first_service THEN prop ELSE 0 END)')} AS count_once
FROM (SELECT *, first_value(service) OVER (PARTITION BY {REG}, patient_id, {PERSON} ORDER BY service NULLS FIRST) AS first_service
 FROM mid_region) GROUP BY ALL"""
SQL["contact_counts"] = "SELECT * FROM contact_counts"
SQL["patient_counts"] = "SELECT * FROM patient_counts"
for level in LEVELS:
    keys = keyed(level)
    SQL[f"contacts_dq_{level}"] = f"SELECT * FROM dq_contacts_{level}"
    SQL[f"patients_dq_{level}"] = f"SELECT * FROM dq_patients_{level}"
    SQL[f"patient_lad_shares_{level}"] = f"SELECT {keys}lad18cd, patient_id, {rnd('prop')} AS prop FROM prop_{level}"
    SQL[f"unique_patients_{level}"] = f"SELECT {keys}{PERSON}, {rnd('count')} AS count FROM patients_{level}"
    SQL[f"unique_patients_by_service_{level}"] = (
        f"SELECT {keys}service, {PERSON}, {rnd('count')} AS count FROM patients_sv_{level}"
    )
    SQL[f"included_contacts_{level}"] = f"SELECT * FROM contacts_sv_{level}"
    for measure in MEASURES:
        SQL[f"project_{measure}_{level}"] = f"""
SELECT {keys}fin_year, age_int, {rnd('projected_count')} AS projected_count FROM proj_{measure}_{level}"""
        SQL[f"service_{measure}_{level}"] = f"""
SELECT {keys}service, fin_year, {rnd('projected_count')} AS projected_count FROM sv_{measure}_{level}"""
        names = [n for n, _ in LABELS[measure] if level == "national" or n != "missing_icb"]
        head = ("icb_" if keys else "nat_") + measure + "_"
        dq = ", ".join(f"{n} AS {head}{n}" for n in names)
        link = f"JOIN dq_{measure}_{level} USING (icb22cdh)" if keys else f"CROSS JOIN dq_{measure}_{level}"
        SQL[f"mart_{measure}_{level}_exploded"] = f"""
SELECT 'data' AS kind, {keys}CAST(NULL AS VARCHAR) AS service, fin_year, age_int, {rnd('projected_count')} AS projected_count,
 {rnd('proj_popn_by_fy_age')} AS proj_popn_by_fy_age, {dq} FROM data_{measure}_{level} {link}
UNION ALL
SELECT 'service' AS kind, {keys}service, fin_year, CAST(NULL AS INT) AS age_int, {rnd('projected_count')} AS projected_count,
 CAST(NULL AS DOUBLE) AS proj_popn_by_fy_age, {dq} FROM sv_{measure}_{level} {link}"""
SQL["mart_roundtrip"] = f"""
SELECT {REG}, fin_year, age_int, {rnd('projected_count')} AS projected_count,
 {rnd('proj_popn_by_fy_age')} AS proj_popn_by_fy_age FROM pub_data_contacts_region"""
SQL["one_region"] = f"""
SELECT {REG}, service, fin_year, {rnd('projected_count')} AS projected_count
FROM pub_sv_patients_region WHERE icb22cdh = 'Q2'"""
SQL["region_list"] = f"SELECT DISTINCT {REG} FROM pub_data_contacts_region"
SQL["year_list"] = """
SELECT CAST(row_number() OVER (ORDER BY fin_year) AS INT) AS year_ord, fin_year, replace(fin_year, '_', '/') AS label FROM years"""
SQL["horizon_list"] = """
SELECT fin_year, replace(fin_year, '_', '/') AS label, fin_year = (SELECT max(fin_year) FROM years) AS is_default
FROM years QUALIFY row_number() OVER (ORDER BY fin_year) > 3"""
SQL["total_by_year"] = f"SELECT fin_year, {rnd('total')} AS projected_count FROM total_patients_national"
SQL["year_map"] = f"SELECT {REG}, fin_year, {rnd('total')} AS projected_count FROM total_contacts_region"


def headline(measure: str, level: str) -> str:
    keys = keyed(level)
    on = f"USING ({REG})" if keys else "ON TRUE"

    def text(x: str) -> str:
        return f"format('{{:,}}', CAST(round_even({x}, -3) AS BIGINT))"

    return f"""
SELECT {keys}h.fin_year AS horizon, {rnd('b.total')} AS baseline_count, {rnd('h.total')} AS horizon_count,
 {rnd('(h.total - b.total) * 100 / NULLIF(b.total, 0)', 1)} AS pct_change,
 {rnd('b.total / 1e6', 1)} AS baseline_millions, {rnd('h.total / 1e6', 1)} AS horizon_millions,
 {text('b.total')} AS baseline_text, {text('h.total')} AS horizon_text
FROM total_{measure}_{level} h
JOIN (SELECT {keys}total FROM total_{measure}_{level} WHERE fin_year = '{BASE}') b {on} WHERE h.fin_year <> '{BASE}'"""


SQL["headline_national"] = headline("contacts", "national")
SQL["headline_region"] = headline("patients", "region")
SQL["age_share_summary"] = f"""
SELECT fin_year, age_group, age_group_ord, {rnd('value')} AS projected_count, {rnd('value / total')} AS share,
 {rnd('older')} AS older_count, {rnd('round_even(older, -5) / 1e6')} AS older_millions, {rnd('older / total * 100', 1)} AS older_pct
FROM broad_contacts_national JOIN total_contacts_national USING (fin_year)
JOIN (SELECT fin_year, sum(value) AS older FROM broad_contacts_national WHERE age_group IN ('65-84', '85+') GROUP BY ALL)
 USING (fin_year)
WHERE fin_year IN ('{BASE}', '{MIDPOINT}', '{HORIZON}')"""
SQL["projection_series"] = f"""
SELECT {REG}, fin_year, make_date(CAST(left(fin_year, 4) AS INT), 4, 1) AS fy_start, replace(fin_year, '_', '/') AS fy_label,
 age_group, age_group_ord, {rnd('value')} AS projected_count, fin_year <= '{MIDPOINT}' AS within_horizon,
 CASE WHEN top < 1e6 THEN 'k' ELSE 'm' END AS unit,
 {rnd('value * CASE WHEN top < 1e6 THEN 1e-3 ELSE 1e-6 END')} AS scaled
FROM broad_contacts_region JOIN (SELECT {REG}, max(value) AS top FROM broad_contacts_region GROUP BY ALL) USING ({REG})"""


def with_england(national: str, region: str, columns: str) -> str:
    return f"""
SELECT CAST(NULL AS VARCHAR) AS icb22cdh, CAST(NULL AS VARCHAR) AS icb22nm, 'England' AS type, 1 AS type_ord, {columns} FROM {national}
UNION ALL SELECT icb22cdh, icb22nm, icb22nm AS type, 2 AS type_ord, {columns} FROM {region}"""


SQL["change_by_age"] = with_england(
    "age_change_contacts_national",
    "age_change_contacts_region",
    f"horizon, age_group, age_group_ord, {rnd('change')} AS change_frac",
)
SQL["top_age_change"] = f"SELECT {REG}, horizon, age_group, {rnd('change * 100')} AS pct_change FROM age_top_contacts"
SQL["change_by_service"] = f"""
SELECT {REG}, horizon, service, 'England' AS type, 1 AS type_ord, {rnd('eng')} AS change_frac FROM pairs_contacts
UNION ALL SELECT {REG}, horizon, service, icb22nm AS type, 2 AS type_ord, {rnd('icb')} AS change_frac FROM pairs_contacts"""


def pct_text(expr: str) -> str:
    return f"regexp_replace(CAST({rnd(f'({expr}) * 100', 1)} AS VARCHAR), '\\.0$', '') || '%'"


SQL["service_comparison"] = f"""
SELECT {REG}, horizon, service, {rnd('icb')} AS icb, {rnd('eng')} AS eng, {rnd('icb - eng')} AS relative_to_national,
 CAST(pos AS INT) AS rank, CAST((pos + 14) // 15 AS INT) AS page, {rnd('icb * 80 / NULLIF(top, 0)')} AS icb_bar,
 {pct_text('icb')} AS icb_text, {pct_text('eng')} AS eng_text,
 CASE WHEN icb > eng THEN '+' ELSE '' END || {pct_text('icb - eng')} AS relative_text,
 CASE WHEN icb > eng THEN 'above' WHEN icb < eng THEN 'below' WHEN icb = eng THEN 'level' END AS direction
FROM (SELECT *, row_number() OVER (PARTITION BY {REG}, horizon ORDER BY icb DESC NULLS LAST, service) AS pos,
 max(icb) OVER (PARTITION BY {REG}, horizon) AS top FROM pairs_patients)"""
SQL["service_order"] = f"""
SELECT {REG}, horizon, service,
 CAST(dense_rank() OVER (PARTITION BY {REG}, horizon ORDER BY eng ASC NULLS LAST) AS INT) AS service_ord FROM pairs_contacts"""
SQL["top_service_change"] = f"SELECT {REG}, horizon, service, {rnd('pct_change')} AS pct_change FROM sv_top_patients"
SQL["usage_rate"] = with_england(
    f"(SELECT * FROM fine_patients_national WHERE fin_year = '{BASE}')",
    f"(SELECT * FROM fine_patients_region WHERE fin_year = '{BASE}')",
    f"age_group, age_group_ord, {rnd('value / NULLIF(popn, 0)')} AS rate",
)


def per_patient(level: str) -> str:
    keys = keyed(level)
    return f"""(SELECT {keys}age_group, age_group_ord, c.value * 1000 / NULLIF(p.value, 0) AS rate
 FROM (SELECT * FROM fine_contacts_{level} WHERE fin_year = '{BASE}') c
 FULL JOIN (SELECT {keys}age_group, age_group_ord, value FROM fine_patients_{level} WHERE fin_year = '{BASE}') p
 USING ({keys}age_group, age_group_ord))"""


SQL["contacts_per_patient"] = with_england(
    per_patient("national"), per_patient("region"), f"age_group, age_group_ord, {rnd('rate')} AS per_1000_patients"
)
for level in LEVELS:
    SQL[f"dq_table_{level}"] = "\nUNION ALL\n".join(report(m, level) for m in MEASURES)
SQL["dq_exclusion_rate"] = "\nUNION ALL\n".join(
    f"SELECT {REG}, '{m}' AS measure, {rnd('total_excld * 100.0 / NULLIF(all_unfiltd, 0)', 1)} AS exclusion_rate"
    f" FROM dq_{m}_region JOIN region_names USING (icb22cdh)"
    for m in MEASURES
)
SQL["insight_facts"] = "\nUNION ALL\n".join(
    f"""SELECT {REG}, h.horizon, h.baseline_count, h.horizon_count, h.pct_change, h.baseline_text, h.horizon_text,
 a.top_age_group, a.top_age_group_pct_change, s.top_service, s.top_service_pct_change,
 {rnd('d.total_excld * 100.0 / NULLIF(d.all_unfiltd, 0)', 1)} AS exclusion_rate,
 '{m}' AS measure, replace(h.horizon, '_', '/') AS horizon_label
FROM ({headline(m, 'region')}) h
LEFT JOIN (SELECT {REG}, horizon, string_agg(age_group, ' / ' ORDER BY age_group) AS top_age_group,
 {rnd('max(change) * 100', 1)} AS top_age_group_pct_change FROM age_top_{m} GROUP BY {REG}, horizon) a USING ({REG}, horizon)
LEFT JOIN (SELECT {REG}, horizon, string_agg(service, ' / ' ORDER BY service) AS top_service,
 {rnd('max(pct_change)', 1)} AS top_service_pct_change FROM sv_top_{m} GROUP BY {REG}, horizon) s USING ({REG}, horizon)
LEFT JOIN dq_{m}_region d USING (icb22cdh)"""
    for m in MEASURES
)


def older_facts(measure: str) -> str:
    def year(value: str, fy: str) -> str:
        return f"max({value}) FILTER (fin_year = '{fy}')"

    older = ", ".join(
        f"{rnd(f'round_even({year("older", fy)}, -5) / 1e6')} AS {name}_older_millions, "
        f"{rnd(f'{year("older", fy)} / {year("total", fy)} * 100', 1)} AS {name}_older_pct"
        for name, fy in (("baseline", BASE), ("midpoint", MIDPOINT), ("horizon", HORIZON))
    )
    b, h = year("total", BASE), year("total", HORIZON)
    return f"""SELECT '{measure}' AS measure, {rnd(f'round_even({b}, -5) / 1e6')} AS baseline_millions,
 {rnd(f'round_even({h}, -5) / 1e6')} AS horizon_millions, {rnd(f'({h} - {b}) * 100 / {b}', 1)} AS pct_change, {older}
FROM total_{measure}_national JOIN (SELECT fin_year, sum(value) AS older FROM broad_{measure}_national
 WHERE age_group IN ('65-84', '85+') GROUP BY ALL) USING (fin_year)"""


SQL["national_facts"] = "\nUNION ALL\n".join(older_facts(m) for m in MEASURES)
SQL["unmatched_counts"] = f"""
SELECT {REG}, CAST(sum(count) AS BIGINT) AS count,
 CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM fy_popn f WHERE f.lad18cd = s.lad18cd AND f.age_int = s.age_int
  AND f.gender_cat = s.gender_cat) THEN 0 ELSE count END) AS BIGINT) AS unmatched
FROM contacts_sv_region s GROUP BY {REG}"""
SQL["latest_submission"] = """
SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_returnflag FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
 ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_returnflag DESC) = 1"""
CTE["found_submitters"] = f"""
SELECT submitter_id AS provider_org_id FROM (SELECT *, {STATUS} AS status FROM fx_contacts)
WHERE fin_year = '2022/23' AND submitter_id IS NOT NULL GROUP BY submitter_id
HAVING count(DISTINCT month(contact_date)) = 12
 AND count(DISTINCT CASE WHEN status = 'Attended' THEN month(contact_date) END) = 12"""
SQL["consistent_submitters"] = "SELECT * FROM found_submitters"
SQL["age_at_first_contact"] = """
SELECT patient_id, CAST(min(CASE WHEN contact_date = first_date THEN age END) AS INT) AS age_int
FROM (SELECT patient_id, contact_date, TRY_CAST(age_int AS INT) AS age,
 min(CASE WHEN age_int IS NOT NULL THEN contact_date END) OVER (PARTITION BY patient_id) AS first_date
 FROM fx_contacts WHERE fin_year = '2022/23' AND patient_id IS NOT NULL) GROUP BY patient_id"""
SQL["coverage"] = f"""
SELECT count(*) AS attended, count(*) FILTER (submitter_id IN (SELECT provider_org_id FROM found_submitters)) AS attended_consistent,
 {rnd('count(*) FILTER (submitter_id IN (SELECT provider_org_id FROM found_submitters)) * 100.0 / NULLIF(count(*), 0)', 1)} AS pct_covered
FROM fx_contacts WHERE fin_year = '2022/23' AND attendance_cat IN ('5', '6')"""
SQL["quality_exclusions"] = """
SELECT concat_ws('; ', CASE WHEN patient_id IS NULL THEN 'no patient' END,
 CASE WHEN gender_cat IS NULL OR gender_cat = 'Unknown' THEN 'no gender' END,
 CASE WHEN TRY_CAST(age_int AS INT) IS NULL THEN 'no age' END,
 CASE WHEN TRY_CAST(age_int AS INT) > 115 THEN 'age too high' END,
 CASE WHEN lad18cd IS NULL THEN 'no district' END) AS reasons, count(*) AS contacts
FROM fx_contacts LEFT JOIN fx_lsoa_lad USING (lsoa11cd) GROUP BY ALL"""


CTE["raw_contacts"] = """
SELECT * REPLACE (CASE WHEN patient_id % 101 = 5 THEN 'P' || CAST(patient_id AS VARCHAR) ELSE CAST(patient_id AS VARCHAR) END AS patient_id,
 CASE WHEN day(contact_date) = 31 THEN NULL ELSE CAST(contact_date AS VARCHAR) || CASE WHEN day(contact_date) = 30 THEN 'x' ELSE '' END END
  AS contact_date),
 concat_ws('; ', CASE WHEN patient_id % 101 = 5 THEN 'patient_id: not a bigint' END,
  CASE WHEN day(contact_date) = 30 THEN 'contact_date: not a date' WHEN day(contact_date) = 31 THEN 'contact_date: missing' END) AS reasons
FROM fx_contacts"""
SQL["load_contacts"] = """
SELECT * EXCLUDE (reasons) REPLACE (CAST(patient_id AS BIGINT) AS patient_id, CAST(contact_date AS DATE) AS contact_date)
FROM raw_contacts WHERE reasons = ''"""
SQL["rejected_contacts"] = """
SELECT patient_id AS "Person_ID", contact_date AS "Contact_Date", submitter_id, reasons FROM raw_contacts WHERE reasons <> ''"""
SQL["contact_reasons"] = """
SELECT NULLIF(reason, '') AS reason, count(*) AS rows FROM (SELECT unnest(string_split(reasons, '; ')) AS reason FROM raw_contacts) GROUP BY ALL"""
SQL["load_area_region"] = "SELECT * FROM fx_lsoa_icb"
SQL["load_area_district"] = "SELECT * FROM fx_lsoa_lad"
SQL["load_submitters"] = "SELECT * FROM fx_consistent"
SQL["load_population"] = f"SELECT year, area_code, age, sex, {rnd('value')} AS value FROM fx_popn"
SQL["rejected_population"] = """
SELECT CASE age WHEN 3 THEN 'value: missing' WHEN 4 THEN 'value: not a double' END AS reason, count(*) AS rows FROM fx_popn GROUP BY ALL"""
CTE["low_growth"] = f"""
SELECT {PERSON}, fin_year, CASE WHEN age_int = 85 AND gender_cat = 'Male' THEN NULL ELSE growth_coeff END AS growth_coeff
FROM fy_popn WHERE age_int NOT IN (3, 4)"""
SQL["undefined_growth"] = f"SELECT DISTINCT {PERSON} FROM low_growth WHERE growth_coeff IS NULL"
SQL["project_undefined"] = f"""
SELECT {REG}, fin_year, age_int, CASE WHEN count(growth_coeff) = count(*) THEN {rnd('sum(count * growth_coeff)')} END AS projected_count
FROM contacts_sv_region LEFT JOIN low_growth USING ({PERSON}) GROUP BY ALL"""
SQL["project_matched"] = f"""
SELECT {REG}, fin_year, {rnd('sum(count * growth_coeff)')} AS projected_count
FROM contacts_sv_region JOIN fy_popn USING ({PERSON}) GROUP BY ALL"""
SQL["total_of_year"] = f"""
SELECT {REG}, fin_year, {rnd('total')} AS projected_count FROM total_contacts_region WHERE fin_year = '{MIDPOINT}'"""
SQL["headline_horizon"] = f"SELECT * FROM ({headline('contacts', 'region')}) WHERE horizon = '{MIDPOINT}'"
for name in ("change_by_age", "top_age_change", "change_by_service", "service_order", "top_service_change"):
    SQL[f"{name}_horizon"] = f"SELECT * FROM ({SQL[name]}) WHERE horizon = '{MIDPOINT}'"
SQL["service_comparison_page"] = f"SELECT * FROM ({SQL['service_comparison']}) WHERE horizon = '{MIDPOINT}' AND page = 1"


def _named(text: str) -> list[str]:
    """Common table expressions a text refers to."""
    return [n for n in CTE if re.search(rf"\b{n}\b", text)]


def with_ctes(query: str) -> str:
    ordered: list[str] = []

    def add(name: str, chain: tuple[str, ...] = ()) -> None:
        for need in _named(CTE[name]):
            if need != name and need not in ordered and need not in chain:
                add(need, (*chain, name))
        if name not in ordered:
            ordered.append(name)

    for name in _named(query):
        add(name)
    if not ordered:
        return query
    # Evaluated once each, however often they are read.
    once = {"fx_popn", "cal_popn", "fy_blend"}
    parts = [f"{n} AS {'MATERIALIZED ' if n in once else ''}({CTE[n]})" for n in ordered]
    return "WITH " + ",\n".join(parts) + "\n" + query


def all_sql() -> dict[str, str]:
    return {name: with_ctes(query) for name, query in SQL.items()}
