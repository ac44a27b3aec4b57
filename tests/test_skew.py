"""Keys and groups that hold much of a table give the same results by the other way."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import plan, rows
from wardcast.operators import lookup
from wardcast.operators.clean import tidy_contacts
from wardcast.operators.fill import fill_down_up
from wardcast.operators.lookup import fits, join_lookup
from wardcast.operators.skew import big_keys, salted
from wardcast.sources.stages import Stage


def uneven(spark, n=3000):
    """A third of the rows under patient 0, many of them copies, with gaps everywhere."""
    i = F.col("id")
    h = F.pmod(F.xxhash64("id"), F.lit(1000))
    return spark.range(n).select(
        F.when(i % 3 == 0, 0).otherwise(i % 97).alias("patient_id"),
        F.date_add(F.lit(dt.date(2022, 4, 1)), (h % 40).cast("int")).alias("contact_date"),
        F.when(h % 4 > 0, F.concat(F.lit("Q"), h % 3)).alias("icb22cdh"),
        F.when(h % 5 > 0, F.concat(F.lit("E"), h % 7)).alias("lad18cd"),
        (h % 6).alias("other"),
    )


COLS = ["icb22cdh", "lad18cd"]


def filled_by_hand(table):
    """Down, then up, one patient at a time."""
    out = []
    by_patient = {}
    for r in table:
        by_patient.setdefault(r.patient_id, []).append(r)
    for group in by_patient.values():
        group.sort(key=lambda r: (r.contact_date, *[(r[c] is not None, r[c] or "") for c in COLS]))
        columns = []
        for c in COLS:
            values, last = [], None
            for r in group:
                last = r[c] if r[c] is not None else last
                values.append(last)
            first = next((v for v in values if v is not None), None)
            columns.append([first if v is None else v for v in values])
        out += [
            (r.patient_id, r.contact_date, *values, r.other)
            for r, *values in zip(group, *columns)
        ]
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_rows", [10**6, 5])
def test_split_fill_equals_brute_force(spark, monkeypatch, broadcast_rows):
    df = uneven(spark).persist()
    big = big_keys(df, "patient_id", min_rows=500)
    assert [r["_key"] for r in big.collect()] == [0]
    monkeypatch.setattr(lookup, "fits", lambda t, n: fits(t, broadcast_rows))
    out = fill_down_up(df, "patient_id", "contact_date", COLS, big=big)
    expected = filled_by_hand(df.collect())
    assert sorted((tuple(r) for r in out.collect()), key=str) == expected
    plain = fill_down_up(df, "patient_id", "contact_date", COLS)
    assert sorted((tuple(r) for r in plain.collect()), key=str) == expected


def test_all_big_keys_are_found_and_split(spark):
    df = uneven(spark)
    assert big_keys(df, "patient_id", min_rows=10**6).isEmpty()
    assert big_keys(df, "patient_id", min_rows=1).count() == 97
    many = spark.range(6000).select(
        (F.col("id") % 1500).alias("patient_id"), F.lit(dt.date(2022, 4, 1)).alias("contact_date"),
        F.when(F.col("id") < 1500, "Q1").alias("icb22cdh"), F.lit("E1").alias("lad18cd"), F.lit(1).alias("other"),
    )
    big = big_keys(many, "patient_id", min_rows=4)
    assert big.count() == 1500 and big.filter("_n <> 4").isEmpty()
    out = fill_down_up(many, "patient_id", "contact_date", COLS, big=big)
    assert out.count() == 6000 and out.filter("icb22cdh IS NULL").isEmpty()
    left, _ = salted(many, spark.range(1500).toDF("_r_patient_id"), ["patient_id"], ["_r_patient_id"], min_rows=2)
    assert left.agg(F.max("_salt")).first()[0] == 1


def test_split_fill_scans_contacts_twice_at_most(spark, tmp_path):
    uneven(spark).write.parquet(str(tmp_path / "contacts"))
    df = spark.read.parquet(str(tmp_path / "contacts"))
    out = fill_down_up(df, "patient_id", "contact_date", COLS, big=big_keys(df, "patient_id", min_rows=500))
    assert plan(out).count(f"{tmp_path}/contacts") <= 2


def test_fits_by_rows_and_by_bytes(spark):
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
    assert fits(df) and not fits(df, max_rows=99) and not fits(df, max_bytes=50_000)
    assert fits(df, max_rows=100, max_bytes=200_000) and fits(df.filter("false"), 0)


def test_salted_join_equals_broadcast_join(spark):
    df = uneven(spark).withColumn("lad18cd", F.when(F.col("patient_id") == 0, "E1").otherwise(F.col("lad18cd")))
    table = spark.createDataFrame([("E1", 1), ("E1", 2), ("E2", 3), (None, 4)], "lad18cd string, v int")
    for null_safe in (False, True):
        small = join_lookup(df, table, ["lad18cd"], null_safe=null_safe)
        large = join_lookup(df, table, ["lad18cd"], null_safe=null_safe, max_rows=1, big_rows=100)
        assert rows(large) == rows(small)
        assert large.columns == small.columns


def test_copies_of_one_row_land_in_several_tasks(spark):
    same = spark.range(20_000).select(F.lit("E1").alias("lad18cd"), F.lit(7).alias("v"))
    other = spark.createDataFrame([("E2", 8), (None, 9), ("E1", 7)], "lad18cd string, v int")
    df = same.union(other).repartition(4)
    table = spark.createDataFrame([("E1", 1), ("E2", 3)], "lad18cd string, w int")
    out = join_lookup(df, table, ["lad18cd"], max_rows=0, big_rows=500)
    by_task = out.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(by_task) >= 4 and max(r["count"] for r in by_task) < 9_000
    assert rows(out.groupBy(*out.columns).count()) == [(None, 9, None, 1), ("E1", 7, 1, 20_001), ("E2", 8, 3, 1)]
    # one row for all copies of a task is what the join itself takes
    assert "partial_count(1)" in plan(out)
    with_map = df.withColumn("m", F.create_map(F.lit("a"), "v"))
    assert join_lookup(with_map, table, ["lad18cd"], max_rows=0, big_rows=500).count() == 20_003


def test_salt_spreads_a_big_key_only(spark):
    df = uneven(spark)
    left, right = salted(df, spark.range(100).toDF("_r_patient_id"), ["patient_id"], ["_r_patient_id"],
                         min_rows=125)
    used = dict(rows(left.groupBy("patient_id").agg(F.countDistinct("_salt"))))
    salts = -(-df.filter("patient_id = 0").count() // 125)
    assert used[0] == salts > 8 and {v for k, v in used.items() if k != 0} == {1}
    assert right.count() == 99 + salts


def test_tidy_contacts_with_a_big_patient(spark):
    df = uneven(spark).select(
        F.lit("2022/23").alias("fin_year"), "icb22cdh",
        F.concat("icb22cdh", F.lit(" name")).alias("icb22nm"), "patient_id", "contact_date",
        F.col("lad18cd").alias("lsoa11cd"), F.lit("40").alias("age_int"), F.lit("Male").alias("gender_cat"),
        F.lit("S1").alias("submitter_id"), F.lit("5").alias("attendance_cat"), F.lit("X").alias("service"),
    )
    lads = spark.createDataFrame([(f"E{i}", f"D{i}") for i in range(6)], "lsoa11cd string, lad18cd string")
    subs = spark.createDataFrame([("S1",)], "provider_org_id string")
    plain = tidy_contacts(df, lads, subs, big_patients=[])
    split = tidy_contacts(df, lads, subs, big_patient_rows=500)
    known = tidy_contacts(df, lads, subs, big_patients=[0])
    assert rows(split) == rows(plain) == rows(known)
    assert plain.count() == 3000


def test_split_fill_carries_over_few_pieces(spark, tmp_path):
    """Of the tables written on the way, two hold the rows; the others grow with the parts, not with the days."""
    df = uneven(spark).unionByName(uneven(spark, 1).crossJoin(spark.range(2000).select()))  # and copies of one row
    stage = Stage(spark, str(tmp_path))
    out = fill_down_up(df, "patient_id", "contact_date", COLS, big=big_keys(df, "patient_id", 500, stage), stage=stage)
    assert sorted((tuple(r) for r in out.collect()), key=str) == filled_by_hand(df.collect())
    counts = {n: spark.read.parquet(f"{stage.root}/{n}").count() for n in stage.written}
    large = sorted(n for n in counts.values() if n > 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert large == [df.filter("patient_id = 0").count()] * 2
    stage.close()


def test_ties_of_a_big_key_lie_in_several_pieces(spark, tmp_path):
    day = F.lit(dt.date(2022, 4, 1))
    df = spark.range(0, 4000, 1, 4).select(F.lit(1).alias("patient_id"), day.alias("contact_date"), F.lit("Q1").alias("icb22cdh"), F.lit(None).cast("string").alias("lad18cd"))
    stage = Stage(spark, str(tmp_path))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = fill_down_up(df, "patient_id", "contact_date", COLS, big=[1], stage=stage)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out.count() == 4000 and out.filter("icb22cdh = 'Q1' AND lad18cd IS NULL").count() == 4000
    (parts,) = [n for n in stage.written if n.startswith("parts")]
    sizes = spark.read.parquet(f"{stage.root}/{parts}").groupBy("_part").count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 3000
    stage.close()
