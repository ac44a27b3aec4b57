"""Tables between jobs and published versions: resuming, removing, clustering, switching."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import plan, rows
from wardcast.operators import counts, quality
from wardcast.plans import catalog, fixtures, marts
from wardcast.sources import files
from wardcast.sources import marts as store
from wardcast.sources.stages import Stage

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def space(spark):
    return catalog.workspace(spark, SF_DIR)


def broken(spark):
    return spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise("x").alias("v"))


# --- tables between jobs ------------------------------------------------------


def test_catalogue_lists_whole_tables_only(spark):
    with Stage(spark) as stage:
        out = stage.save(spark.range(5), "five", cluster="id")
        assert rows(out) == [(i,) for i in range(5)]
        with pytest.raises(Exception, match="lost"):
            stage.save(broken(spark), "half")
        entries = stage.entries()
        assert set(entries) == {"five"}
        assert entries["five"]["owner"] == spark.sparkContext.applicationId and entries["five"]["cluster"] == "id"
        root, table = stage.root, stage._table("five")
    assert not files.exists(spark, root) and not spark.catalog.tableExists(table)


def test_a_run_with_a_name_goes_on(spark, tmp_path):
    made = []

    def make(name, df):
        def table():
            made.append(name)
            return df

        return table

    def steps(inputs, fails):
        with Stage(spark, str(tmp_path), run="monthly", inputs=inputs) as stage:
            first = stage.save(make("first", spark.range(6).withColumn("k", F.col("id") % 2)), "first", cluster="k")
            second = stage.save(make("second", first.filter("k = 1")), "second")
            stage.save(make("third", broken(spark) if fails else second), "third", by="k" if not fails else None)
            return rows(second)

    with pytest.raises(Exception, match="lost"):
        steps("v1", fails=True)
    assert made == ["first", "second", "third"]
    for name in spark.catalog.listTables():  # as in a new application
        if "monthly" in name.name:
            spark.sql(f"DROP TABLE {name.name}")
    assert steps("v1", fails=False) == [(1, 1), (3, 1), (5, 1)]
    assert made[3:] == ["third"]
    assert files.names(spark, str(tmp_path)) == []  # nothing is left after a run that ended
    with pytest.raises(Exception, match="lost"):
        steps("v1", fails=True)
    made.clear()
    steps("v2", fails=False)  # other inputs: nothing old is used
    assert made == ["first", "second", "third"]
    with pytest.raises(ValueError):
        Stage(spark, run="../other")


def test_publish_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    inputs = fixtures.inputs(fixtures.StarTables(spark, SF_DIR))
    real, planned = marts.contact_cells, []
    monkeypatch.setattr(marts, "contact_cells", lambda *a: planned.append(1) or real(*a))
    monkeypatch.setattr(marts, "write_mart", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        marts.publish(spark, inputs, str(tmp_path), run="again", version="1")
    monkeypatch.setattr(marts, "write_mart", store.write_mart)
    marts.publish(spark, inputs, str(tmp_path), run="again", version="1")
    assert planned == [1]
    assert store.read_mart(spark, str(tmp_path), "patients", "region").count() == 5
    assert not [n for n in files.names(spark, store.shared_folder(spark)) if n == "stage-again"]


def test_clustered_tables_bring_patients_together_once(space):
    base, by_patient = space.base, r"Exchange hashpartitioning\([^)]*patient_id"
    cells = space.stage.entries()["contact_cells"]
    assert cells["cluster"] == "patient_id"
    later = [
        counts.patient_counts(space.spark.table(space.stage._table("contact_cells"))),
        counts.patient_shares_both(base.patient_counts),
        *[quality.patients_dq(base.patient_counts, level) for level in ("region", "national")],
        *[counts.patient_lad_shares(base.patient_counts, level) for level in ("region", "national")],
    ]
    assert [len(re.findall(by_patient, plan(df))) for df in later] == [0] * 6


# --- published versions ---------------------------------------------------------


def test_versions_switch_and_a_failed_write_changes_nothing(spark, tmp_path, space):
    root, args = str(tmp_path), ("contacts", "region")
    with pytest.raises(ValueError, match="not published"):
        store.read_mart(spark, root, *args)
    mart = marts.build_mart(space.base, *args)
    path = store.write_mart(mart.filter("icb22cdh = 'Q1'"), root, *args)
    opened = store.read_mart(spark, root, *args)
    assert opened.count() == 1
    bad = mart.withColumn("icb22nm", F.when(F.col("icb22cdh") == "Q3", F.raise_error(F.lit("lost"))).otherwise(F.col("icb22nm")))
    with pytest.raises(Exception, match="lost"):
        store.write_mart(bad, root, *args)
    assert store.read_mart(spark, root, *args).count() == 1
    store.write_mart(mart, root, *args, display_name=F.upper)
    assert opened.count() == 1  # opened before the switch
    now = store.read_mart(spark, root, *args)
    assert now.count() == 5 and all(r.icb22nm.isupper() for r in now.collect())
    first, last = store.versions(spark, root, *args)
    assert store.read_mart(spark, root, *args, version=first).count() == 1
    assert set(files.names(spark, path)) == {first, last, store.MANIFEST}  # the failed one is gone
    store.write_mart(mart, root, *args, keep=1)
    assert len(store.versions(spark, root, *args)) == 1 and len(files.names(spark, path)) == 2
    with pytest.raises(ValueError, match="not published"):
        store.read_mart(spark, root, *args, version=first)
