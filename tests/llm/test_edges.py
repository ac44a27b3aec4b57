"""Nulls, empty and long texts, repeated rows, empty tables, extra columns: every operator and stage."""

import pytest

import corpus_pipeline
from wardcast.llm import (
    decontaminate, exact_dedup, fixity, html_text, jaccard, mixing, secret_scan, token_output, toxicity, url_rules,
)
from wardcast.llm.queries import TARGETS, domains

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, node long, score double, _m string, root string"
LONG = "some words of a long text " * 60_000


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, 1, 2, 0.5, "m", "r") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of every awkward kind, in a table with clashing columns."""
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (4, "a"), (5, LONG), (None, "a b c d e f g"), (None, None), (6, "\x00é€😀")]
    return docs(spark, rows)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(4, 1, 0), (4, 0, 1), (5, None, 0), (None, 1, 1), (77, 1, 0)], "doc_id long, quality int, toxic int"
    )


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, None), (2, ""), (None, "some words of a long text some words"), (3, "x"), (3, LONG[:200])]
    return spark.createDataFrame(rows, "item_id long, text string")


def operators(labels, benchmark):
    from pyspark.sql import functions as F

    return {
        "secrets": secret_scan.find_secrets,
        "jaccard": jaccard.components,
        "exact": exact_dedup.exact_duplicates,
        "items": lambda d: decontaminate.contaminated(d, benchmark),
        "toxicity": lambda d: toxicity.score_documents(d, labels, F.col("doc_id") < 0),
        "mixing": lambda d: mixing.mixture(d, domains(labels), TARGETS),
    }


@pytest.mark.parametrize("name", ["secrets", "jaccard", "exact", "items", "toxicity", "mixing"])
def test_one_row_for_each_row(spark, odd, labels, benchmark, name):
    operator = operators(labels, benchmark)[name]
    got = operator(odd).collect()
    ids = lambda rows: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
    assert ids(got) == ids(odd.select("doc_id").collect())
    assert operator(docs(spark, [])).collect() == []
    assert operator(odd.select("doc_id", "text").limit(0)).collect() == []


def test_empty_side_tables(spark, odd, labels, benchmark):
    got = operators(labels.limit(0), benchmark.limit(0))
    assert {r["score"] for r in got["toxicity"](odd).collect()} == {0.0}
    assert not any(r["contaminated"] for r in got["items"](odd).collect())
    assert all(r["membership"] == pytest.approx([1 / 3] * 3) for r in got["mixing"](odd).collect())


def test_defined_results(spark, odd, labels, benchmark):
    found = {r["doc_id"]: r for r in jaccard.components(odd).collect() if r["doc_id"] in (1, 2, 3, 4)}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4)}
    held = {r["doc_id"]: r for r in decontaminate.contaminated(odd, benchmark).collect() if r["doc_id"]}
    assert held[5]["contaminated"] and not held[4]["contaminated"]
    exact = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(odd).collect() if r["doc_id"]}
    assert (exact[1]["keep_id"], exact[2]["keep_id"], exact[2]["group_size"]) == (1, 1, 3)
    assert (exact[3]["keep_id"], exact[4]["group_size"], exact[4]["kept"]) == (3, 2, True)


def test_token_records(spark, odd):
    got = token_output.training_records(odd).collect()
    assert {i for r in got for i in r["doc_ids"]} == {1, 2, 3, 4, 5, 6, None}
    assert token_output.training_records(docs(spark, [])).collect() == []
    assert token_output.sharded_records(docs(spark, [])).collect() == []


def test_pages(spark):
    rows = [(1, None, None, "x"), (None, "", "", "x"), (2, "u", "<p>a<b", "x"), (2, "u", "<p>a<b", "x"), (3, "http://a/b", "<div>" * 50_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert len(html_text.extract_text(pages).collect()) == 5
    assert html_text.extract_text(pages.limit(0)).collect() == []
    assert len(url_rules.judge_urls(pages, []).collect()) == 5
    assert url_rules.judge_urls(pages.limit(0), []).collect() == []
    records = fixity.warc_records(pages)
    assert records.count() == 5
    assert fixity.audit(records, records).collect() == []
    assert len(fixity.audit(records, records.limit(0)).collect()) == 5
    assert fixity.audit(records.limit(0), records.limit(0)).collect() == []


@pytest.mark.parametrize("name, function", corpus_pipeline.STAGES)
def test_stages(spark, odd, labels, benchmark, tmp_path, name, function):
    for table, frame in (("documents", odd), ("labels", labels), ("benchmark", benchmark)):
        frame.write.parquet(f"{tmp_path}/{table}.parquet")
    got = function(spark, odd, str(tmp_path))
    if name != "token records":
        assert got.columns == odd.columns and got.dtypes == odd.dtypes
    assert got.count() > 0
    assert function(spark, odd.limit(0), str(tmp_path)).count() == 0
