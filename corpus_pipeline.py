"""From documents to training records: toxicity, near duplicates, benchmark items, mixing, token output.

Each stage is a function of (spark, docs, sf_dir) that returns the documents it leaves, with their columns;
the last returns token records. Every stage works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardcast.llm import decontaminate, jaccard, mixing, token_output, toxicity
from wardcast.llm.queries import domains
from wardcast.llm.shared import stage, table

#: Shares of the tokens by domain; every document is kept at least once. Toxic ones are gone by then.
TARGETS = {"high": 0.85, "low": 0.15}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the threshold; learned from the labelled documents of the table."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8."""
    return jaccard.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, not with a few edits either."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, and as often as its rate says, so that domains meet their targets."""
    fit = mixing.Fit(floor=1.0, keep_all=True)
    return mixing.mixed(docs, domains(table(spark, sf_dir, "labels")), TARGETS, fit=fit)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of all documents in training order, as they lie in the written shards."""
    return token_output.sharded_records(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("mixing", mix),
    ("token records", token_records),
]

#: Learned models, edit distances and token vocabularies are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; what a stage returns is written and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
