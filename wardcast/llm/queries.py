"""Queries of the operators with production parameters, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcast.llm import (
    decontaminate, exact_dedup, fixity, hard_negatives, html_text, jaccard, mixing, prefix_trie, repeats, secret_scan, token_output, toxicity, url_rules,
)
from wardcast.llm.shared import stage, table

#: Rules of the URL contract (fixed values).
URL_RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
    ("allow", "com/fr/"), ("block", "com/de/"),
)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.sharded_records(table(spark, sf_dir, "documents"))


def damaged(pages: DataFrame) -> DataFrame:
    """The replica of the audit query: by the checksum of the id, some bodies have another last character."""
    at = F.crc32(F.col("page_id").cast("string")) % 50
    body = F.col("html")
    cut = F.concat(body.substr(F.lit(1), F.length(body) - 1), F.lit("~"))
    return pages.withColumn("html", F.when((at == 7) & (F.length(body) > 0), cut).otherwise(body))


def op3_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' WARC records against a replica with changed, missing and added records."""
    pages = table(spark, sf_dir, "pages")
    at = F.crc32(F.col("_id").cast("string")) % 50
    records = fixity.warc_records(damaged(pages))
    doubled = records.filter(at == 13).withColumn("offset", F.col("offset") + 1)
    return fixity.audit(fixity.warc_records(pages), records.filter(at != 11).unionByName(doubled))


#: Three words and 0.9, as the contract of the join fixes it.
LINKS = jaccard.Near(words=3, threshold=jaccard.Threshold(90, 100))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"), near=LINKS)


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_rules.parse_rule(*r) for r in URL_RULES]
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


#: Shares of the tokens by domain.
TARGETS = {"high": 0.85, "low": 0.10, "toxic": 0.05}


def domains(labels: DataFrame) -> DataFrame:
    """Domains of the labelled table: toxic, else high or low by quality."""
    by_quality = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise(by_quality).alias("domain"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return mixing.mixture(docs, domains(labels), TARGETS)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return toxicity.score_documents(docs, labels, held_out)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; every seventh id has the next label."""
    id_, label = F.col("vec_id"), F.col("label")
    moved = F.when(id_ % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.hard_negatives(rows, id_ % 100 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt conversations."""
    turns = prefix_trie.turn_digests(table(spark, sf_dir, "conversations"))
    turns = stage(prefix_trie.numbered(turns), "numbered")
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(turns), turns.select("conv").distinct())


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {
    f.__name__: f
    for f in (
        op1_secrets, op2_token_records, op3_fixity_audit, op4_jaccard_join, op5_url_rules, op6_mixing, op7_html_text, op8_toxicity, op9_decontaminate, op10_exact_dedup,
        op11_hard_negatives, op12_prefix_trie, op13_repeats,
    )
}
