"""Exact duplicates by recipes: lists of content-defined chunks.

A rolling hash over the bytes of a text sets chunk borders, so equal passages give equal chunks
wherever they stand. A document becomes a recipe, the list of its chunks' identifiers; only recipes
are shuffled, texts never. Identifiers are verified: each comes with a piece of the chunk's SHA-256, and an
identifier with two of them is not trusted. Recipes that hold such a one are compared by the SHA-256 of
the whole text as well, so a collision of short hashes can't join different texts.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardcast.llm.shared import fields_udf, stage

RUNS = re.compile("[\x20\x09-\x0d]+")
SHORTEST, LONGEST, BORDER_BITS = 512, 16_384, 11
#: Bytes that are hashed at once; longer texts are read in slices that overlap by the window.
SLICE, WINDOW = 1 << 20, 32
#: One random 32-bit number for each value of a byte.
GEAR = np.random.RandomState(20).randint(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)


def normal(text: str | None) -> str:
    """Each run of ASCII white space as one space; null as empty."""
    return RUNS.sub(" ", text or "")


def candidates(data: bytes) -> np.ndarray:
    """Positions after which the rolling hash of the last 32 bytes allows a border."""
    out = []
    for start in range(0, len(data), SLICE):
        low = max(0, start - WINDOW + 1)
        rolled = GEAR[np.frombuffer(data, np.uint8, min(start + SLICE, len(data)) - low, low)]
        step = 1
        while step < WINDOW:  # doubles the window: h(2w) = h(w) + 2^w * h(w), shifted by w bytes
            rolled[step:] += rolled[:-step] << np.uint32(step)
            step *= 2
        at = np.flatnonzero(rolled >> np.uint32(32 - BORDER_BITS) == 0) + low + 1
        out.append(at[at > start])
    return np.concatenate(out) if out else np.empty(0, np.int64)


def chunks(data: bytes) -> list[bytes]:
    """Content-defined pieces of 512 bytes to 16 KiB (the last may be shorter); none of an empty text."""
    cut, last = [], 0
    for at in [*candidates(data).tolist(), len(data)] if len(data) > SHORTEST else [len(data)]:
        while at - last > LONGEST:
            last += LONGEST
            cut.append(last)
        if at - last >= SHORTEST or at == len(data) and at > last:
            cut.append(at)
            last = at
    return [data[a:b] for a, b in zip([0, *cut], cut)]


def chunk_id(chunk: bytes, id_bytes: int) -> bytes:
    return xxhash.xxh3_128_digest(chunk)[:id_bytes]


def recipes(id_bytes: int, texts: pd.Series) -> pd.DataFrame:
    """Digest of each text, its recipe (identifier and length of each chunk), and what verifies them."""
    rows = []
    for text in texts:
        data = normal(text).encode("utf-8", "replace")
        pieces = chunks(data)
        ids = [xxhash.xxh3_128_digest(c)[:id_bytes] + len(c).to_bytes(4, "big") for c in pieces]
        proofs = [int.from_bytes(hashlib.sha256(c).digest()[:16], "big") for c in pieces]
        checks = [{"chunk": i, "high": signed(p >> 64), "low": signed(p & MASK)} for i, p in zip(ids, proofs)]
        rows.append((hashlib.sha256(data).hexdigest(), b"".join(ids), checks))
    return pd.DataFrame(rows, columns=["text_sha256", "recipe", "chunks"])


MASK = (1 << 64) - 1
RECIPE = "text_sha256 string, recipe binary, chunks array<struct<chunk binary, high long, low long>>"


def signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def document_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bytes: int = 16) -> DataFrame:
    """Each row's recipe, written once: texts are read here and nowhere else, and never shuffled."""
    recipe = fields_udf(recipes, RECIPE, id_bytes)
    rows = docs.select(F.col(id_col).alias("_id"), recipe(F.col(text_col)).alias("_r"))
    return stage(rows.select("_id", "_r.*"), "recipes")


def chunk_table(recipe_rows: DataFrame) -> DataFrame:
    """One row per chunk identifier: uses, and whether SHA-256 proves all its contents equal.

    Counts and extremes are fixed-width sums that are formed before the shuffle, so a
    chunk of a third of all documents is one row a task.
    """
    uses = recipe_rows.select(F.explode("chunks").alias("c")).select("c.*")
    high, low = F.col("high"), F.col("low")
    return uses.groupBy("chunk").agg(
        F.count("*").alias("n_uses"),
        ((F.min(high) == F.max(high)) & (F.min(low) == F.max(low))).alias("verified"),
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bytes: int = 16) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when they are after runs of ASCII white space became one space; null counts as
    empty, and empty texts are equal to each other. Of a group the smallest id stays; null ids
    come last, so keep_id is null only where a group has none else. Rows that repeat the id that
    stays are all kept. Only the two named columns are read; an empty table gives an empty result.
    ``id_bytes`` below 16 makes collisions likely and serves tests: results stay exact.
    """
    rows = document_recipes(docs, id_col, text_col, id_bytes)
    doubtful = chunk_table(rows).filter(~F.col("verified")).select("chunk")
    held = rows.select("recipe", F.explode("chunks.chunk").alias("chunk")).join(doubtful, "chunk", "left_semi")
    doubtful_recipes = held.select("recipe").distinct().withColumn("_doubt", F.lit(True))
    keyed = rows.drop("chunks").join(doubtful_recipes, "recipe", "left").select(
        "_id", "recipe", "text_sha256",
        F.when(F.col("_doubt"), F.col("text_sha256")).otherwise("").alias("_proof"),
    )
    groups = keyed.groupBy("recipe", "_proof").agg(F.min("_id").alias("keep_id"), F.count("*").alias("group_size"))
    return keyed.join(groups, ["recipe", "_proof"]).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        (F.octet_length("recipe") / (id_bytes + 4)).cast("int").alias("n_chunks"),
    )
