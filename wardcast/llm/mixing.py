"""Rates of documents under which the expected tokens of each domain match targets.

A naive Bayes classifier learned from a labelled table gives each document soft memberships in the
domains. The rates r solve a least-squares problem: with n tokens and memberships p, the sum of r * n * p
over all documents should be the target of each domain, and no rate may fall below a floor (0 by default) or rise above a limit.
Projected gradient steps are taken over the whole table: a step needs one sum per domain, the driver sees
only these, and every document updates its own rate.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.llm.shared import VOCABULARIES, Sent, encoding, fields_udf, free_name, give_back, ship, stage, value_udf
from wardcast.llm.signature_tree import SLICE, long_text_hashes, word_hashes


@dataclass(frozen=True)
class Classifier:
    #: About so many labelled rows, chosen by a hash of their id, are learned from.
    sample: int = 20_000
    buckets: int = 4_096
    #: A text counts as at most so many independent words.
    independent: float = 10.0
    smoothing: float = 0.5
    #: Tokens are counted under this vocabulary, without the end tokens of documents.
    vocabulary: str = f"{VOCABULARIES}/byte_bpe_multi_50k.tiktoken"


@dataclass(frozen=True)
class Fit:
    #: Least rate; 1 keeps every document.
    floor: float = 0.0
    #: Largest rate; it matters only where a target is next to out of reach, which is told.
    most: float = 100.0
    #: Tokens of the mixture: as many as the documents have, or (True) the least that needs no domain cut.
    keep_all: bool = False
    steps: int = 40
    #: Largest relative miss of a target that ends the steps.
    close: float = 1e-6
    #: A share further than this from its target at the end is told as a warning.
    miss: float = 0.005
    seed: int = 7


def counts(buckets: int, text: str | None) -> np.ndarray:
    """How often words of each bucket occur in a text."""
    data = (text or "").encode("utf-8", "replace").lower()
    hashes = word_hashes(data)[0] if len(data) < SLICE else long_text_hashes(data)
    return np.bincount((hashes % np.uint64(buckets)).astype(np.int64), minlength=buckets)


def learn(docs: DataFrame, domains: DataFrame, names: list[str], id_col: str, text_col: str, own: Classifier) -> dict:
    """Log probabilities (domains by buckets) and priors; ``domains`` has an id and a column ``domain``.

    A row counts if its id and domain are known; of several domains of one id the smallest name counts.
    """
    known = domains.select(F.col(id_col).alias("_id"), F.col("domain").alias("_domain")).filter(F.col("_domain").isin(names))
    known = known.filter(F.col("_id").isNotNull()).groupBy("_id").agg(F.min("_domain").alias("_domain"))
    total = known.count()
    if total > own.sample:
        share = int(own.sample / total * (1 << 30))
        known = known.filter(F.pmod(F.xxhash64("_id", F.lit("mixing")), F.lit(1 << 30)) < share)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known), "_id")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {d: np.zeros(own.buckets + 1) for d in names}
        for batch in batches:
            for text, d in zip(batch["_text"], batch["_domain"]):
                sums[d][:-1] += counts(own.buckets, text)
                sums[d][-1] += 1
        for d, values in sums.items():
            at = np.flatnonzero(values)
            yield pd.DataFrame({"domain": d, "bucket": at, "n": values[at]})
        give_back()

    ship()
    summed = rows.select("_text", "_domain").mapInPandas(add, "domain string, bucket int, n double")
    table = np.zeros((len(names), own.buckets + 1))
    for r in summed.groupBy("domain", "bucket").agg(F.sum("n").alias("n")).collect():  # domains * buckets at most
        table[names.index(r["domain"]), r["bucket"]] = r["n"]
    words = table[:, :-1] + own.smoothing
    priors = table[:, -1] + own.smoothing
    return {
        "log": np.log(words / words.sum(1, keepdims=True)).astype(np.float32),
        "prior": np.log(priors / priors.sum()),
    }


def shares(model: Sent, own: Classifier, texts: pd.Series) -> pd.Series:
    """Memberships of each text in the domains."""
    fixed = model.made(lambda m: m)
    rows = []
    for text in texts:
        found = counts(own.buckets, text)
        n = int(found.sum())
        at = np.flatnonzero(found)
        score = fixed["log"][:, at].astype(float) @ found[at] * (min(1.0, own.independent / n) if n else 0.0)
        score = score + fixed["prior"]
        share = np.exp(score - score.max())
        rows.append((share / share.sum()).tolist())
    return pd.Series(rows, dtype=object)


def classify(model: Sent, own: Classifier, texts: pd.Series) -> pd.DataFrame:
    codec = encoding(own.vocabulary)
    n = [len(codec.encode_ordinary(text)) if text else 0 for text in texts]
    return pd.DataFrame({"n_tokens": np.array(n, np.int64), "membership": shares(model, own, texts)})


def memberships(
    docs: DataFrame, domains: DataFrame, names: list[str], id_col: str = "doc_id", text_col: str = "text",
    own: Classifier = Classifier(),
) -> tuple[Column, Column]:
    """A struct for each text: n_tokens and membership, one share for each name, which sum to 1; and the latter alone."""
    model = Sent(docs.sparkSession, learn(docs, domains, names, id_col, text_col, own))
    both = fields_udf(classify, "n_tokens long, membership array<double>", model, own)(F.col(text_col))
    return both, value_udf(shares, "array<double>", model, own)(F.col(text_col))


def stepped(moves: list[np.ndarray], membership: Column, fit: Fit) -> Column:
    """The rate of a row after these steps: 1 at first, never below the floor or above the largest."""
    if not moves:
        return F.lit(1.0)
    listed = F.array(*(F.array(*(F.lit(float(x)) for x in m)) for m in moves))
    dot = lambda m: sum((membership[d] * m[d] for d in range(len(moves[0]))), F.lit(0.0))
    return F.aggregate(listed, F.lit(1.0), lambda rate, m: F.greatest(F.lit(fit.floor), F.least(F.lit(fit.most), rate - dot(m))))


def rate_steps(rows: DataFrame, targets: dict[str, float], fit: Fit) -> list[np.ndarray]:
    """The gradient steps of all rates; ``rows`` has n_tokens and membership, ``targets`` shares by domain.

    Minimises the misses of the targets, weighted by the inverse of sum(n * p * p'): in that measure a
    step of length 1 is safe, and without the floor the first meets the targets. With targets out of reach
    the rates come near the nearest possible, and a warning names targets and shares; without any token there is no step.
    """
    size, share = len(targets), np.array(list(targets.values()), float)
    share = share / share.sum()
    p, n = F.col("membership"), F.col("n_tokens")

    def sums(*columns: Column) -> np.ndarray:
        return np.array([x or 0.0 for x in rows.agg(*map(F.sum, columns)).first()])

    first = sums(*(n * p[d] for d in range(size)), *(n * p[a] * p[b] for a in range(size) for b in range(size)))
    present, inverse = first[:size], np.linalg.pinv(first[size:].reshape(size, size))
    if not present.sum():
        return []
    need = (present / np.maximum(share, 1e-12))[share > 0].max()
    goal = share * (need if fit.keep_all else present.sum())
    moves: list[np.ndarray] = []
    miss, best = present - goal, np.inf
    while len(moves) < fit.steps and fit.close < (worst := np.abs(miss).max() / goal.sum()) < best * (1 - 1e-4):
        best = worst
        moves.append(inverse @ miss)
        rate = stepped(moves, p, fit)
        miss = sums(*(n * rate * p[d] for d in range(size))) - goal
    got = (miss + goal) / (miss + goal).sum()
    if np.abs(got - share).max() > fit.miss:
        listed = ", ".join(f"{d} {g:.4f} for {w:.4f}" for d, g, w in zip(targets, got, share))
        warnings.warn(f"the mixture misses its targets after {len(moves)} steps: {listed}", stacklevel=3)
    return moves


def reached(rates: DataFrame, targets: dict[str, float], miss: float = Fit.miss) -> DataFrame:
    """One row per domain: domain, target, expected tokens and share of the rows of ``mixture``, met.

    Without any expected token shares are null and no target is met.
    """
    whole, p = sum(targets.values()), F.col("membership")
    sums = rates.agg(F.array(*(F.sum(F.col("n_tokens") * F.col("rate") * p[d]) for d in range(len(targets)))).alias("_t"))
    wanted = F.array(*(F.struct(F.lit(d).alias("domain"), F.lit(w / whole).alias("target")) for d, w in targets.items()))
    total = F.aggregate("_t", F.lit(0.0), lambda a, b: a + b)
    rows = sums.select(F.posexplode(wanted).alias("_at", "_w"), "_t", total.alias("_total"))
    tokens = F.coalesce(F.get("_t", "_at"), F.lit(0.0))
    share = F.try_divide(tokens, "_total")
    met = F.coalesce(F.abs(share - F.col("_w.target")) <= miss, F.lit(False))
    return rows.select("_w.domain", "_w.target", tokens.alias("expected_tokens"), share.alias("share"), met.alias("met"))


def copies(rate: Column, *key: Column, seed: int = 7) -> Column:
    """A whole number of copies whose expectation is the rate; one draw for each key."""
    draw = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("int")


def mixture(
    docs: DataFrame, domains: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
    own: Classifier = Classifier(), fit: Fit = Fit(),
) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, membership, rate, copies; ``reached`` tells how near they come.

    Null, empty and blank texts have no tokens and the memberships of the priors; their rates follow from these
    alone. Repeated rows have one rate and one draw; null ids draw by their text. Only the two named columns are
    read; an empty table gives an empty result. Without labelled rows memberships are even.
    """
    found, _ = memberships(docs, domains, list(targets), id_col, text_col, own)
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text"), found.alias("_m"))
    rows = stage(rows.select("_id", "_text", "_m.*"), "memberships")
    rate = stepped(rate_steps(rows, targets, fit), F.col("membership"), fit)
    drawn = copies(F.col("rate"), F.col("_id"), F.col("_text"), seed=fit.seed).alias("copies")
    return rows.withColumn("rate", rate).select(F.col("_id").alias(id_col), "n_tokens", "membership", "rate", drawn)


def mixed(
    docs: DataFrame, domains: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
    own: Classifier = Classifier(), fit: Fit = Fit(),
) -> DataFrame:
    """Rows of ``docs``, all columns, each as often as ``mixture`` says.

    The steps are found on a narrow table of counts and memberships; as a rate follows from the row's own
    memberships alone, the rows are not joined with it, and their tokens are counted once.
    """
    found, membership = memberships(docs, domains, list(targets), id_col, text_col, own)
    narrow = stage(docs.select(found.alias("m")).select("m.*"), "memberships")
    moves = rate_steps(narrow, targets, fit)
    name = free_name(docs, "_m")
    rate = stepped(moves, F.col(name), fit)
    drawn = copies(rate, F.col(id_col), F.xxhash64(text_col), seed=fit.seed)
    rows = docs.withColumn(name, membership).withColumn(name, drawn)
    return rows.withColumn(name, F.explode(F.array_repeat(F.lit(0), F.col(name)))).drop(name)
