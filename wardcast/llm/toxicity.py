"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words and their beginnings. A bounded sample of labelled rows gives all terms that speak for the
label, and one vector per row; equal vectors become one entry with its votes. The entries form
an inverted index in blocks: for each term and block the largest weight is known, so a query reads
blocks in the order of their upper bounds and stops once none can beat its k-th neighbour, which is
exact. Neighbours vote with the square of their cosine, drawn towards the rate of rows without any
term. The index is bounded by the sample and is broadcast; every text is scored whole where it
is read, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.llm.shared import Sent, fields_udf, give_back, ship, stage

#: Numbers of the index's terms with their counts, in order.
Key = tuple[tuple[int, int], ...]
#: Texts whose score a worker keeps, for copies.
KNOWN = 60_000
#: Words whose terms a worker keeps.
KNOWN_WORDS = 300_000
WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (5, 7)


@dataclass(frozen=True)
class Settings:
    #: About so many labelled rows, chosen by a hash of their id, are learned from.
    sample: int = 20_000
    #: The index has every term that passes this (the 0.001 level) and is in enough sampled texts.
    least_chi_square: float = 10.83
    least_texts: int = 5
    neighbours: int = 25
    block: int = 64
    #: Blocks with the largest bounds that are read before others are passed over.
    first_blocks: int = 4
    #: Weight of the rate of texts without terms in each vote.
    smoothing: float = 1.0
    threshold: float = 0.3


def terms(text: str | None) -> Counter[str]:
    """Counts of words, and of beginnings of longer words (marked by a star)."""
    found: Counter[str] = Counter()
    for word, n in Counter(WORD.findall((text or "").lower())).items():
        found[word] += n
        for size in BEGINNINGS:
            if len(word) > size:
                found[word[:size] + "*"] += n
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, sample: int) -> DataFrame:
    """(_id, _text, _y) of about ``sample`` labelled rows. An id with several labels has the largest."""
    own = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).dropna()
    own = own.groupBy("_id").agg(F.max("_y").alias("_y"))
    total = own.count()
    if total > sample:
        share = int(sample / total * (1 << 30))
        own = own.filter(F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 30)) < share)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    held = texts.join(F.broadcast(own), "_id")  # 12 bytes a row, at most about ``sample`` rows
    # An id that repeats is one example, whatever its rows: the text with the smallest hash.
    one = held.groupBy("_id", "_y").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), "_text")).alias("_one"))
    return stage(one.select("_id", "_one._text", "_y"), "labelled")


def term_counts(labelled: DataFrame) -> DataFrame:
    """(term, n, n_toxic): labelled texts with each term; summed within a task before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, toxic = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch["_text"], batch["_y"]):
                own = terms(text)
                texts.update(own.keys())
                if y:
                    toxic.update(own.keys())
            if len(texts) > 500_000:
                yield pd.DataFrame([(t, n, toxic[t]) for t, n in texts.items()], columns=["term", "n", "n_toxic"])
                texts, toxic = Counter(), Counter()
        yield pd.DataFrame([(t, n, toxic[t]) for t, n in texts.items()], columns=["term", "n", "n_toxic"])
        texts, toxic = Counter(), Counter()
        give_back()

    ship()
    counts = labelled.select("_text", "_y").mapInPandas(count, "term string, n long, n_toxic long")
    return counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))


def chi_square(total: int, toxic: int) -> Column:
    """Of a term's presence and the label."""
    n, a = F.col("n").cast("double"), F.col("n_toxic").cast("double")
    b, c = n - a, toxic - a
    d = total - toxic - b
    product = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(product > 0, total * (a * d - b * c) * (a * d - b * c) / product).otherwise(0.0)


def packed(key: Key) -> bytes:
    return np.array(key, np.int32).tobytes()


def key_of(counts: dict[str, int], number: dict[str, int]) -> Key:
    """The index's terms in a text, with how often they occur."""
    return tuple(sorted((number[t], n) for t, n in counts.items() if t in number))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of ranges, one range after the other."""
    shift = np.repeat(starts - np.cumsum(lengths) + lengths, lengths)
    return np.arange(len(shift)) + shift


class Index:
    """Labelled vectors by term and block, with the largest weight of each.

    ``rows`` are (id, label, counts of terms); counts may be packed, which a driver holds in little space.
    """

    def __init__(self, idf: dict[str, float], rows: list[tuple[int, int, dict[str, int] | bytes]], settings: Settings):
        self.settings, self.by_number = settings, np.array(list(idf.values()), float)
        self.number, self.names = {t: i for i, t in enumerate(idf)}, list(idf)
        same: dict[bytes, list] = defaultdict(lambda: [0, 0, None])
        without = [0, 0]
        for id_, y, counts in rows:
            key = counts if isinstance(counts, bytes) else packed(self.key(counts))
            if not key:
                without[0] += 1
                without[1] += y
                continue
            entry = same[key]
            entry[0] += 1
            entry[1] += y
            entry[2] = id_ if entry[2] is None else min(entry[2], id_)
        n, toxic = len(rows), sum(y for _, y, _ in rows)
        self.base = without[1] / without[0] if without[0] else toxic / n if n else 0.0
        # Vectors that share their strongest terms come to stand together, which sharpens the bounds.
        keys = sorted(same, key=self.by_strength)
        self.n = np.array([same[k][0] for k in keys], float)
        self.toxic = np.array([same[k][1] for k in keys], float)
        self.ids = np.empty(len(keys), object)
        self.ids[:] = [same[k][2] for k in keys]
        #: Place of each entry by its id, whatever the type of ids.
        self.place = np.empty(len(keys), np.int64)
        self.place[sorted(range(len(keys)), key=lambda e: self.ids[e])] = np.arange(len(keys))
        self.blocks = -(-len(keys) // settings.block)
        self.index_postings(keys)
        self.known: dict[bytes, tuple] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def by_strength(self, key: bytes) -> tuple[bytes, bytes]:
        """An order of keys: by their terms, heaviest first, then by all they hold."""
        own = np.frombuffer(key, np.int32).reshape(-1, 2)
        weight = (1 + np.log(own[:, 1])) * self.by_number[own[:, 0]]
        return own[np.argsort(-weight, kind="stable"), 0].astype(">i4").tobytes(), own.astype(">i4").tobytes()

    def index_postings(self, keys: list[bytes]) -> None:
        """Postings (entry, weight) by term, then entry, in flat arrays; the postings of a term in a block are a run.

        Of a run its block, where it begins and ends, and its largest weight are known; ``runs_of`` has where the
        runs of each term begin.
        """
        own = np.frombuffer(b"".join(keys), np.int32).reshape(-1, 2)
        entry = np.repeat(np.arange(len(keys)), [len(k) // 8 for k in keys])
        weight = (1 + np.log(own[:, 1])) * self.by_number[own[:, 0]]
        if len(keys):
            weight /= np.sqrt(np.bincount(entry, weight * weight))[entry]
        order = np.argsort(own[:, 0], kind="stable")
        term, self.entries, self.weights = own[order, 0], entry[order], weight[order]
        block = self.entries // self.settings.block
        starts = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(block) != 0)][: len(term)])
        self.run_start, self.run_block = starts, block[starts]
        self.run_length = np.diff(np.r_[starts, len(term)])
        self.run_most = np.maximum.reduceat(self.weights, starts) if len(starts) else np.zeros(0)
        self.runs_of = np.searchsorted(term[starts], np.arange(len(self.names) + 1))

    def key(self, counts: dict[str, int]) -> Key:
        return key_of(counts, self.number)

    def weight(self, term: int, n: int) -> float:
        return (1 + math.log(n)) * self.by_number[term]

    def vector(self, key: tuple) -> list[tuple[int, float]]:
        own = [(t, self.weight(t, n)) for t, n in key]
        norm = math.sqrt(sum(w * w for _, w in own))
        return [(t, w / norm) for t, w in own]

    def nearest(self, key: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Entries with the largest cosines and these, nearest first, ties by id; exact."""
        own, k, size = self.vector(key), self.settings.neighbours, self.settings.block
        asked = np.array([t for t, _ in own])
        length = self.runs_of[asked + 1] - self.runs_of[asked]
        runs, by = ranges(self.runs_of[asked], length), np.repeat([w for _, w in own], length)
        block = self.run_block[runs]
        upper = np.bincount(block, by * self.run_most[runs], minlength=self.blocks)
        first = np.zeros(self.blocks, bool)
        most = min(self.settings.first_blocks, self.blocks)
        first[np.argpartition(-upper, most - 1)[:most]] = True
        in_first = first[block]
        totals = np.zeros(self.blocks * size)
        self.add(totals, runs[in_first], by[in_first])
        seen = totals.reshape(-1, size)[first].ravel()
        least = np.partition(seen, -k)[-k] if len(seen) > k else 0.0
        more = ~in_first & (upper[block] >= least - 1e-9)
        self.add(totals, runs[more], by[more])
        found = np.flatnonzero((totals > 0) & (totals >= least - 1e-9))
        if len(found) > k:
            found = found[totals[found] >= np.partition(totals[found], -k)[-k] - 1e-9]
        found = found[np.lexsort((self.place[found], -totals[found].round(9)))][:k]
        return found, totals[found]

    def add(self, totals: np.ndarray, runs: np.ndarray, by: np.ndarray) -> None:
        """Cosines from the postings of some runs, each weighed by its term's weight in the query."""
        length = self.run_length[runs]
        at = ranges(self.run_start[runs], length)
        totals += np.bincount(self.entries[at], np.repeat(by, length) * self.weights[at], minlength=len(totals))

    def read(self, text: str | None) -> Key:
        """``key(terms(text))``, with the terms of each word looked up once."""
        counts: dict[int, int] = {}
        for word, n in Counter(WORD.findall((text or "").lower())).items():
            own = self.words.get(word)
            if own is None:
                if len(self.words) > KNOWN_WORDS:
                    self.words.clear()
                begins = [word[:size] + "*" for size in BEGINNINGS if len(word) > size]
                own = self.words[word] = tuple(self.number[t] for t in (word, *begins) if t in self.number)
            for t in own:
                counts[t] = counts.get(t, 0) + n
        return tuple(sorted(counts.items()))

    def score(self, counts: dict[str, int]) -> tuple[float, list[int], list[str]]:
        """Score, ids of the neighbours that voted, and the terms."""
        return self.score_key(self.key(counts))

    def score_key(self, key: Key) -> tuple[float, list[int], list[str]]:
        """``score`` of a text with these terms."""
        if not key:
            return self.base, [], []
        asked = packed(key)
        if asked not in self.known:
            if len(self.known) > KNOWN:
                self.known.clear()
            found, cosines = self.nearest(key)
            need = np.searchsorted(np.cumsum(self.n[found]), self.settings.neighbours) + 1
            found, votes = found[:need], cosines[:need] ** 2
            weight = self.settings.smoothing
            share = float(votes @ self.toxic[found] + weight * self.base) / float(votes @ self.n[found] + weight)
            self.known[asked] = share, self.ids[found].tolist(), [self.names[t] for t, _ in key]
        return self.known[asked]


def learn(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, settings: Settings) -> dict:
    """What the index is made of: a weight for each term that passes the tests, and the vectors of the sampled rows."""
    rows = labelled_sample(docs, labels, label, id_col, text_col, settings.sample)
    total, toxic = rows.agg(F.count("*"), F.sum(F.when(F.col("_y") > 0, 1).otherwise(0))).first()
    if not total:
        return {"idf": {}, "rows": []}
    counted = term_counts(rows).filter(F.col("n") >= settings.least_texts)
    telling = counted.filter(F.col("n_toxic") * total > F.col("n") * (toxic or 0))
    strength = chi_square(total, toxic)
    telling = telling.filter(strength >= settings.least_chi_square)
    best = sorted(telling.select("term", "n", strength.alias("_s")).collect(), key=lambda r: (-r["_s"], r["term"]))
    idf = {r["term"]: math.log((total + 1) / (r["n"] + 1)) + 1 for r in best}

    number = {t: i for i, t in enumerate(idf)}

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = [packed(key_of(terms(x), number)) for x in batch["_text"]]
            yield pd.DataFrame({"_id": batch["_id"], "_y": batch["_y"], "_t": kept})
        give_back()

    kind = rows.schema["_id"].dataType.simpleString()
    found = rows.mapInPandas(vectors, f"_id {kind}, _y int, _t binary").toArrow()  # about ``sample`` rows
    ids, labels_, held = (found.column(c).to_pylist() for c in ("_id", "_y", "_t"))
    return {"idf": idf, "rows": sorted(zip(ids, (int(y > 0) for y in labels_), held), key=lambda r: (r[0], r[1]))}


def score_batch(model: Sent, settings: Settings, texts: pd.Series) -> pd.DataFrame:
    index = model.made(lambda m: Index(m["idf"], m["rows"], settings))
    return pd.DataFrame([index.score_key(index.read(t)) for t in texts], columns=["score", "neighbours", "terms"])


def toxicity(
    docs: DataFrame,
    training: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    settings: Settings = Settings(),
) -> Column:
    """A struct for each text of ``docs``: score (0 to 1), neighbours (ids of the examples that voted), terms.

    ``training`` holds the texts of ``labels``; only rows with an id and a label are learned from. Null and empty
    texts, and texts without any term of the index, have the rate of sampled texts without terms; with nothing
    to learn from every score is 0. The score depends on the text alone.
    """
    model = Sent(docs.sparkSession, learn(training, labels, label, id_col, text_col, settings))
    kind = labels.schema[id_col].dataType.simpleString()
    scored = fields_udf(score_batch, f"score double, neighbours array<{kind}>, terms array<string>", model, settings)
    return scored(F.col(text_col))


def score_documents(
    docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
    label: str = "toxic", settings: Settings = Settings(),
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted, neighbours, terms.

    ``held_out`` is a condition on the id; labels of such rows are not looked at, null ids are not
    held out. Repeated rows are kept; an empty table gives an empty result.
    """
    fold = F.coalesce(held_out, F.lit(False))
    found = toxicity(docs, docs, labels.filter(~fold), label, id_col, text_col, settings)
    rows = docs.select(F.col(id_col), fold.alias("held_out"), found.alias("_s"))
    predicted = (F.col("_s.score") >= settings.threshold).cast("int").alias("predicted")
    return rows.select(id_col, "held_out", "_s.score", predicted, "_s.neighbours", "_s.terms")


def without_toxic(
    docs: DataFrame, training: DataFrame, labels: DataFrame, settings: Settings = Settings(), text_col: str = "text"
) -> DataFrame:
    """Rows of ``docs``, all columns, without those that the index shows to be toxic.

    A row goes if its score reaches the threshold and it has a term of the index: a text without any, an empty or null one
    too, has the rate of its like for a score, which is no evidence against it. So rows all stay if there is nothing to
    learn from. Repeated rows share their fate; an empty table gives an empty result.
    """
    found = toxicity(docs, training, labels, text_col=text_col, settings=settings)
    return docs.filter((found["score"] < settings.threshold) | (F.size(found["terms"]) == 0))
