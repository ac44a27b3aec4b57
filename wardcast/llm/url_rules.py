"""URL filter: host and path rules first, then a weighted vocabulary.

One Aho-Corasick automaton finds all terms of the vocabulary in one pass over a URL. A hit counts
if it stands between boundaries. One strict term rejects, and so do soft terms whose weights,
each distinct term once, reach a limit. Rules and terms are parameters of fixed length; each URL is
judged where it is read, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.llm.shared import fields_udf

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Terms of which one rejects a URL.
STRICT = ("porn", "porno", "xxx", "hentai", "xvideos", "sexcam", "sexcams", "camgirls", "warez", "keygen")
#: Terms with weights; several distinct ones reject.
SOFT = {
    "adult": 1.0, "sex": 1.5, "sexy": 1.0, "nude": 1.0, "naked": 1.0, "erotic": 1.5, "escort": 1.5,
    "dating": 0.5, "casino": 1.0, "poker": 1.0, "betting": 1.0, "jackpot": 1.0, "slots": 0.5,
    "viagra": 1.5, "cialis": 1.5, "pills": 0.5, "torrent": 1.0, "crack": 1.0, "serial": 0.5, "loan": 0.5,
}


@dataclass(frozen=True)
class Vocabulary:
    strict: tuple[str, ...] = STRICT
    soft: tuple[tuple[str, float], ...] = tuple(SOFT.items())
    #: Sum of the weights of distinct soft terms that rejects, and how many terms that takes.
    limit: float = 2.0
    distinct: int = 2


@dataclass(frozen=True)
class Rule:
    """A rule for a host with its subdomains and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str
    name: str = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "name", self.host + self.path)


def parse_rule(verdict: str, text: str) -> Rule:
    """``("block", "example.org/es/")`` as a rule: the path starts at the first slash."""
    host, slash, path = text.partition("/")
    return Rule(verdict, host.lower(), slash + path)


@lru_cache(maxsize=8)
def automaton(vocabulary: Vocabulary):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term in vocabulary.strict:
        found.add_word(term.lower(), (term.lower(), None))
    for term, weight in vocabulary.soft:
        if term not in vocabulary.strict:
            found.add_word(term.lower(), (term.lower(), weight))
    if len(found):
        found.make_automaton()
    return found


def hits(text: str, vocabulary: Vocabulary) -> Iterator[tuple[str, float | None]]:
    """Terms in ``text`` with no ASCII letter or digit before or after them; weight None: strict."""
    machine = automaton(vocabulary)
    if not len(machine):
        return
    edge = lambda c: not (c.isascii() and c.isalnum())
    for end, (term, weight) in machine.iter(text):
        start = end - len(term)
        if (start < 0 or edge(text[start])) and (end + 1 == len(text) or edge(text[end + 1])):
            yield term, weight


def judged(vocabulary: Vocabulary, urls: pd.Series) -> pd.DataFrame:
    rows = []
    for url in urls:
        strict, soft = set(), {}
        for term, weight in hits((url or "").translate(TO_LOWER), vocabulary):
            if weight is None:
                strict.add(term)
            else:
                soft[term] = weight
        weight = float(sum(soft[t] for t in sorted(soft)))
        bad = bool(strict) or len(soft) >= vocabulary.distinct and weight >= vocabulary.limit
        rows.append((len(strict), len(soft), weight, bad))
    return pd.DataFrame(rows, columns=["n_strict", "n_soft", "soft_weight", "rejected"])


TO_LOWER = str.maketrans(UPPER, LOWER)


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def judge_urls(
    pages: DataFrame,
    rules: list[Rule],
    vocabulary: Vocabulary = Vocabulary(),
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per row of ``pages``: id, host, path, the rule that fits, counts of hits and verdict.

    The longest rule that fits decides; of equally long ones the first listed. Without one the
    vocabulary decides. A null URL, or one without ``://``, has an empty host and path and no rule;
    the vocabulary still reads it whole (null as empty), so that a bare term is found. Repeated rows and
    null ids are kept; other columns are not read; an empty table gives an empty result.
    """
    counts = fields_udf(
        judged, "n_strict int, n_soft int, soft_weight double, rejected boolean", vocabulary
    )
    parts = pages.select(
        F.col(id_col),
        url_host(F.col(url_col)).alias("host"),
        url_path(F.col(url_col)).alias("path"),
        counts(F.col(url_col)).alias("_found"),
    )
    host, path = F.col("host"), F.col("path")
    name, verdict = F.lit(None).cast("string"), F.when(F.col("_found.rejected"), "block").otherwise("allow")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):  # what is put outside wins
        name = F.when(fits(rule, host, path), rule.name).otherwise(name)
        verdict = F.when(fits(rule, host, path), rule.verdict).otherwise(verdict)
    return parts.select(
        id_col, "host", "path", name.alias("rule"), verdict.alias("verdict"),
        "_found.n_strict", "_found.n_soft", "_found.soft_weight",
    )
