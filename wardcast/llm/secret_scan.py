"""Secrets in texts: three fixed patterns, and strings that a public vocabulary splits finely.

A token-efficiency test finds random strings: written language packs several characters into
one token of a byte-pair vocabulary, a random string hardly two. Runs of key characters with
fewer than ``most_ratio`` characters a token count as secrets, unless they are known digests or
identifiers. Each text is read once, in its place: no shuffle, and memory for one batch of texts.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardcast.llm.shared import VOCABULARIES, encoding, fields_udf

#: The base patterns of the contract, kinds in the order in which they are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Lengths of common digests in hexadecimal: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGESTS = (32, 40, 56, 64, 96, 128)

RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}")
HEXADECIMAL = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"(?:[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})+")
#: A few characters over and over: zeros, ``====``, ``-=-=``.
FILLER = re.compile(r"(.{1,4}?)\1{7,}")
#: Words, numbers and capitals of an identifier.
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass(frozen=True)
class Test:
    """Limits of the token-efficiency test."""

    vocabulary: str = f"{VOCABULARIES}/byte_bpe_50k.tiktoken"
    least_length: int = 20
    most_ratio: float = 2.2
    #: Repeated fillers such as ``====`` are no secrets: bits a character, at least.
    least_bits: float = 3.0
    #: Characters of a run that a base pattern found in part, beside that part, at least.
    least_beside: int = 12
    #: Long runs are encoded in slices, so that time grows with their length only.
    slice: int = 256


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the three patterns, leftmost and apart within a kind."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def excluded(run: str) -> bool:
    """Known digests and identifiers: digests by length, UUIDs, names, numbers, paths of words."""
    bare = run.rstrip("=")
    if HEXADECIMAL.fullmatch(bare):
        return len(bare) in DIGESTS or bare.isdigit()
    if UUID.fullmatch(bare) or not re.search("[A-Za-z]", bare) or not re.search("[0-9]", bare) and (bare.islower() or bare.isupper()):
        return True
    # A random string also splits into words and numbers, but into many short ones.
    parts = PARTS.findall(bare)
    whole = all(len(p) <= 14 if p.isdigit() else len(p) > 1 for p in parts[1:])
    return whole and len(bare) >= 4 * len(parts)


def bits(run: str) -> float:
    """Shannon entropy of the characters."""
    counts = Counter(run).values()
    return -sum(n / len(run) * math.log2(n / len(run)) for n in counts)


def is_random(run: str, test: Test) -> bool:
    """Whether the vocabulary needs many tokens for a run, and any slice of it is varied enough."""
    if len(run) < test.least_length or excluded(run):
        return False
    slices = sliced(run, test)
    return any(bits(s) >= test.least_bits for s in slices) and len(run) < test.most_ratio * n_tokens(slices, test)


def sliced(run: str, test: Test) -> list[str]:
    return [run[i : i + test.slice] for i in range(0, len(run), test.slice)]


def n_tokens(slices: list[str], test: Test) -> int:
    codec = encoding(test.vocabulary)
    return sum(len(codec.encode_ordinary(s)) for s in slices)


def between_fillers(run: str) -> list[str]:
    """What stands before, between and after fillers of a run, if it has any."""
    parts, at = [], 0
    for m in FILLER.finditer(run):
        parts.append(run[at : m.start()])
        at = m.end()
    return [*parts, run[at:]] if parts else []


def apart(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """What spans cover, as ranges that do not touch, in order; ``spans`` come by start."""
    ranges: list[tuple[int, int]] = []
    for a, b, _ in spans:
        if ranges and a <= ranges[-1][1]:
            ranges[-1] = ranges[-1][0], max(b, ranges[-1][1])
        else:
            ranges.append((a, b))
    return ranges


def beside(text: str, start: int, end: int, ranges: list[tuple[int, int]], starts: list[int]) -> list[str]:
    """The pieces of a run that no range covers: the whole run if none touches it."""
    pieces, at = [], start
    for a, b in ranges[max(0, bisect_right(starts, start) - 1) :]:
        if a >= end:
            break
        if a > at:
            pieces.append(text[at:a])
        at = max(at, b)
    return [*pieces, text[at:end]] if at < end else pieces


def rest_is_random(pieces: list[str], test: Test) -> bool:
    """Whether what stands beside base spans in a run is random, taken together."""
    rest = "".join(pieces)
    if len(rest) < test.least_beside or all(excluded(p) for p in pieces):
        return False
    slices = [s for p in pieces for s in sliced(p, test)]
    varied = any(bits(s) >= test.least_bits for s in sliced(rest, test))
    return varied and len(rest) < test.most_ratio * n_tokens(slices, test)


def random_spans(text: str, taken: list[tuple[int, int, str]], test: Test) -> list[tuple[int, int, str]]:
    """Runs that the vocabulary needs many tokens for, whole or but for their fillers.

    A run that ``taken`` covers is passed over; of one that it covers in part, such as a key with 24 hexadecimal
    digits inside, the rest is tested, and the whole run is the span.
    """
    found = []
    ranges = apart(taken)
    starts = [a for a, _ in ranges]
    for m in RUN.finditer(text):
        run = m[0]
        if len(run) < test.least_length:
            continue
        pieces = beside(text, m.start(), m.end(), ranges, starts)
        if pieces != [run]:
            hit = rest_is_random(pieces, test)
        else:
            hit = is_random(run, test) or not excluded(run) and any(is_random(p, test) for p in between_fillers(run))
        if hit:
            found.append((m.start(), m.end(), "random"))
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(text: str | None, test: Test = Test(), reveal: bool = False) -> dict:
    """What ``find_secrets`` returns for one text."""
    text = text or ""
    base = base_spans(text)
    added = random_spans(text, base, test)
    every = sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))
    kinds = Counter(kind for _, _, kind in every)
    return {f"n_{k}": kinds[k] for k in KINDS} | {
        "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(),
        "spans": joined(every),
        "found": [text[a:b] if reveal else hashlib.sha256(text[a:b].encode("utf-8", "replace")).hexdigest() for a, b, _ in every],
    }


COUNTS = ", ".join(f"n_{k} long" for k in KINDS)


def scan_batch(test: Test, reveal: bool, texts: pd.Series) -> pd.DataFrame:
    columns = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "found"]
    return pd.DataFrame([scan(t, test, reveal) for t in texts], columns=columns)


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", test: Test = Test(), reveal: bool = False
) -> DataFrame:
    """One row per row of ``docs``: id, counts by kind, digest of the base spans, all spans, what they hold.

    ``found`` has the SHA-256 of each span's string, which tells equal secrets without spreading them; the strings
    themselves only with ``reveal``.
    Offsets are code points, ends exclusive. A null or empty text has no spans (the digest is that
    of the empty string); repeated rows and null ids are kept as they are; other columns of ``docs``
    are not read. An empty table gives an empty result.
    """
    scanned = fields_udf(scan_batch, f"{COUNTS}, base_sha256 string, spans string, found array<string>", test, reveal)
    return docs.select(F.col(id_col), scanned(F.col(text_col)).alias("_found")).select(id_col, "_found.*")
