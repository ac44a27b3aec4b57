"""Documents that hold a test item, word for word or with a few edits.

Pigeonhole: an item of m words with at most k edits still holds one of any k + 1 pieces of it
unchanged. The pieces of all items are looked up in a document with one Aho-Corasick pass; around
each hit Myers' bit-parallel distance finds the best place of the whole item. Items are
broadcast in blocks of a fixed size, so their number is not bounded; each document is read in its
place, whole, and documents are never shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from wardcast.llm.shared import Sent, stage, value_udf

WORD = re.compile(r"[^\W_]+")
#: Scripts written without spaces: Thai, Lao, Burmese, Khmer, Tai, Balinese, Javanese, kana, Chinese characters.
UNSPACED = (
    "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u1b00-\u1b7f\u3005-\u3007\u3021-\u3029\u3031-\u3035\u303b\u3040-\u30ff"
    "\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua980-\ua9ff\uaa60-\uaadf\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff"
)
#: Their vowel signs and tones, which go with the character before.
SIGNS = "".join(c for c in map(chr, range(0x0E00, 0xAAE0)) if re.match(f"[{UNSPACED}]", c) and unicodedata.category(c)[0] == "M")
ANY_UNSPACED = re.compile(f"[{UNSPACED}]")
CHARACTER_OR_WORD = re.compile(rf"(?![\W_])[{UNSPACED}][{SIGNS}]*|[^\W_{UNSPACED}]+")


@dataclass(frozen=True)
class Edits:
    """``budget`` edits for every ``per`` words of an item, rounded down; shorter items are looked for word for word."""

    budget: int = 1
    per: int = 8
    #: Items under so many words are not looked for. With 1, an item of a single word marks every text with that word.
    least: int = 1

    def of(self, words: int) -> int:
        return words * self.budget // self.per


def words(text: str | None) -> list[str]:
    """Letters and digits in lower case; punctuation and white space only part words.

    In scripts without spaces every character is a word.
    """
    if not text:
        return []
    text = text.lower()
    return (CHARACTER_OR_WORD if not text.isascii() and ANY_UNSPACED.search(text) else WORD).findall(text)


def pieces(length: int, count: int) -> list[tuple[int, int]]:
    """``count`` spans that cover ``length`` words as evenly as they can."""
    return [(length * i // count, length * (i + 1) // count) for i in range(count)]


def masks(pattern: list[str]) -> dict[str, int]:
    """For each word of the pattern, a bit at each of its places."""
    found: dict[str, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        found[w] |= 1 << i
    return dict(found)


def best_end(eq: dict[str, int], length: int, text: list[str]) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of ``text``, and the first end that has it.

    Bit-parallel: one bit for each word of the pattern, one step for each word of the text.
    """
    every, top = (1 << length) - 1, 1 << (length - 1)
    up, down, score = every, 0, length
    best, end = length, 0
    for i, w in enumerate(text):
        x = eq.get(w, 0)
        diagonal = (((x & up) + up) ^ up) | x | down
        right, left = down | (every & ~(diagonal | up)), up & diagonal
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right, left = (right << 1) & every, (left << 1) & every  # a match may begin anywhere
        up, down = left | (every & ~(diagonal | right)), right & diagonal
        if score < best:
            best, end = score, i + 1
    return best, end


class Matcher:
    """Items of one block, ready to be looked up."""

    def __init__(self, items: list[tuple[int, list[str]]], edits: Edits):
        import ahocorasick

        self.items = {i: (len(w), edits.of(len(w)), masks(w), masks(w[::-1])) for i, w in items}
        held: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, w in items:
            for a, b in pieces(len(w), edits.of(len(w)) + 1):
                held[f" {' '.join(w[a:b])} "].append((i, a))
        self.machine = ahocorasick.Automaton()
        for text, places in held.items():
            self.machine.add_word(text, (len(text), places))
        if held:
            self.machine.make_automaton()

    def places(self, text: list[str]) -> Iterator[tuple[int, int]]:
        """Item and the word of ``text`` where it would begin, for each exact piece hit."""
        joined = f" {' '.join(text)} "
        at = starts = None
        for end, (size, found) in self.machine.iter(joined):
            if starts is None:  # the word that begins after each space
                starts, at = {}, 0
                for n, w in enumerate(text):
                    starts[at] = n
                    at += len(w) + 1
            first = starts[end + 1 - size]
            for item, offset in found:
                yield item, first - offset

    def matches(self, text: list[str]) -> list[tuple[int, int, int, int]]:
        """(distance, item, first word, end word) of the best place of each item within its budget."""
        if not self.items or not text:
            return []
        spans: dict[int, list[list[int]]] = defaultdict(list)
        for item, start in self.places(text):
            length, k, _, _ = self.items[item]
            low, high = max(0, start - k), min(len(text), start + length + k)
            if spans[item] and low <= spans[item][-1][1]:  # hits come in the order of the text
                spans[item][-1][1] = max(high, spans[item][-1][1])
                spans[item][-1][0] = min(low, spans[item][-1][0])
            else:
                spans[item].append([low, high])
        out = []
        for item, parts in spans.items():
            length, k, eq, back = self.items[item]
            best = (k + 1, 0, 0)  # distance, first word, end
            for low, high in parts:
                distance, end = best_end(eq, length, text[low:high])
                if distance < best[0]:
                    # The same from the end found, backwards, gives the start.
                    _, size = best_end(back, length, text[max(low, low + end - length - k) : low + end][::-1])
                    best = (distance, low + end - size, low + end)
            if best[0] <= k:
                out.append((best[0], item, *best[1:]))
        return sorted(out)


NAMES = ("distance", "item_id", "first_word", "end_word")


def search(items: Sent, edits: Edits, texts: pd.Series) -> pd.Series:
    own = items.made(lambda rows: Matcher(rows, edits))
    return pd.Series([[dict(zip(NAMES, m)) for m in own.matches(words(t))] for t in texts], dtype=object)


def item_length(texts: pd.Series) -> pd.Series:
    return pd.Series([len(words(t)) for t in texts], dtype="int64")


def item_blocks(
    benchmark: DataFrame, id_col: str, text_col: str, block: int, least: int = 1
) -> Iterator[list[tuple[int | str, list[str]]]]:
    """Items of ``least`` words and more, in blocks of about ``block`` words by a hash; one block in the driver at a time.

    Of items with the same text the smallest id stays; one without any id gets a number below zero
    from its text. Ids that are not whole numbers are taken as strings.
    """
    none = F.least(F.lit(-1), -F.abs(F.xxhash64("_text")))
    kind = id_type(benchmark, id_col)
    own = benchmark.select(F.col(id_col).cast(kind).alias("_id"), F.col(text_col).alias("_text"))
    own = own.filter(F.col("_text").isNotNull()).groupBy("_text").agg(F.min("_id").alias("_id"))
    own = own.withColumn("_id", F.coalesce("_id", none.cast(kind))).withColumn("_n", value_udf(item_length, "long")("_text"))
    own = stage(own.filter(F.col("_n") >= max(1, least)), "items")
    total = own.agg(F.sum("_n")).first()[0] or 0
    blocks = -(-total // block)
    for at in range(blocks):
        part = own.filter(F.pmod(F.xxhash64("_text", F.lit("block")), F.lit(blocks)) == at).select("_id", "_text")
        if rows := [(r["_id"], words(r["_text"])) for r in part.collect()]:
            yield rows


def id_type(benchmark: DataFrame, id_col: str) -> str:
    return "bigint" if isinstance(benchmark.select(id_col).schema[0].dataType, IntegralType) else "string"


def held_items(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    edits: Edits = Edits(),
    block: int = 1_000_000,
) -> Column:
    """A column for ``docs``: the items that each text holds, the nearest first, with places in words.

    Empty for null, empty and clean texts. Null items and those without any word are not looked for, and an
    empty benchmark finds nothing. Every block of items is applied to every text. Item ids stay whole numbers, others are
    given as strings.
    """
    spark = docs.sparkSession
    kind = f"array<struct<distance: int, item_id: {id_type(benchmark, item_id_col)}, first_word: int, end_word: int>>"
    found = F.array().cast(kind)
    for part in item_blocks(benchmark, item_id_col, item_text_col, block, edits.least):
        column = value_udf(search, kind, Sent(spark, part), edits)
        found = F.concat(found, column(F.col(text_col)))
    return F.array_sort(found)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: Edits = Edits()
) -> DataFrame:
    """One row per row of ``docs``: id, contaminated, the nearest item with its distance, all items held.

    Repeated rows and null ids are kept; other columns of either table are not read.
    """
    found = docs.select(F.col(id_col), held_items(docs, benchmark, text_col, edits=edits).alias("items"))
    nearest = F.get("items", F.lit(0))
    return found.select(
        id_col,
        (F.size("items") > 0).alias("contaminated"),
        nearest["item_id"].alias("item_id"),
        nearest["distance"].alias("distance"),
        "items",
    )


def without_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", edits: Edits = Edits()) -> DataFrame:
    """Rows of ``docs``, all columns, whose text holds no item."""
    return docs.filter(F.size(held_items(docs, benchmark, text_col, edits=edits)) == 0)
