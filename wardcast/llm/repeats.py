"""Removal of byte strings that occur earlier, by prefix-free parsing.

A rolling hash over the bytes sets triggers: of every window of 100 bytes, the place of its smallest hash of 32 bytes
(the leftmost of equal ones). Triggers depend on nothing but the window's bytes, so equal windows have
their trigger at the same place. The windows of one trigger, taken together, are its phrase. Phrases are
the dictionary, their occurrences in order of (document, place) the parse.

1. *Parse.* Occurrences are sorted by trigger and phrase, as numbers. A trigger that occurs once holds
   no repeated window. Of a phrase that occurs again, all but the first occurrence are repeats as a whole.
2. *Dictionary.* Only where a trigger has different phrases are windows left undecided. Those phrases' bytes are
   fetched and put into suffix arrays (by prefix doubling, to the depth of a window); suffixes of equal rank, in the order of
   the parse, are the corpus order: all but the first are repeats. Phrases of a trigger with more than a suffix array takes
   are sliced by the trigger's place in the window, and grouped by what all windows of a slice share.
3. Repeated windows become byte ranges of their documents, which are cut out.

Sorts are dealt by ranges and read as streams, suffix arrays are built over bounded numbers of
phrases, triggers whole; only slices that go on beyond one hand their windows to a last grouping by the windows' hashes. Texts move to
other tasks in no step but a join with their ranges, and there only if the ranges are too many to broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardcast.llm.shared import ship, stage

#: Bytes of a string that counts as repeated, and of the rolling hash.
LENGTH, GRAM = 100, 32
#: Positions that are hashed at once, and phrases of a suffix array.
SLICE, CHUNK = 1 << 20, 4_096
#: Entries up to which ranges are broadcast (16 bytes each).
BROADCAST_ENTRIES = 4_000_000
NO_ID = np.iinfo(np.int64).max
BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Two random odd numbers for each value of a byte.
BYTES = np.random.RandomState(13).randint(0, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base from 0 on, and their inverses, modulo 2 ** 64."""
    inverse = pow(BASE, -1, 1 << 64)
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)], dtype=np.uint64) for b in (BASE, inverse))


class Hashes:
    """Polynomial hashes of any piece of a slice, from sums over its beginnings."""

    def __init__(self, data: np.ndarray, lane: int = 0):
        n = -(-len(data) // SLICE) * SLICE  # few sizes, so that the powers are kept
        self.powers, self.inverse = powers(n)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTES[lane][data] * self.powers[: len(data)], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.inverse[start]

    def grams(self) -> np.ndarray:
        n = len(self.sums) - GRAM
        out = (self.sums[GRAM:] - self.sums[:n]) * self.inverse[:n]
        return scattered(out)


def scattered(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def smallest_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest value of each window, the leftmost of equal ones; windows double in width."""
    low, at, w = values, np.arange(len(values), dtype=np.int32), 1
    while w < width:
        step = min(w, width - w)
        left = low[:-step] <= low[step:]
        at = np.where(left, at[:-step], at[step:])
        low = np.minimum(low[:-step], low[step:])
        w += step
    return at


def phrases(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases of concatenated texts: start, number of windows, trigger's place in it, trigger's hash, phrase's hash.

    ``ends`` holds each text's end in ``data``; a window never leaves its text.
    """
    found = []
    for at in range(0, len(data) - LENGTH + 1, SLICE):
        part = data[at : at + SLICE + LENGTH - 1]
        hashes = Hashes(part)
        grams = hashes.grams()
        chosen = smallest_in_windows(grams, LENGTH - GRAM + 1)
        start = np.arange(len(chosen))
        text = np.searchsorted(ends, start + at, side="right")
        whole = start + at + LENGTH <= ends[text]
        start, chosen, text = start[whole], chosen[whole], text[whole]
        if not len(start):
            continue
        new = np.r_[True, (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])]
        first = np.flatnonzero(new)
        windows = np.diff(np.r_[first, len(start)])
        begin, trigger = start[first], chosen[first]
        name = hashes.of(begin, begin + windows - 1 + LENGTH)
        name = scattered(name + ((trigger - begin) * 128 + windows).astype(np.uint64) * MIX)
        found.append((begin + at, windows, trigger - begin, grams[trigger], name))
    kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
    return tuple(np.concatenate([f[k] for f in found]) if found else np.empty(0, kind) for k, kind in enumerate(kinds))


def new_rows(*columns: np.ndarray) -> np.ndarray:
    """Rows of sorted columns that differ from the row before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def merged(doc, copy, start, stop) -> tuple[np.ndarray, ...]:
    """Ranges of documents, those that touch or overlap as one."""
    order = np.lexsort((stop, start, copy, doc))
    doc, copy, start, stop = (c[order] for c in (doc, copy, start, stop))
    if not len(doc):
        return doc, copy, start, stop
    first = new_rows(doc, copy)
    # Ends that were reached so far, in one count over all documents: each document begins above the last.
    wide = int(stop.max()) + 2
    base = np.cumsum(first) * wide
    reach = np.maximum.accumulate(base + stop)
    begins = np.r_[True, base[1:] + start[1:] > reach[:-1]] | first
    at = np.flatnonzero(begins)
    return doc[at], copy[at], start[at], np.maximum.reduceat(stop, at)


# Packing of an occurrence: start, number of windows, place of the trigger; ranges have negative places.
KEYS = ["h", "x", "doc", "copy", "p"]
ROWS = ", ".join(f"{k} long" for k in KEYS)


def packed(start, windows, trigger) -> np.ndarray:
    return start << 14 | (windows - 1) << 7 | trigger


def unpacked(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the phrase."""
    return p >> 14, (p >> 14) + (p >> 7 & 127) + LENGTH


def batch_of(names: list[str], *columns) -> pa.RecordBatch:
    arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def concatenated(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each ends; null as empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends[1:] - ends[0]


def ids_of(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(NO_ID), np.int64)


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First occurrences of a batch's phrases, and ranges of those that it holds again."""
    for batch in batches:
        doc, copy = ids_of(batch.column(0)), ids_of(batch.column(1))
        data, ends = concatenated(batch.column(2))
        start, windows, trigger, h, x = phrases(data, ends)
        text = np.searchsorted(ends, start, side="right")
        doc, copy = doc[text], copy[text]
        start = start - np.r_[0, ends][text]
        p = packed(start, windows, trigger)
        order = np.lexsort((p, copy, doc, x, h))
        h, x, doc, copy, p = (c[order] for c in (h, x, doc, copy, p))
        first = new_rows(h, x)
        yield batch_of(KEYS, *(c[first] for c in (h, x, doc, copy, p)))
        # A row like the one before, document and place included, is the same text twice.
        again = ~first & new_rows(doc, copy, p)
        d, c, low, high = merged(doc[again], copy[again], *unpacked(p[again]))
        yield batch_of(KEYS, scattered(d.view(np.uint64) + low.view(np.uint64)), high, d, c, -low - 1)


MARKS = "doc long, copy long, start long, stop long, h long, p long"
MARK_NAMES = [f.split()[0] for f in MARKS.split(", ")]


def marks(ranges: tuple, asked: tuple) -> pa.RecordBatch:
    """Ranges (doc, copy, start, stop), and phrases to look at (doc, copy, h, p)."""
    n, m = len(ranges[0]), len(asked[0])
    columns = [np.concatenate([ranges[k], asked[k]]) for k in (0, 1)]
    arrays = [pa.array(c) for c in columns]
    arrays += [pa.concat_arrays([pa.array(r), pa.nulls(m, pa.int64())]) for r in ranges[2:]]
    arrays += [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(a)]) for a in asked[2:]]
    return pa.RecordBatch.from_arrays(arrays, names=MARK_NAMES)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats among sorted occurrences: ranges of all but a phrase's first, phrases of triggers with several.

    Triggers at either end of the task's rows may go on in another task: their phrases are looked at in any case.
    """
    last, held, edge = None, None, True  # the row before; the first phrase of its trigger, if not decided; first trigger
    for batch in batches:
        h, x, doc, copy, p = rows = [np.asarray(c) for c in batch.columns]
        is_range = p < 0
        ranges = [tuple(c[is_range] for c in (doc, copy, -p - 1, x))]
        h, x, doc, copy, p = rows = [c[~is_range] for c in rows]
        n = len(h)
        if not n:
            yield marks(ranges[0], (h, h, h, h))
            continue
        new_h, new_x, new = new_rows(h), new_rows(h, x), new_rows(*rows)
        if last is not None:
            new_h[0], new_x[0] = h[0] != last[0], (h[0], x[0]) != last[:2]
            new[0] = tuple(c[0] for c in rows) != last
        again = new & ~new_x
        ranges.append((doc[again], copy[again], *unpacked(p[again])))
        group = np.cumsum(new_h)  # 0: the trigger of the batch before
        several = np.bincount(group[new_x & ~new_h], minlength=group[-1] + 1) > 0
        asked = new_x & (~new_h | several[group])
        if edge:
            edge_group = 1 if last is None else 0
            asked |= new_x & (group == edge_group)
            edge = group[-1] == edge_group
        extra = []
        if held is not None:
            if several[0]:
                extra.append(held)
            if several[0] or group[-1] > 0:
                held = None
        if group[-1] > 0 and not several[-1] and not edge:
            at = int(np.flatnonzero(new_h)[-1])
            held = tuple(int(c[at]) for c in (doc, copy, h, p))
        last = tuple(int(c[-1]) for c in rows)
        picked = [np.r_[c[asked], np.array([e[k] for e in extra], np.int64)] for k, c in enumerate((doc, copy, h, p))]
        yield marks(tuple(np.concatenate(c) for c in zip(*ranges)), picked)
    if held is not None:
        none = np.empty(0, np.int64)
        yield marks((none,) * 4, tuple(np.array([v], np.int64) for v in held))


#: Windows of a slice: of a hot trigger's phrase, those that begin less than so many bytes apart.
STRIDE = 8
PHRASES = "h long, doc long, copy long, p long, cut long, body binary"


def slices(body: pa.Array, p: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases of hot triggers in slices: phrase, first window in it, number of windows, hash of what its windows share.

    A window's trigger lies at one place in it, so only windows as far from their triggers can be equal; a slice's are
    nearly so, and have all but ``STRIDE - 1`` of their bytes in common.
    """
    data, ends = concatenated(body)
    last = p & 127  # the trigger's distance from the first window's start, and from the last one's
    first = last - (p >> 7 & 127)
    low = first // STRIDE
    many = last // STRIDE - low + 1
    of = np.repeat(np.arange(len(p)), many)
    step = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    far, near = np.minimum(step * STRIDE + STRIDE - 1, last[of]), np.maximum(step * STRIDE, first[of])
    trigger = np.r_[0, ends][of] + last[of]
    shared = trigger - step * STRIDE
    name = Hashes(data).of(shared, shared + LENGTH - STRIDE + 1)
    return of, last[of] - far, far - near + 1, scattered(name + step.astype(np.uint64) * MIX)


def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the phrases that are asked for, by document."""
    for batch in batches:
        doc, copy = ids_of(batch.column(0)), ids_of(batch.column(1))
        data, ends = concatenated(batch.column(2))
        lists = batch.column(3)
        owner = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
        entries = lists.flatten()
        h, p = (np.asarray(entries.field(k)) for k in (0, 1))
        start, stop = (c + np.r_[0, ends][owner] for c in unpacked(p))
        hot = np.asarray(entries.field(2)).astype(bool)
        cold, hot = np.flatnonzero(~hot), np.flatnonzero(hot)
        yield phrase_rows(h[cold], doc[owner[cold]], copy[owner[cold]], p[cold], 0, pieces(data, start[cold], stop[cold]))
        for at in range(0, len(hot), CHUNK):  # bytes of so many are hashed at once
            part = hot[at : at + CHUNK]
            of, first, windows, name = slices(pieces(data, start[part], stop[part]), p[part])
            of = part[of]
            begin = start[of] + first
            name = scattered(name + h[of].view(np.uint64)).view(np.int64)
            place = packed((p[of] >> 14) + first, windows, 0)
            bodies = pieces(data, begin, begin + windows - 1 + LENGTH)
            yield phrase_rows(name, doc[owner[of]], copy[owner[of]], place, 1, bodies)


def pieces(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    return pa.array([data[a:b].tobytes() for a, b in zip(start, stop)], pa.binary())


def phrase_rows(h, doc, copy, p, cut: int, body: pa.Array) -> pa.RecordBatch:
    """Phrases, or slices of them (``cut``)."""
    arrays = [pa.array(np.asarray(c, np.int64)) for c in (h, doc, copy, p, np.full(len(h), cut))]
    return pa.RecordBatch.from_arrays([*arrays, body], names=["h", "doc", "copy", "p", "cut", "body"])


def suffix_ranks(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Rank of each place by its next ``length`` bytes (beyond the end zeros): a suffix array to that depth.

    Ranks by eight bytes double their depth by pairs of ranks; the last pair overlaps.
    """
    n = len(data)
    padded = np.r_[data, np.zeros(2 * length, np.uint8)]
    words = np.lib.stride_tricks.sliding_window_view(padded[: n + 7], 8)
    keys = np.ascontiguousarray(words).view(">u8").ravel().astype(np.uint64)
    rank, depth = np.unique(keys, return_inverse=True)[1].astype(np.int64), 8
    while depth < length:
        step = min(depth, length - depth)
        next_ = np.r_[rank[step:] + 1, np.zeros(min(step, n), np.int64)][:n]
        rank = np.unique(rank * (n + 1) + next_, return_inverse=True)[1].astype(np.int64)
        depth += step
    return rank


FOUND = "doc long, copy long, start long, stop long, a long, b long"
FOUND_NAMES = [f.split()[0] for f in FOUND.split(", ")]


def corpus_order(h, doc, copy, p, body: pa.Array, broken: set[int]) -> pa.RecordBatch:
    """Repeated windows of a sorted chunk of phrases; windows of ``broken`` triggers go on by their hash."""
    data, ends = concatenated(body)
    windows = (p >> 7 & 127) + 1
    owner = np.repeat(np.arange(len(p)), windows)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = np.r_[0, ends][owner] + within
    rank = suffix_ranks(data)[at]
    place, d, c = (p >> 14)[owner] + within, doc[owner], copy[owner]
    order = np.lexsort((place, c, d, rank))
    first = new_rows(rank[order])
    again = ~first & new_rows(rank[order], d[order], c[order], place[order])
    repeat = order[again]
    ranges = merged(d[repeat], c[repeat], place[repeat], place[repeat] + LENGTH)
    open_ = order[first]
    open_ = open_[np.isin(h, list(broken))[owner[open_]]]
    names = [Hashes(data, lane).of(at[open_], at[open_] + LENGTH).view(np.int64) for lane in (0, 1)]
    n, m = len(ranges[0]), len(open_)
    starts = (d[open_], c[open_], place[open_], place[open_] + LENGTH)
    arrays = [pa.array(np.concatenate(pair)) for pair in zip(ranges, starts)]
    arrays += [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(name)]) for name in names]
    return pa.RecordBatch.from_arrays(arrays, names=FOUND_NAMES)


def in_chunks(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``corpus_order`` of sorted phrases in chunks of whole triggers, of ``size`` phrases about.

    A trigger is broken if it has more than a chunk's, or is at either end of the task's rows and may go on in another
    task, as only slices do.
    """
    kept, rows, broken, first = [], 0, set(), True

    def done(table: pa.Table, last: bool) -> pa.RecordBatch:
        h, doc, copy, p, cut = [np.asarray(table.column(k).combine_chunks()) for k in range(5)]
        ends = [k for k, at_end in ((0, first), (-1, last)) if at_end and cut[k]]
        return corpus_order(h, doc, copy, p, table.column(5).combine_chunks(), broken | {int(h[k]) for k in ends})

    for batch in batches:
        kept.append(batch)
        rows += batch.num_rows
        if rows <= size:
            continue
        table, at = pa.Table.from_batches(kept), 0
        h = np.asarray(table.column(0).combine_chunks())
        while rows - at > size:
            begins = at + int(np.searchsorted(h[at : at + size + 1], h[at + size]))  # of the trigger that the cut would part
            if begins == at:
                begins, broken = at + size, {int(h[at])}
            yield done(table.slice(at, begins - at), False)
            at, first = begins, False
            broken &= {int(h[at])}
        kept, rows = table.slice(at).to_batches(), rows - at
    if rows:
        yield done(pa.Table.from_batches(kept), True)


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>"


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without its ranges."""
    for batch in batches:
        rows = []
        texts = batch.column(2).cast(pa.large_binary())
        for text, ranges in zip(texts, batch.column(3)):
            data, found = text.as_py() or b"", ranges.as_py() or []
            low, high = (np.array([r[k] for r in found], np.int64) for k in ("start", "stop"))
            zero = np.zeros(len(found), np.int64)
            _, _, low, high = merged(zero, zero, low, high)
            kept, at = hashlib.sha256(), 0
            for a, b in zip(low.tolist(), high.tolist()):
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            spans = [{"start": a, "stop": b} for a, b in zip(low.tolist(), high.tolist())]
            rows.append((len(data), int((high - low).sum()), len(spans), kept.hexdigest(), spans))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
        columns = list(zip(*rows)) if rows else [()] * 5
        names = "n_bytes n_removed n_spans kept_sha256 spans".split()
        arrays = [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc", "copy", *names])


def with_lists(docs: DataFrame, entries: DataFrame, fields: list[str], name: str) -> DataFrame:
    """``docs`` with the list of each one's entries; broadcast if these are few, else joined by a shuffle."""
    lists = entries.groupBy("doc", "copy").agg(F.collect_list(F.struct(*fields)).alias("entries"))
    lists = stage(lists, name)
    total = lists.agg(F.coalesce(F.sum(F.size("entries") + 1), F.lit(0))).first()[0]
    keyed = lists.withColumnsRenamed({"doc": "_doc", "copy": "_copy"})
    right = F.broadcast(keyed) if total <= BROADCAST_ENTRIES else keyed
    key = F.coalesce(docs["doc"], F.lit(int(NO_ID)))
    return docs.join(right, (key == right["_doc"]) & (docs["copy"] == right["_copy"]), "left").select("doc", "copy", "text", "entries")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, stop in bytes).

    A byte goes if a string of 100 bytes of its text covers it that also starts earlier: in a document of smaller id, or
    before it in the same one. Strings are judged on the whole input, overlapping ones included; none crosses documents.
    Null texts are empty; null ids come last. Rows that repeat an id are ordered by their text's digest; of
    rows alike in both, one counts as the earlier and the others go as a whole (if they have 100 bytes). Ids
    are integers below 2 ** 63 - 1. Other columns are not read; an empty table gives an empty result.
    """
    ship()
    id_ = F.col(id_col).cast("long")
    digest = F.conv(F.substring(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), 1, 15), 16, 10).cast("long")
    ids = docs.select(id_.alias("doc"))
    unique = ids.groupBy("doc").count().filter("count > 1").isEmpty()
    copy = F.lit(0).cast("long") if unique else digest
    rows = docs.select(id_.alias("doc"), copy.alias("copy"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    occurrences = rows.mapInArrow(parse, ROWS)
    dealt = occurrences.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS)
    found = stage(dealt.mapInArrow(scan, MARKS), "parse", "zstd")

    phrases_ = found.filter("h IS NOT NULL")
    hot = stage(phrases_.groupBy("h").count().filter(F.col("count") > chunk).select(F.col("h").alias("_h")), "hot")
    phrases_ = phrases_.join(F.broadcast(hot), F.col("h") == F.col("_h"), "left")  # at most one for each chunk of phrases
    asked = with_lists(rows, phrases_.withColumn("hot", F.col("_h").isNotNull().cast("int")), ["h", "p", "hot"], "asked")
    bodies = asked.filter("entries IS NOT NULL").mapInArrow(fetch, PHRASES)
    order = ["h", "doc", "copy", "p"]
    whole = [F.when(F.col("cut") == 1, F.col(k)) for k in order[1:]]  # a trigger that is not cut goes to one task
    dealt = bodies.repartitionByRange("h", *whole).sortWithinPartitions(*order)
    windows = stage(dealt.mapInArrow(lambda batches: in_chunks(chunk, batches), FOUND), "dictionary", "zstd")
    same = Window.partitionBy("a", "b").orderBy("doc", "copy", "start")
    open_ = windows.filter("a IS NOT NULL").dropDuplicates(["a", "b", "doc", "copy", "start"])
    later = open_.withColumn("_n", F.row_number().over(same)).filter("_n > 1")
    span = ["doc", "copy", "start", "stop"]
    ranges = found.filter("h IS NULL").select(*span).union(windows.filter("a IS NULL").select(*span)).union(later.select(*span))
    result = with_lists(rows, ranges, ["start", "stop"], "ranges").mapInArrow(cut_out, f"doc long, copy long, {RESULT}")
    if not unique:
        result = one_of_twins(result, rows)
    return result.select(F.col("doc").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def one_of_twins(result: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows alike in id and text have one result; all but one of them go as a whole."""
    counts = rows.groupBy("doc", "copy").agg(F.count("*").alias("_rows"))
    one = result.dropDuplicates(["doc", "copy"]).withColumnRenamed("doc", "_doc").withColumnRenamed("copy", "_copy")
    both = counts.join(one, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("copy") == F.col("_copy")))
    each = both.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    gone = (F.col("_k") > 1) & (F.col("n_bytes") >= LENGTH)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    return each.select(
        "doc", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(gone, whole).otherwise(F.col("spans")).alias("spans"),
    )
