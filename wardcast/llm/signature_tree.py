"""Sets of word shingles, and signature trees that find pairs which may overlap enough.

A signature is a bitmap with a bit for each shingle. A node of the tree holds the OR of its
signatures, the range of their sizes, and the most shingles any of its sets hides behind others' bits. Two
sets below nodes X and Y share at most ``hidden + popcount(X & Y)`` shingles and at most the smaller of
the largest sizes; a pair of nodes that can't reach what the threshold needs is left with all below.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import xxhash

FANOUT = 8
#: Node pairs that are expanded at once.
FRONT = 16_384
#: Odd multipliers of the hashes of words and of their sequence.
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Threshold:
    """Links: ``over * intersection >= part * union``, in whole numbers."""

    part: int = 4
    over: int = 5

    def links(self, a, b, common):
        """For sizes and size of the intersection, also as arrays."""
        return self.over * common >= self.part * (a + b - common)

    def prefix(self, n: int) -> int:
        """Of two linked sets in one order, the first so many elements share one."""
        return n - -(-self.part * n // self.over) + 1 if n else 0


#: Bytes that are hashed at once.
SLICE = 1 << 20
BLANK = np.zeros(256, bool)
BLANK[list(b" \t\n\r\x0b\x0c")] = True
#: A random number for each byte (none for white space), and the powers that place it in a word.
LETTER = np.random.RandomState(64).randint(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LETTER[BLANK] = 0
BASE = 0xD1342543DE82EF95


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE to the power of each offset in a slice, and the inverses, modulo 2**64."""
    own = lambda base: np.cumprod(np.r_[np.uint64(1), np.full(SLICE, base, np.uint64)])
    return own(BASE), own(pow(BASE, -1, 1 << 64))


def mix(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(29))) * MIX
    return hashes ^ (hashes >> np.uint64(32))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of at most ``SLICE`` bytes: a polynomial in its bytes, alike at any offset."""
    values = np.frombuffer(data, np.uint8)
    blank = BLANK[values]
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    if not len(starts):
        return np.empty(0, np.uint64), starts
    power, inverse = powers()
    sums = np.add.reduceat(LETTER[values] * power[: len(values)], starts)
    return mix(sums * inverse[starts]), starts


def long_text_hashes(data: bytes) -> np.ndarray:
    """Word hashes of a text of any length, by slices that end between words; words beyond a slice by XXH3."""
    out, at = [], 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        if end < len(data):
            blanks = np.flatnonzero(BLANK[np.frombuffer(data, np.uint8, end - at, at)])
            if len(blanks):
                end = at + int(blanks[-1]) + 1
            else:  # a word longer than a slice
                while end < len(data) and not BLANK[data[end]]:
                    end += 1
                out.append(np.array([xxhash.xxh3_64_intdigest(data[at:end])], np.uint64))
                at = end
                continue
        out.append(word_hashes(data[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingles(own: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size`` words in a row; fewer words are one shingle, none is no shingle."""
    if not len(own):
        return own
    size = min(size, len(own))
    last = len(own) - size + 1
    mixed = np.full(last, size, np.uint64)
    for i in range(size):
        mixed = (mixed ^ own[i : i + last]) * STEP
        mixed ^= mixed >> np.uint64(29)
    mixed = mix(mixed)
    mixed.sort()
    return mixed[np.r_[True, mixed[1:] != mixed[:-1]]]


def shingle_sets(texts: Iterable[str | None], size: int) -> Iterator[np.ndarray]:
    """The shingles of each text, lower case in A-Z; short texts are hashed together."""
    held: list[bytes] = []
    total = 0

    def flush() -> Iterator[np.ndarray]:
        hashes, starts = word_hashes(b"\n".join(held))
        ends = np.cumsum([len(d) + 1 for d in held])
        for own in np.split(hashes, np.searchsorted(starts, ends[:-1])):
            yield shingles(own, size)

    for text in texts:
        data = (text or "").encode("utf-8", "replace").lower()
        if held and total + len(data) + 1 > SLICE:
            yield from flush()
            held, total = [], 0
        if len(data) >= SLICE:
            yield shingles(long_text_hashes(data), size)
            continue
        held.append(data)
        total += len(data) + 1
    if held:
        yield from flush()


@dataclass(frozen=True)
class Widths:
    """Bits of the signatures of sets of up to ``limit`` shingles, and of larger ones; the wide fold into the narrow."""

    limit: int
    narrow: int
    wide: int

    def signature(self, found: np.ndarray) -> np.ndarray:
        width = self.narrow if len(found) <= self.limit else self.wide
        bits = np.zeros(width, np.uint8)
        bits[(found % np.uint64(width)).astype(np.int64)] = 1
        return np.packbits(bits).view(np.uint64)

    def folded(self, wide: np.ndarray) -> np.ndarray:
        """Wide signatures (in rows) as narrow ones."""
        parts = wide.reshape(len(wide), self.wide // self.narrow, self.narrow // 64)
        return np.bitwise_or.reduce(parts, axis=1)

    def stacked(self, signatures: list[bytes], n: np.ndarray) -> np.ndarray:
        """Signatures in rows of one width: narrow if a narrow one is among them."""
        wide = n > self.limit
        if wide.all() or not wide.any():
            return np.frombuffer(b"".join(signatures), np.uint64).reshape(len(n), -1)
        rows = [np.frombuffer(x, np.uint64) for x in signatures]
        return np.stack([self.folded(x[None])[0] if w else x for x, w in zip(rows, wide)])

    def narrowed(self, rows: np.ndarray) -> np.ndarray:
        return self.folded(rows) if rows.shape[1] > self.narrow // 64 else rows


class Tree:
    """Signatures in rows, and their nodes level by level; equal ``group`` numbers need no pair."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray, group: np.ndarray):
        hidden = sizes - np.bitwise_count(bitmaps).sum(1).astype(np.int64)
        self.levels = [(bitmaps, sizes, sizes, hidden, group, group)]
        while len(self.levels[-1][1]) > 1:
            bitmaps, low, high, hidden, first, last = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(bitmaps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                    np.maximum.reduceat(hidden, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at),
                )
            )


def enough(most, low_a, low_b, high_a, high_b, threshold: Threshold) -> np.ndarray:
    """Whether sets of sizes from low to high that share ``most`` shingles at most can be linked."""
    part, over = threshold.part, threshold.over
    most = np.minimum(most, np.minimum(high_a, high_b))
    sizes = (over * high_a >= part * low_b) & (over * high_b >= part * low_a)
    return sizes & ((part + over) * most >= part * (low_a + low_b))


def may_link(level_x, x: np.ndarray, level_y, y: np.ndarray, threshold: Threshold) -> np.ndarray:
    """Which pairs of nodes can hold a pair of sets of different groups with enough overlap."""
    bx, lowx, highx, hidx, fx, lx = (v[x] for v in level_x)
    by, lowy, highy, hidy, fy, ly = (v[y] for v in level_y)
    most = np.bitwise_count(bx & by).sum(1).astype(np.int64) + np.minimum(hidx, hidy)
    one_group = (fx == lx) & (fy == ly) & (fx == fy)
    return enough(most, lowx, lowy, highx, highy, threshold) & ~one_group


def children(n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes one level down, and which of ``at`` each belongs to."""
    first = at * FANOUT
    count = np.minimum(first + FANOUT, n) - first
    of = np.repeat(np.arange(len(at)), count)
    return first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count), of


def pairs(a: Tree, b: Tree | None, threshold: Threshold) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``a`` and ``b`` (None: ``a`` with itself, first below second) that may be linked, a part at a time."""
    same, b = b is None, b or a
    todo = [(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        i, j, x, y = todo.pop()
        if len(x) > FRONT:
            half = len(x) // 2
            todo += [(i, j, x[:half], y[:half]), (i, j, x[half:], y[half:])]
            continue
        keep = may_link(a.levels[i], x, b.levels[j], y, threshold)
        x, y = x[keep], y[keep]
        if not len(x):
            continue
        if i == 0 and j == 0:
            if same:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield x, y
            continue
        if i >= j and i:  # the tree that stands higher goes down, both if level
            down, of = children(len(a.levels[i - 1][1]), x)
            x, y, i, level = down, y[of], i - 1, i == j
        else:
            level = True
        if level and j:
            down, of = children(len(b.levels[j - 1][1]), y)
            x, y, j = x[of], down, j - 1
        if same and i == j:
            keep = x <= y
            x, y = x[keep], y[keep]
        todo.append((i, j, x, y))


class Groups:
    """Union-find over rows 0 to n - 1."""

    def __init__(self, n: int):
        self.above = list(range(n))

    def find(self, i: int) -> int:
        while self.above[i] != i:
            self.above[i] = i = self.above[self.above[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.above[max(i, j)] = min(i, j)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0
