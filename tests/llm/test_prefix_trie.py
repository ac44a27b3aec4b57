"""The prefix trie against a dictionary of prefixes, in blocks of few turns and with colliding digests."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from wardcast.llm import prefix_trie
from wardcast.llm.queries import op12_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, conv string, i int, depth string, block long"
NAMES = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)


def trie(df, rebuild=False, **more):
    turns = prefix_trie.numbered(prefix_trie.turn_digests(df), more.get("block", prefix_trie.BLOCK))
    members = turns.select("conv").distinct()
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(turns) if rebuild else turns, members, **more)
    assert got.columns == NAMES
    return sorted(map(tuple, got.collect()), key=str)


def plain(rows, rebuild=False):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in convs}
        convs = {c: convs.get(c - c % 20, [])[: h[c]] + v[h[c] :] for c, v in convs.items()}
    members = defaultdict(list)
    for c, v in sorted(convs.items()):
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    below = defaultdict(lambda: [0, 0, 0])  # children, leaves, saved
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaf = all(len(convs[c]) == len(p) for c in m)
        below[p[:-1]][0] += bool(p)
        for d in range(len(p) + 1):
            below[p[:d]][1] += leaf
            below[p[:d]][2] += (len(m) - 1) * words
    sha = lambda p, m: hashlib.sha256(",".join(str(c) for c in m if len(convs[c]) == len(p)).encode()).hexdigest()
    return sorted(
        [(m[0], len(p), members[p[:-1]][0] if p else None, len(m), *below[p], sha(p, m)) for p, m in members.items()], key=str
    )


@pytest.fixture(scope="module")
def many():
    draw = random.Random(12)
    words = ["a b", "c", "", "d  e f"]
    rows = []
    for c in range(60):
        copy = draw.choice([c, c % 7])  # groups of equal conversations
        again = random.Random(copy)
        rows += [(c, t, again.choice(["u", "s"]), again.choice(words)) for t in range(again.randrange(1, 9))]
    rows += [(61, t, "u", f"turn {t}") for t in range(150)]  # over many blocks
    rows += [(63, t, "u", f"turn {t}") for t in range(90)] + [(75, 0, "u", "turn 0")]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, bits", [(7, 64), (1000, 64), (40, 9)])
def test_equals_dictionary(spark, many, block, bits):
    df = frame(spark, many)
    assert trie(df, block=block, digest_bits=bits) == plain(many)
    assert trie(df, rebuild=True, block=block, digest_bits=bits) == plain(many, rebuild=True)


def test_awkward_rows(spark):
    rows = [
        (1, None, None, "a"), (1, 0, "u", None), (1, 0, "u", None), (2, None, None, "a"), (2, 5, "u", ""), (3, 1, "u", "w " * 50_000),
        (None, 1, "u", "lost"), (4, 1, "u:", "x"), (5, 1, "u", ":x"), (24, 0, "u", "head"), (-21, 0, "u", "less"), (67, 0, "u", "one"),
    ]
    assert trie(frame(spark, rows)) == plain(rows)
    assert trie(frame(spark, rows), rebuild=True) == plain(rows, rebuild=True)
    assert trie(frame(spark, [])) == []
    assert trie(frame(spark, rows).filter("conv_id IS NULL")) == []


def test_slots_are_minimal_and_verified():
    draw = np.random.default_rng(1)
    a, b = (draw.integers(0, 1 << 63, 5000).astype(np.uint64) for _ in range(2))
    table = prefix_trie.NodeTable(a, b)
    assert sorted(table.slots(a, b)) == list(range(5000))
    assert (table.slots(a, b + np.uint64(1)) == -1).all()


def test_query_takes_whole_table(spark):
    got = op12_prefix_trie(spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, rebuild=True)
