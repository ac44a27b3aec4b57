"""The trie of all conversation prefixes, in blocks with minimal-perfect-hash node tables.

A turn becomes 128 bits of its SHA-256, a prefix two 64-bit polynomials over its turns, which can be put
together from pieces. Turns are sorted by conversation and position and cut into blocks of bounded size, wherever that falls, so
one conversation may lie over many blocks. Each block enumerates its distinct prefixes and gives
them slots by a minimal perfect hash; counts are scattered into flat arrays by slot, and
subtree sums run up through an array of parent slots, deepest level first.

Blocks meet by digest only: their counts are added up to the nodes of the whole trie; each node belongs to
the block of its smallest member, whose conversation brings all ancestors along. So every
node's weight is counted once, and sums of blocks are the sums of the subtree. What a cut
conversation's block can't hand to a parent in it goes to the block before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardcast.llm.shared import SPACE, ship, stage

#: Turns of a block, and ids that are written as one piece of a node's list.
BLOCK, PIECE = 1 << 17, 1_000
#: Bits per key of the perfect hash on each of its levels.
SPARE = 2
DIGEST = ["pa", "pb"]


# Minimal perfect hash


def mixed(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of a digest that differs by level."""
    x = a ^ (b * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((level + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    for shift in (32, 29, 32):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class NodeTable:
    """Distinct digests in slots 0 to n - 1 without gaps; a slot is given only if the digest in it agrees.

    Keys that are alone in their place of a level's bit array keep it, the others go on to the next level;
    the slot is the rank of the bit.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels, left = [], np.arange(len(a))
        while len(left):
            size = SPARE * len(left)
            at = (mixed(a[left], b[left], len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, bool)
            bits[at[alone]] = True
            self.levels.append(bits)
            left = left[~alone]
        self.ranks, before = [], 0
        for bits in self.levels:
            self.ranks.append(np.cumsum(bits) - 1 + before)
            before += int(bits.sum())
        self.a, self.b = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
        at = self.places(a, b)
        self.a[at], self.b[at] = a, b

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, left = np.full(len(a), -1), np.arange(len(a))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = (mixed(a[left], b[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        return out

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for those that the table does not hold."""
        at = self.places(a, b)
        known = at >= 0
        known[known] = (self.a[at[known]] == a[known]) & (self.b[at[known]] == b[known])
        return np.where(known, at, -1)


# Turns in sorted blocks


def turn_digests(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, a, b, words): each turn as 128 bits of the SHA-256 of role and text, which move no further.

    Null roles and texts count as empty; rows without a conversation are left out.
    """
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256)
    number = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    words = F.regexp_count(t, F.lit(SPACE.replace("[", "[^"))).cast("long")
    rows = conversations.filter(F.col(conv_id).isNotNull())
    return rows.select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"),
        number(1).alias("a"), number(16).alias("b"), words.alias("words"),
    )


def number_rows(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with the block they fall into; blocks ascend with tasks, as ranges do."""
    part, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        block = (part << 32) + (seen + np.arange(batch.num_rows)) // size
        place = seen + np.arange(batch.num_rows)
        seen += batch.num_rows
        names = [*batch.schema.names, "block", "place"]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block), pa.array(place)], names=names)


def sorted_blocks(rows: DataFrame, order: list, size: int, name: str) -> DataFrame:
    """``rows`` dealt by ranges of ``order``, with their block and place, written once.

    A conversation with very many turns is cut like any other rows: no task sorts more than its range.
    """
    ship()
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", block long, place long"
    return stage(dealt.mapInArrow(lambda batches: number_rows(size, batches), kind), name)


def before(rows: DataFrame) -> DataFrame:
    """(conv, block, start, n, n_before) for each piece of a conversation: its turns, and those in earlier blocks."""
    pieces = rows.groupBy("conv", "block").agg(F.min("place").alias("start"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("n_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def numbered(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """Turns with ``i``, their number from 1 in the conversation, by turn (null first), then by digest."""
    turns = stage(turns, "digests")  # the ranges are found by a pass of its own
    rows = sorted_blocks(turns, [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("a"), F.asc("b")], size, "turns")
    ranked = rows.join(before(rows), ["conv", "block"])
    return ranked.select("conv", (F.col("n_before") + F.col("place") - F.col("start") + 1).alias("i"), "a", "b", "words")


# Prefix digests


def bases(seed: int) -> tuple[int, int]:
    """Two odd multipliers."""
    word = hashlib.sha256(b"prefix%d" % seed).digest()
    return tuple(int.from_bytes(word[k : k + 8], "big") | 1 for k in (0, 8))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 1 to base ** n, modulo 2 ** 64."""
    return np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)


def unsigned(values) -> np.ndarray:
    return np.asarray(values, np.int64).view(np.uint64)


def piece_sums(seed: int, rows: pd.DataFrame) -> pd.DataFrame:
    """Polynomials of each conversation's piece in a block, with its own turns counted from 1."""
    rows = rows.sort_values("place")
    first, place = firsts(rows["conv"].to_numpy())
    out = {"conv": rows["conv"].to_numpy()[first], "block": rows["block"].to_numpy()[first]}
    for name, turn, base in zip(("sa", "sb"), ("a", "b"), bases(seed)):
        sums = np.add.reduceat(unsigned(rows[turn]) * powers(base, len(rows))[place], first)
        out[name] = sums.view(np.int64)
    return pd.DataFrame(out)


def firsts(conv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each conversation starts in sorted rows, and each row's place in its own, from 0."""
    first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
    return first, np.arange(len(conv)) - np.repeat(first, np.diff(np.r_[first, len(conv)]))


def carry(seed: int, pieces: pd.DataFrame) -> pd.DataFrame:
    """What precedes each piece of one cut conversation: turns, polynomials and block."""
    out, sums, turns, last = [], [0, 0], 0, None
    pieces = pieces.sort_values("block")
    for k, (conv, block, n, sa, sb) in enumerate(zip(*(pieces[c] for c in ("conv", "block", "n", "sa", "sb")))):
        signed = [np.uint64(s).astype(np.int64) for s in sums]
        out.append((conv, block, turns, *signed, last, k + 1 < len(pieces)))
        for i, (base, own) in enumerate(zip(bases(seed), (sa, sb))):
            sums[i] = (sums[i] + pow(base, turns, 1 << 64) * int(unsigned(own))) % (1 << 64)
        turns, last = turns + n, block
    return pd.DataFrame(out, columns=CUT_NAMES).astype({"last": "Int64"})


CUT = "conv long, block long, turns long, sa long, sb long, last long, goes_on boolean"
CUT_NAMES = [f.split()[0] for f in CUT.split(", ")]


def cut_pieces(rows: DataFrame, seed: int) -> DataFrame:
    """A row for each piece of every conversation that lies in several blocks, at most two a block."""
    pieces = before(rows)
    whole = Window.partitionBy("conv")
    cut = pieces.withColumn("_k", F.count("*").over(whole)).filter("_k > 1").select("conv", "block", "n")
    held = rows.join(cut.select("conv", "block"), ["conv", "block"], "left_semi")
    sums = held.groupBy("block").applyInPandas(lambda piece: piece_sums(seed, piece), "conv long, block long, sa long, sb long")
    return stage(cut.join(sums, ["conv", "block"]).groupBy("conv").applyInPandas(lambda p: carry(seed, p), CUT), "cut")


# Nodes


LOCAL = "block long, pa long, pb long, qa long, qb long, depth long, a long, b long, words long, n long, ends long, conv long, ids array<long>"
LOCAL_NAMES = [f.split()[0] for f in LOCAL.split(", ")]


def local_nodes(seed: int, mask: int, rows: pd.DataFrame, cut: pd.DataFrame) -> pd.DataFrame:
    """Distinct prefixes of a block with counts by slot, and lists of the conversations that end at them."""
    if not len(rows):
        return pd.DataFrame(columns=LOCAL_NAMES)
    rows = rows.sort_values("place")
    conv, block = rows["conv"].to_numpy(), int(rows["block"].iloc[0])
    first, place = firsts(conv)
    depth = place + 1
    digest, parent = [], []
    heads = {c: row for c, *row in zip(*(cut[k] for k in ("conv", "turns", "sa", "sb", "goes_on")))}
    head = heads.get(conv[0], [0, 0, 0, False])
    own = slice(0, first[1] if len(first) > 1 else len(conv))  # only the first conversation may go on from before
    depth[own] += int(head[0])
    for turn, start, base in zip(("a", "b"), head[1:3], bases(seed)):
        term = unsigned(rows[turn]) * powers(base, len(rows))[place]
        sums = np.cumsum(term, dtype=np.uint64)
        sums -= np.repeat(sums[first] - term[first], np.diff(np.r_[first, len(conv)]))
        ahead = sums - term
        shift = np.uint64(pow(base, int(head[0]), 1 << 64))
        for values in (sums, ahead):
            values[own] = values[own] * shift + unsigned(int(start))
        digest.append(sums & np.uint64(mask))
        parent.append(ahead & np.uint64(mask))
    last = np.r_[conv[1:] != conv[:-1], not heads.get(conv[-1], [0, 0, 0, False])[3]]

    keys = np.zeros(len(conv), [("a", np.uint64), ("b", np.uint64)])
    keys["a"], keys["b"] = digest
    distinct, at = np.unique(keys, return_index=True)
    table = NodeTable(distinct["a"], distinct["b"])
    slot = table.slots(*digest)
    n, ends, member = (np.zeros(len(distinct), np.int64) for _ in range(3))
    np.add.at(n, slot, 1)
    np.add.at(ends, slot, last.astype(np.int64))
    place_of = slot[at]
    member[place_of] = conv[at]  # the first row of a digest is that of the smallest conversation
    source = np.empty(len(distinct), np.int64)
    source[place_of] = at
    nodes = {"block": block, "pa": table.a.view(np.int64), "pb": table.b.view(np.int64)}
    nodes |= {k: v[source].view(np.int64) for k, v in zip(("qa", "qb"), parent)}
    nodes |= {k: rows[k].to_numpy()[source] for k in ("a", "b", "words")}
    nodes |= {"depth": depth[source], "n": n, "ends": ends, "conv": member, "ids": None}
    out = [pd.DataFrame(nodes)[LOCAL_NAMES]]
    # A node at which another sequence fell into the same digest shows by its proof: depth, turn, parent.
    proof = np.stack([depth, rows["a"], rows["b"], *(p.view(np.int64) for p in parent)])
    wrong = np.flatnonzero((proof != proof[:, source[slot]]).any(axis=0))
    if len(wrong):
        clash = out[0].iloc[slot[wrong]].assign(depth=-1, n=0, ends=0)
        out.append(clash)
    order = np.flatnonzero(last)
    order = order[np.argsort(slot[order], kind="stable")]
    pieces = []
    for ids in np.split(order, np.flatnonzero(np.diff(slot[order])) + 1) if len(order) else []:
        pieces += [(slot[ids[0]], conv[ids[k : k + PIECE]]) for k in range(0, len(ids), PIECE)]
    lists = out[0].iloc[[s for s, _ in pieces]].assign(depth=None)
    lists["ids"], lists["conv"] = [list(i) for _, i in pieces], [int(i[0]) for _, i in pieces]
    return pd.concat([*out, lists]).astype({"depth": "Int64"})


def by_block(left: DataFrame, right: DataFrame, function, returns: str) -> DataFrame:
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(function, returns)


SUMS = "pa long, pb long, children long, leaves long, saved long, parent_conv long, out_qa long, out_qb long, block long"
SUM_NAMES = [f.split()[0] for f in SUMS.split(", ")]


def slots_of(nodes: pd.DataFrame) -> tuple[NodeTable, np.ndarray, np.ndarray]:
    """The node table of a block, each row's slot and its parent's (-1: not in the block)."""
    keys = [unsigned(nodes[k]) for k in ("pa", "pb", "qa", "qb")]
    table = NodeTable(*keys[:2])
    return table, table.slots(*keys[:2]), table.slots(*keys[2:])


def run_up(depth: np.ndarray, parent: np.ndarray, sums: list[np.ndarray]) -> None:
    """Add each slot's sums to its parent's, deepest level first."""
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        level = level[parent[level] >= 0]
        for values in sums:
            np.add.at(values, parent[level], values[level])


def subtree_sums(nodes: pd.DataFrame) -> pd.DataFrame:
    """A block's part of every node's children, leaves and saved words; weights count where the node belongs."""
    table, slot, up = slots_of(nodes)
    flat = lambda values: np.asarray(values)[np.argsort(slot)]  # noqa: E731 - rows in order of their slots
    parent, depth, owned = flat(up), flat(nodes["depth"]), flat(nodes["owner"] == nodes["block"])
    n, conv = flat(nodes["n_convs"]), flat(nodes["smallest"])
    leaves = (owned & flat(nodes["n_ends"] == nodes["n_convs"])).astype(np.int64)
    saved = np.where(owned, (n - 1) * flat(nodes["words"]), 0)
    children = np.zeros(len(nodes), np.int64)
    inside = parent >= 0
    np.add.at(children, parent[inside & owned], 1)
    run_up(depth, parent, [leaves, saved])
    outside = ~inside & (depth > 1)
    out = pd.DataFrame(
        {
            "pa": table.a.view(np.int64), "pb": table.b.view(np.int64), "children": children, "leaves": leaves,
            "saved": saved, "parent_conv": pd.array(np.where(inside & owned, conv[parent], 0), "Int64"),
            "out_qa": pd.array(flat(nodes["qa"]), "Int64"), "out_qb": pd.array(flat(nodes["qb"]), "Int64"),
            "block": int(nodes["block"].iloc[0]),
        }
    )
    out.loc[~(inside & owned), "parent_conv"] = pd.NA
    out.loc[~outside, ["out_qa", "out_qb"]] = pd.NA
    return out[SUM_NAMES]


def climb(nodes: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
    """Sums that come from later blocks, added along the path that they enter in this one."""
    out = []
    if len(nodes) and len(sums):
        table, slot, up = slots_of(nodes)
        parent = up[np.argsort(slot)]
        for a, b, leaves, saved in zip(*(sums[k] for k in ("out_qa", "out_qb", "leaves", "saved"))):
            at = int(table.slots(unsigned([a]), unsigned([b]))[0])
            while at >= 0:
                out.append((table.a[at].astype(np.int64), table.b[at].astype(np.int64), leaves, saved))
                at = int(parent[at])
    return pd.DataFrame(out, columns=[*DIGEST, "leaves", "saved"])


def end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids from sorted pieces, which stream by."""
    now, run = None, None
    for batch in batches:
        keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        done = []
        for key, ids in zip(keys, batch.column(2)):
            text = ",".join(map(str, ids.as_py())).encode()
            if key == now:
                run.update(b"," + text)
                continue
            if now is not None:
                done.append((*now, run.hexdigest()))
            now, run = key, hashlib.sha256(text)
        yield ends_batch(done)
    if now is not None:
        yield ends_batch([(*now, run.hexdigest())])


def ends_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [(), (), ()]
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*DIGEST, "ends_sha256"])


def nodes_of(local: DataFrame) -> DataFrame:
    """Nodes of the whole trie from those of the blocks; ``proofs`` above 1 shows two sequences under one digest."""
    counts = local.filter("ids IS NULL")
    proof = F.struct("depth", "a", "b", "qa", "qb")
    return counts.groupBy(*DIGEST).agg(
        F.min("conv").alias("smallest"),
        F.min_by("block", F.struct("conv", "block")).alias("owner"),
        F.max("depth").alias("depth"),
        F.max("words").alias("words"),
        F.sum("n").alias("n_convs"),
        F.sum("ends").alias("n_ends"),
        (F.min(proof) == F.max(proof)).alias("proved"),
    )


def verified_nodes(rows: DataFrame, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pieces of cut conversations, nodes by block and nodes of the trie, under the first seed without a collision."""
    seed, mask = 0, (1 << min(bits, 64)) - 1
    while True:
        cut = cut_pieces(rows, seed)
        pairs = by_block(rows, cut, partial(local_nodes, seed, mask), LOCAL)
        local = stage(pairs, "local-nodes")
        nodes = stage(nodes_of(local), "nodes")
        if nodes.filter("NOT proved").isEmpty():
            return cut, local, nodes
        seed, mask = seed + 1, min(mask << 1 | 1, (1 << 64) - 1)


def prefix_trie(turns: DataFrame, members: DataFrame, *, block: int = BLOCK, digest_bits: int = 64) -> DataFrame:
    """One row per node of the trie of conversations: see the columns below.

    ``turns`` has conv, i (the turn's place), a, b, words, as ``turn_digests`` and ``numbered`` give them; ``members``
    has conv for every conversation, those without turns included. Each distinct sequence of first turns is a
    node, the root stands for none. Columns: conv_id (smallest member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves and saved_tokens of the subtree, ends_sha256 of the ids that end here, ascending.
    No members give no rows. Two prefixes under one digest are detected by parent, depth and turn,
    and all digests are then computed anew by other multipliers. ``digest_bits`` below 64 serves tests.
    """
    order = [F.asc("conv"), F.asc("i")]
    rows = sorted_blocks(turns.select("conv", "i", "a", "b", "words"), order, block, "prefixes")
    cut, local, nodes = verified_nodes(rows, digest_bits)
    counted = local.filter("ids IS NULL").select("block", *DIGEST, "qa", "qb")
    enriched = stage(counted.join(nodes, DIGEST), "enriched")

    sums = stage(enriched.groupBy("block").applyInPandas(subtree_sums, SUMS), "sums")
    out = sums.filter("out_qa IS NOT NULL")
    # What leaves a block enters the one before in the same conversation, and all before that.
    chain = cut.filter("last IS NOT NULL").select("conv", "block", "last")
    later = Window.partitionBy("conv").orderBy(F.desc("block"))
    entering = chain.join(out, "block").select(
        F.col("last").alias("block"), "out_qa", "out_qb",
        F.sum("leaves").over(later).alias("leaves"), F.sum("saved").over(later).alias("saved"),
    )
    climbed = by_block(enriched, entering, climb, "pa long, pb long, leaves long, saved long")
    parents = nodes.select(F.col("pa").alias("out_qa"), F.col("pb").alias("out_qb"), F.col("smallest").alias("parent_conv"))
    owners = out.join(enriched.filter("owner = block").select("block", *DIGEST), ["block", *DIGEST], "left_semi")
    adopted = owners.drop("parent_conv").join(parents, ["out_qa", "out_qb"]).select(*DIGEST, "parent_conv")
    children = owners.groupBy(F.col("out_qa").alias("pa"), F.col("out_qb").alias("pb")).agg(F.count("*").alias("children"))
    parts = sums.select(*DIGEST, "children", "leaves", "saved", "parent_conv")
    for more in (climbed, adopted, children):
        parts = parts.unionByName(more, allowMissingColumns=True)
    total = parts.groupBy(*DIGEST).agg(
        *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("children", "leaves", "saved")],
        F.max("parent_conv").alias("parent_conv"),
    )
    pieces = local.filter("ids IS NOT NULL").select(*DIGEST, "ids", "conv")
    found = nodes.select(*DIGEST, "smallest", "depth", "n_convs").join(total, DIGEST).join(hashed(pieces), DIGEST, "left")
    below = stage(found, "trie")
    return root(below, turns, members).unionByName(
        below.select(
            F.col("smallest").alias("conv_id"),
            "depth",
            F.when(F.col("depth") > 1, F.col("parent_conv")).otherwise(least(members)).alias("parent_conv_id"),
            "n_convs",
            F.col("children").alias("n_children"),
            F.col("leaves").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )


def least(members: DataFrame):
    """The smallest member of all, one number."""
    return F.lit(members.agg(F.min("conv")).first()[0]).cast("long")


def hashed(pieces: DataFrame) -> DataFrame:
    """SHA-256 of the ids of each digest, from pieces (pa, pb, ids, conv: the first of them)."""
    dealt = pieces.repartition(*DIGEST).sortWithinPartitions(*DIGEST, "conv").select(*DIGEST, "ids")
    return dealt.mapInArrow(end_hashes, "pa long, pb long, ends_sha256 string")


def root(below: DataFrame, turns: DataFrame, members: DataFrame) -> DataFrame:
    """The root's row: sums over the nodes of depth 1, and the conversations without turns."""
    top = below.filter("depth = 1").agg(
        F.count("*").alias("n_children"),
        F.greatest(F.coalesce(F.sum("leaves"), F.lit(0)), F.lit(1)).alias("n_leaves"),
        F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"),
    )
    empty = members.join(turns.select("conv").distinct(), "conv", "left_anti")
    ids = empty.select(F.lit(0).cast("long").alias("pa"), F.lit(0).cast("long").alias("pb"), F.array("conv").alias("ids"), "conv")
    ends = hashed(ids).agg(F.first("ends_sha256").alias("ends_sha256"))
    all_ = members.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"))
    # Three tables of one row side by side: each fills its own columns.
    parts = all_.unionByName(top, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    row = parts.agg(*[F.first(c, ignorenulls=True).alias(c) for c in parts.columns]).filter("n_convs > 0")
    return row.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def rebuilt(turns: DataFrame, heads_of: int = 20, longest: int = 4) -> DataFrame:
    """Numbered turns of conversations whose first ones are replaced: (conv, i, a, b, words).

    Conversation c begins with the first h turns of c - c % ``heads_of`` (as many as there are), then follow its own
    turns after its first h; h is the CRC-32 of c's digits modulo ``longest``. Only a few turns of each head move to
    the conversations that take them; a conversation's own turns stay where they are.
    """
    base, h = F.col("conv") - F.col("conv") % heads_of, F.crc32(F.col("conv").cast("string")) % longest
    own = turns.filter(F.col("i") > h)
    first = turns.filter((F.col("i") < longest) & (F.col("conv") % heads_of == 0)).withColumnRenamed("conv", "_base")
    takers = turns.select("conv").distinct().select("conv", base.alias("_base"), h.alias("_h"))
    head = takers.join(first, "_base").filter(F.col("i") <= F.col("_h"))
    # Own turns come after all head turns, whatever their numbers.
    return head.select("conv", "i", "a", "b", "words").unionByName(own.withColumn("i", F.col("i") + longest))
