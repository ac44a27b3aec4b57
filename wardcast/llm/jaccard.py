"""Documents linked by the Jaccard similarity of their word shingles, and the components of the links.

1. Shingles that recur within the texts of one task are counted; the most frequent, a table of fixed
   size, go to the end of the order that all sets use. Any order gives the same links.
2. Each document becomes the digest of its set, a signature and a prefix: two linked sets share a shingle
   of their prefixes. Equal sets are one node from here on.
3. Nodes that share a prefix shingle, and have one of a fitting size beside them, form blocks. Of
   small blocks all pairs that the signatures allow are listed. The sets of these nodes, and of those in
   large blocks, are read again; no others are.
4. Nodes of large blocks meet once, by the first such block each is in, in tasks of bounded size. There a
   star is drawn around each set that is in none yet, and its centre is compared with all others.
5. Large blocks that still hold several groups are searched exactly: a signature tree over each part, a dual
   traversal of every two parts, and pairs of different groups that come through are compared by their sets in
   the same task. Only links come out, fewer than there are groups.

Large blocks are cut into parts of bounded size, and every pair of parts is a task of its own; nothing is
capped, and no link is lost: pairs within a group need none to give the same components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardcast.llm.components import smallest_reachable
from wardcast.llm.shared import Sent, fields_udf, free_name, give_back, ship, stage, value_udf
from wardcast.llm.signature_tree import (
    Groups, Threshold, Tree, Widths, common, enough, pairs, shingle_sets,
)


#: Levels of a count for each doubling.
LEVELS = 8


@dataclass(frozen=True)
class Near:
    """What links two documents, and sizes of the work (which change no result)."""

    words: int = 5
    threshold: Threshold = Threshold(4, 5)
    #: Shingles whose frequency is kept, at most: 16 bytes each in every Python worker.
    frequent: int = 1_000_000
    #: Shingles that are counted together, and how often one must occur there to be frequent.
    counted: int = 2_000_000
    repeats: int = 2
    #: Nodes of a small block.
    small: int = 8
    #: Shingles in a task that compares sets (two parts of a large block), and pairs of one node there.
    task: int = 2_000_000
    rays: int = 256
    #: Signatures of all documents, and of those in large blocks.
    coarse: Widths = Widths(512, 512, 2048)
    fine: Widths = Widths(1024, 4096, 16_384)


def frequent_shingles(docs: DataFrame, text_col: str, near: Near) -> dict[str, np.ndarray]:
    """The most frequent shingles and their counts, in order of the hash; at most ``near.frequent``.

    Every shingle of every text is counted within a part of a task; those that recur there are summed
    over all tasks, and come by whole levels of their count. The order of sets alone depends on it.
    """

    def repeated(held: list[np.ndarray]) -> pd.DataFrame:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= near.repeats
        return pd.DataFrame({"h": found[often].view(np.int64), "n": n[often]})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = [], 0
        for batch in batches:
            for found in shingle_sets(batch["_text"], near.words):
                held.append(found)
                total += len(found)
                if total >= near.counted:
                    yield repeated(held)
                    held, total = [], 0
        if held:
            yield repeated(held)
        held = []
        give_back()

    ship()
    counts = docs.select(F.col(text_col).alias("_text")).mapInPandas(count, "h long, n long")
    level = F.floor(F.log2("n") * LEVELS).cast("int")
    counts = stage(counts.groupBy("h").agg(F.sum("n").alias("n")).withColumn("level", level), "counts")
    levels = counts.groupBy("level").agg(F.count("*").alias("size")).orderBy(F.desc("level")).collect()
    least, total = 64 * LEVELS, 0
    for found in levels:  # fewer than 64 times LEVELS
        total += found["size"]
        if total > near.frequent:
            break
        least = found["level"]
    best = counts.filter(F.col("level") >= least).select("h", "n").toArrow()
    h, n = (best[c].to_numpy() for c in ("h", "n"))
    order = np.argsort(h.view(np.uint64))
    return {"h": h.view(np.uint64)[order], "n": n[order]}


def ordered_prefix(found: np.ndarray, size: int, frequent: dict[str, np.ndarray]) -> np.ndarray:
    """The first ``size`` shingles, rare ones first and by hash, then frequent ones by count."""
    known = frequent["h"]
    if not len(known) or not len(found):
        return found[:size]
    at = np.searchsorted(known, found)
    at[at == len(known)] = 0
    count = np.where(known[at] == found, frequent["n"][at], 0)
    return found[np.lexsort((found, count))[:size]]


FIELDS = "n_shingles long, digest binary, signature binary, prefix array<long>"


def describe(frequent: Sent, near: Near, texts: pd.Series) -> pd.DataFrame:
    order = frequent.made(lambda table: table)
    rows = []
    for found in shingle_sets(texts, near.words):
        n = len(found)
        first = ordered_prefix(found, near.threshold.prefix(n), order).view(np.int64)
        digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest() if n else None
        rows.append((n, digest, near.coarse.signature(found).tobytes() if n else None, first))
    return pd.DataFrame(rows, columns=["n_shingles", "digest", "signature", "prefix"])


def sets_of(near: Near, texts: pd.Series) -> pd.Series:
    return pd.Series([found.tobytes() for found in shingle_sets(texts, near.words)], dtype=object)


def as_sets(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in column]


def by_width(rows: pd.DataFrame, widths: Widths, near: Near) -> list[pd.DataFrame]:
    """Rows with narrow signatures and those that fit them in size, and rows with wide ones."""
    n, t = rows["n"], near.threshold
    wide = n > widths.limit
    if not wide.any() or wide.all():
        return [rows]
    return [rows[~wide | (n * t.part <= widths.limit * t.over)], rows[wide]]


def small_pairs(near: Near, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All pairs (a, b) that signatures allow in small blocks; rows come sorted by block and size."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        last = held["h"] == held["h"].iloc[-1]
        done, held = held[~last], held[last]
        yield from pairs_by_distance(near, done)
    if held is not None:
        yield from pairs_by_distance(near, held)


def pairs_by_distance(near: Near, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    found = []
    for own in by_width(rows, near.coarse, near):
        h, n, node = own["h"].to_numpy(), own["n"].to_numpy(), own["node"].to_numpy()
        if len(n) < 2:
            continue
        bitmaps = near.coarse.stacked(list(own["signature"]), n)
        hidden = n - np.bitwise_count(bitmaps).sum(1).astype(np.int64)
        for d in range(1, near.small):
            i = np.flatnonzero(h[d:] == h[:-d])
            if not len(i):
                break
            most = np.bitwise_count(bitmaps[i] & bitmaps[i + d]).sum(1) + np.minimum(hidden[i], hidden[i + d])
            i = i[enough(most, n[i], n[i + d], n[i], n[i + d], near.threshold)]
            found.append(np.stack([node[i], node[i + d]]))
    if found and (all_ := np.concatenate(found, 1)).size:
        yield pd.DataFrame({"a": all_.min(0), "b": all_.max(0)}).drop_duplicates()


def stars(near: Near, task: pd.DataFrame) -> pd.DataFrame:
    """(node, root, tile, centre, signature) of the sets of one task; tiles are compared apart from each other."""
    return pd.concat([star(near, g) for _, g in task.groupby("tile")], ignore_index=True)


def star(near: Near, rows: pd.DataFrame) -> pd.DataFrame:
    """Every centre is compared with all sets that no link joins it with yet."""
    rows = rows.drop_duplicates("node").sort_values(["n", "node"], ignore_index=True)  # repeated rows
    n, sets = rows["n"].to_numpy(), as_sets(rows["elements"])
    groups, left, centre = Groups(len(n)), np.ones(len(n), bool), np.zeros(len(n), bool)
    signatures = [near.fine.signature(s).tobytes() for s in sets]
    bitmaps = near.fine.stacked(signatures, n)
    hidden = n - np.bitwise_count(bitmaps).sum(1).astype(np.int64)
    for i in range(len(n)):
        if not left[i]:
            continue
        centre[i], left[i] = True, False
        most = np.bitwise_count(bitmaps & bitmaps[i]).sum(1).astype(np.int64) + np.minimum(hidden, hidden[i])
        may = enough(most, n, n[i], n, n[i], near.threshold)
        may[i] = False
        # Sets in no star first: those outside need no comparison once their star has joined.
        for j in sorted(np.flatnonzero(may), key=lambda j: not left[j]):
            if groups.find(i) != groups.find(j) and near.threshold.links(n[i], n[j], common(sets[i], sets[j])):
                groups.join(i, j)
                left[j] = False
    root = rows["node"].to_numpy()[[groups.find(i) for i in range(len(n))]]
    found = {"node": rows["node"], "root": root, "tile": rows["tile"], "centre": centre, "signature": signatures}
    return pd.DataFrame(found)


class Part:
    """Rows of a part of a block, and the tree over their signatures."""

    def __init__(self, rows: pd.DataFrame, near: Near):
        rows = rows.sort_values(["n", "node"])
        self.node, self.n, self.root, self.tile, self.centre = (
            rows[c].to_numpy() for c in ("node", "n", "root", "tile", "centre")
        )
        self.bitmaps = near.fine.stacked(list(rows["signature"]), self.n)

    def tree(self, near: Near, narrow: bool) -> Tree:
        return Tree(near.fine.narrowed(self.bitmaps) if narrow else self.bitmaps, self.n, self.root)


def tree_pairs(rows: pd.DataFrame, near: Near) -> Iterator[np.ndarray]:
    """Pairs of different groups that may be linked and were not compared, between two parts of a block or in one."""
    for own in by_width(rows, near.fine, near):
        first = own["first"].to_numpy()
        if own["p"].iloc[0] == own["q"].iloc[0]:
            parts = [Part(own, near)]
        elif first.any() and not first.all():
            parts = [Part(own[first], near), Part(own[~first], near)]
        else:
            continue
        narrow = len({p.bitmaps.shape[1] for p in parts}) > 1
        trees = [p.tree(near, narrow) for p in parts]
        a, b = parts[0], parts[-1]
        for x, y in pairs(trees[0], trees[1] if len(trees) > 1 else None, near.threshold):
            new = ~((a.tile[x] == b.tile[y]) & (a.centre[x] | b.centre[y]))
            yield np.stack([a.node[x[new]], b.node[y[new]]])


def linked_parts(near: Near, rows: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) between the groups of two parts of a block: what the trees let through is compared at once.

    Pairs whose groups a link has joined are passed over, so there are fewer links than groups.
    """
    rows = rows.drop_duplicates("node", ignore_index=True)  # repeated rows
    sets = as_sets(rows["elements"])
    rows["signature"] = [near.fine.signature(s).tobytes() for s in sets]
    at = {node: i for i, node in enumerate(rows["node"])}
    number = np.unique(rows["root"], return_inverse=True)[1]
    groups, links = Groups(len(rows)), []
    for found in tree_pairs(rows, near):
        for a, b in zip(*found.tolist()):
            i, j = at[a], at[b]
            x, y = int(number[i]), int(number[j])
            if groups.find(x) != groups.find(y) and near.threshold.links(len(sets[i]), len(sets[j]), common(sets[i], sets[j])):
                groups.join(x, y)
                links.append((min(a, b), max(a, b)))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def verified(near: Near, listed: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
    """Links among the listed pairs of a task; pairs that its links connect already are passed over."""
    at = {node: i for i, node in enumerate(sets["node"])}
    elements = as_sets(sets["elements"])
    groups, links = Groups(len(elements)), []
    for a, b in zip(listed["a"], listed["b"]):
        i, j = at[a], at[b]
        if groups.find(i) != groups.find(j):
            if near.threshold.links(len(elements[i]), len(elements[j]), common(elements[i], elements[j])):
                groups.join(i, j)
                links.append((a, b))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: Near = Near()
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, class_size, component_size.

    component_id is the smallest id that links reach (nulls last); class_size counts the rows with an equal
    set, component_size all rows of the component. Texts that are null, empty or blank have no shingle,
    are linked with nothing, not with each other either, and keep their own id. Rows that repeat an id are rows like
    others. Only the two named columns are read; an empty table gives an empty result.
    """
    return grouped(docs, id_col, text_col, near).drop("_text", "_root").withColumnRenamed("_id", id_col)


def grouped(docs: DataFrame, id_col: str, text_col: str, near: Near) -> DataFrame:
    """The columns of ``components`` with the hash of the text and the component's node (null: no shingle)."""
    rows = described(docs, id_col, text_col, near)
    nodes = stage(node_table(rows), "nodes")
    shared = stage(shared_postings(nodes, near), "shared")
    large = shared.filter(F.col("size") > near.small)
    listed = stage(pairs_in_small(shared.filter(F.col("size") <= near.small), nodes, near), "listed")
    placed = stage(tiled(large.groupBy("node", "n").agg(F.min_by("h", "place").alias("anchor")), near), "placed")
    sets = stage(needed_sets(docs, id_col, text_col, nodes, listed, placed, near), "sets")
    drawn = stars_of_blocks(placed, sets, near)
    links = drawn.select(F.col("node").alias("a"), F.col("root").alias("b")).union(verified_links(listed, sets, near))
    roots = connected(sets.select("node").distinct(), links)
    roots = connected(roots, links_in_large(large, drawn, roots, sets, near), roots)
    return labelled(rows, nodes, roots)


def described(docs: DataFrame, id_col: str, text_col: str, near: Near) -> DataFrame:
    """Id, hash of the text, number of shingles, digest, signature and prefix of every row, written once."""
    order = Sent(docs.sparkSession, frequent_shingles(docs, text_col, near))
    describe_text = fields_udf(describe, FIELDS, order, near)
    text = F.col(text_col)
    found = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_text"), describe_text(text).alias("_d"))
    return stage(found.select("_id", "_text", "_d.*", F.monotonically_increasing_id().alias("_row")), "described")


def node_table(rows: DataFrame) -> DataFrame:
    """One node for each distinct set: the row number of one holder, with what was found of it."""
    sets = rows.filter(F.col("digest").isNotNull())
    chosen = sets.groupBy("digest").agg(F.min("_row").alias("_row"), F.count("*").alias("class_size"))
    held = sets.select("_row", "_id", "_text", F.col("n_shingles").alias("n"), "signature", "prefix")
    return chosen.join(held, "_row").withColumnRenamed("_row", "node")


def shared_postings(nodes: DataFrame, near: Near) -> DataFrame:
    """(h, node, n, place, size of the block) of prefix shingles that another node of a fitting size has as well.

    Two linked nodes meet in the block of the first shingle that they share. None of what a node has before it is
    shared, so its place bounds the size of the other (``reach``). In order of size, a block falls apart wherever
    no node before reaches any behind; h is then the block's part. One exchange of numbers; a block's rows
    stream through a sort that spills.
    """
    part, over = near.threshold.part, near.threshold.over
    postings = nodes.select("node", "n", F.posexplode("prefix").alias("place", "h"))
    n, by_size = F.col("n"), Window.partitionBy("h").orderBy("n", "node")
    reach = F.floor((over * n - (part + over) * F.col("place")) / part)
    before = F.max("reach").over(by_size.rowsBetween(Window.unboundedPreceding, -1))
    found = postings.withColumn("reach", reach).withColumn("_met", F.coalesce(before >= n, F.lit(False)))
    onward = F.coalesce(F.lead("_met").over(by_size), F.lit(False))
    found = found.withColumn("_on", onward).filter("_met or _on")
    # A node that none before reaches begins a part.
    found = found.withColumn("_run", F.sum((~F.col("_met")).cast("long")).over(by_size))
    found = found.withColumn("size", F.count("*").over(Window.partitionBy("h", "_run")))
    return found.select(F.xxhash64("h", "_run").alias("h"), "node", "n", "place", "size")


def pairs_in_small(small: DataFrame, nodes: DataFrame, near: Near) -> DataFrame:
    """Distinct pairs (a, b) of nodes of small blocks that may be linked."""
    ship()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from small_pairs(near, batches)
        give_back()

    rows = small.select("h", "node", "n").join(nodes.select("node", "signature"), "node").repartition("h")
    return rows.sortWithinPartitions("h", "n", "node").mapInPandas(search, "a long, b long").distinct()


def tiled(nodes: DataFrame, near: Near) -> DataFrame:
    """Nodes with a tile, a part of bounded volume of those with one anchor, and the task that compares it."""
    load = nodes.groupBy("anchor").agg(F.sum("n").alias("_load"))
    parts = F.ceil(F.col("_load") / F.lit(near.task))
    tile = F.xxhash64("anchor", F.pmod(F.xxhash64("node", F.lit("part")), parts))
    total = int(nodes.agg(F.sum("n")).first()[0] or 0)
    task = F.pmod(F.xxhash64("tile"), F.lit(max(1, -(-total // near.task))))
    found = nodes.join(load, "anchor").select("node", "n", "anchor", tile.alias("tile"), (parts > 1).alias("split"))
    return found.withColumn("task", task)


def stars_of_blocks(placed: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """(node, root, tile, centre, signature) of all nodes of large blocks.

    Where an anchor has several tiles, their roots meet once more.
    """
    ship()

    def compare(task: pd.DataFrame) -> pd.DataFrame:
        found = stars(near, task)
        give_back()
        return found

    def drawn(rows: DataFrame) -> DataFrame:
        columns = "node long, root long, tile long, centre boolean, signature binary"
        own = rows.select("node", "n", "elements", "tile", "task")
        return stage(own.groupBy("task").applyInPandas(compare, columns), "stars")

    first = drawn(sets.filter(F.col("tile").isNotNull()))
    again = placed.filter("split").join(first.filter("node = root").select("node"), "node", "left_semi")
    again = stage(tiled(again.select("node", "n", "anchor"), near), "again")
    if again.isEmpty():
        return first
    held = maybe_among(sets.select(F.col("node").alias("_node"), "elements"), "_node", again, "node")
    merged = drawn(again.join(held, F.col("node") == F.col("_node")))
    merged = merged.select(F.col("node").alias("root"), F.col("root").alias("_to"))
    return stage(first.join(merged, "root", "left").withColumn("root", F.coalesce("_to", "root")).drop("_to"), "drawn")


def links_in_large(large: DataFrame, drawn: DataFrame, roots: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """Links (a, b) between nodes of different groups in large blocks, but for some that other links connect anyway.

    A block is cut into parts of bounded volume, and every two parts meet in a task of their own, with their sets: it
    emits links, never what may be one, so what comes out is less than what went in.
    """
    rows = large.select("h", "node", "n").join(roots, "node")
    live = rows.groupBy("h").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.sum("n").alias("_load"))
    live = live.filter("_a < _b").select("h", F.ceil(F.col("_load") * 2 / F.lit(near.task)).cast("int").alias("parts"))
    rows = rows.join(live, "h").withColumn("part", F.pmod(F.xxhash64("node", F.lit("block")), F.col("parts")).cast("int"))
    meets = F.transform(  # every two parts, and each with itself
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda o: F.struct(F.least(o, "part").alias("p"), F.greatest(o, "part").alias("q")),
    )
    dealt = rows.select("h", "node", "n", "root", "part", F.explode(meets).alias("_with"))
    first = (F.col("part") == F.col("_with.p")).alias("first")
    dealt = dealt.select("h", "_with.p", "_with.q", "node", "n", "root", first)
    dealt = stage(dealt.join(drawn.select("node", "tile", "centre"), "node"), "dealt")
    if dealt.isEmpty():
        return dealt.select(F.col("node").alias("a"), F.col("node").alias("b"))
    # Only the sets of blocks with several groups are moved.
    held = sets.filter(F.col("tile").isNotNull()).select(F.col("node").alias("_node"), "elements")
    held = maybe_among(held, "_node", dealt, "node").dropDuplicates(["_node"])
    dealt = dealt.join(held, F.col("node") == F.col("_node")).drop("_node")
    ship()

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        found = linked_parts(near, rows)
        give_back()
        return found

    return stage(dealt.groupBy("h", "p", "q").applyInPandas(link, "a long, b long"), "links")


def needed_sets(
    docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame, listed: DataFrame, placed: DataFrame, near: Near
) -> DataFrame:
    """(node, n, elements, tile, task) of the nodes of listed pairs and of large blocks.

    Their holders' texts are read again; a bitmap of fixed size over the hashes of these texts keeps most others out of
    the shuffle. Repeated rows give a node more than once.
    """
    ends = listed.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    tiles = placed.select("node", "tile", "task")
    needed = ends.join(tiles, "node", "full")
    holders = stage(nodes.select("node", "n", "_id", "_text").join(needed, "node"), "holders")
    texts = docs.select(F.col(id_col).alias("_own"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_whole"))
    texts = maybe_among(texts, "_hash", holders, "_text")
    found = texts.join(holders, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text")))
    return found.select("node", "n", value_udf(sets_of, "binary", near)("_whole").alias("elements"), "tile", "task")


def maybe_among(rows: DataFrame, key: str, among: DataFrame, other: str, bits: int = 1 << 25) -> DataFrame:
    """Rows whose hash ``key`` may be among the hashes ``other``: a broadcast bitmap of ``bits`` bits says no to the rest."""
    number = lambda c: F.pmod(F.col(c), F.lit(bits))
    maps = among.select(number(other).alias("_bit"))
    maps = maps.groupBy(F.bitmap_bucket_number("_bit").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_map")
    )  # at most bits / 32768 rows of 4 KiB
    at = F.bitmap_bit_position("_number")
    byte = F.conv(F.hex(F.substring("_map", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    numbered = rows.withColumn("_number", number(key)).withColumn("_bucket", F.bitmap_bucket_number("_number"))
    joined = numbered.join(F.broadcast(maps), "_bucket")
    return joined.filter(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def verified_links(listed: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """Those listed pairs that are linked, but for some that other links connect anyway.

    Pairs are dealt by the least node beside their first one, which brings the pairs of a dense group together;
    many pairs of one such node go to several tasks. A task gets each set once.
    """
    listed = stage(listed, "pairs")
    least = listed.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("_least"))
    keyed = listed.join(least, "a", "left").select("a", "b", F.coalesce("_least", "a").alias("_key"))
    load = keyed.groupBy("_key").agg(F.count("*").alias("_n"))
    part = F.pmod(F.xxhash64("b", F.lit("rays")), F.ceil(F.col("_n") / F.lit(near.rays)))
    # The list is written with its keys, so it is searched for once.
    keyed = stage(keyed.join(load, "_key").select("a", "b", F.xxhash64("_key", part).alias("_key")), "keyed")
    wanted = keyed.select("_key", F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = stage(wanted.join(sets.select("node", "n").distinct(), "node"), "wanted")
    tasks = max(1, -(-int(wanted.agg(F.sum("n")).first()[0] or 0) // near.task))
    number = F.pmod(F.xxhash64("_key"), F.lit(tasks)).alias("task")
    held = maybe_among(sets.select(F.col("node").alias("_node"), "elements"), "_node", wanted, "node")
    elements = wanted.select("node", number).distinct().join(held, F.col("node") == F.col("_node"))
    elements = elements.select("node", "elements", "task")

    def verify(listed: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        found = verified(near, listed, sets)
        give_back()
        return found

    ship()
    grouped = keyed.select("a", "b", number).groupBy("task").cogroup(elements.groupBy("task"))
    return stage(grouped.applyInPandas(verify, "a long, b long"), "verified")


def connected(nodes: DataFrame, links: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(node, root) of all ``nodes``: groups of ``roots`` (at first each node alone) joined by the links."""
    roots = stage(nodes.select("node", F.col("node").alias("root")), "alone") if roots is None else roots
    to = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"_{end}"))
    edges = links.join(to("a"), "a").join(to("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    edges = stage(edges.filter("a <> b").distinct(), "edges")
    if edges.isEmpty():
        return stage(roots, "roots")
    reached = smallest_reachable(edges).select(F.col("node").alias("root"), F.col("root").alias("_to"))
    return stage(roots.join(reached, "root", "left").select("node", F.coalesce("_to", "root").alias("root")), "roots")


def labelled(rows: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Each row with its class and component."""
    classes = nodes.select("digest", "node", "class_size").join(roots, "node", "left")
    classes = classes.select("digest", "class_size", F.coalesce("root", "node").alias("root"))
    found = rows.select("_id", "_text", "n_shingles", "digest").join(classes, "digest", "left")
    sizes = found.filter(F.col("root").isNotNull()).groupBy("root")
    sizes = sizes.agg(F.min("_id").alias("_least"), F.count("*").alias("component_size"))
    return found.join(sizes, "root", "left").select(
        "_id",
        "_text",
        F.col("root").alias("_root"),
        "n_shingles",
        F.when(F.col("root").isNull(), F.col("_id")).otherwise(F.col("_least")).alias("component_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("component_size", F.lit(1)).cast("long").alias("component_size"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: Near = Near()) -> DataFrame:
    """Rows of ``docs``, all columns: one row of each component, that of the smallest id (null ids come last).

    Rows are told apart by id and text, so a row that shares its id with a copy of another stays if its own text is like no other's. Of
    rows with the staying id the smallest hash of the text decides, and of rows alike in both one stays. Rows without
    any shingle all stay. An empty table gives an empty result; columns of any name pass through.
    """
    found = stage(grouped(docs, id_col, text_col, near).filter(F.col("_root").isNotNull()), "grouped")
    place = F.struct(F.col("_id").isNull().alias("absent"), "_id", "_text")
    kept = found.groupBy("_root").agg(F.min(place).alias("_kept"))
    gone = found.select("_root", "_id", "_text").distinct().join(kept, "_root")
    own, text = free_name(docs, "_gone_id"), free_name(docs, "_gone_text")
    gone = gone.filter(~F.col("_text").eqNullSafe(F.col("_kept._text")) | ~F.col("_id").eqNullSafe(F.col("_kept._id")))
    gone = gone.select(F.col("_id").alias(own), F.col("_text").alias(text))
    same = lambda other: F.col(id_col).eqNullSafe(other[own]) & (F.xxhash64(docs[text_col]) == other[text])
    left = docs.join(gone, same(gone), "left_anti")
    twice = found.groupBy("_id", "_text").agg(F.count("*").alias("_n")).filter("_n > 1")
    twice = twice.select(F.col("_id").alias(own), F.col("_text").alias(text))
    if twice.isEmpty():
        return left
    rank = free_name(docs, "_rank")
    alike = Window.partitionBy(id_col, F.xxhash64(text_col)).orderBy(F.lit(0))
    once = left.join(twice, same(twice), "left_semi").withColumn(rank, F.row_number().over(alike))
    return left.join(twice, same(twice), "left_anti").unionByName(once.filter(F.col(rank) == 1).drop(rank))
