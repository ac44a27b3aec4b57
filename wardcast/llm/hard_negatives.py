"""Hard negatives by exact integer scores, computed by the method of Four Russians.

Vectors become integers. Every eight dimensions of an anchor make a table of the 256 sums of their
subsets; every eight dimensions of a candidate make, for each binary digit of its components, one byte. A
score is then a sum of looked-up table rows, one digit plane at a time, each plane shifted by its weight
(the highest counts negative, as in two's complement). No score is estimated and no candidate skipped.

Candidates are packed once into blocks of bounded size, anchors into stripes. Every block meets every
stripe: both are dealt to the cells of a grid, and a cell is one task's work. What leaves a cell is the
best of its block for each anchor, so neither blocks nor scores are gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardcast.llm.shared import ship, stage

#: Rows of a block of candidates, anchors of a stripe, blocks that share a cell on average.
ROW_BITS = 12
BLOCK, STRIPE, BLOCKS_A_CELL = 1 << ROW_BITS, 1_024, 2
#: Tasks over the grid at most. They are set, since a cell has few bytes for its work.
TASKS = 8_192
#: Candidates and anchors that are scored at once, so that the tables stay in the processor's cache.
TILE = (512, 128)
NO_ID = np.iinfo(np.int64).max

PACKED = "block long, n int, bits int, dims int, ids binary, known binary, labels binary, planes binary, " \
    "anchors array<struct<row long, id long, label long, parts binary>>"  # fmt: skip


def whole_numbers(values: pa.ListArray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their components as integers, missing dimensions at the end as 0."""
    lengths = np.asarray(values.value_lengths().fill_null(0), np.int64)
    flat = values.flatten()
    with np.errstate(over="ignore", invalid="ignore"):
        floors = np.floor(np.asarray(flat.cast(pa.float64()).fill_null(np.nan)) * scale)
    owner = np.repeat(np.arange(len(values)), lengths)
    fine = np.asarray(values.is_valid()).copy()
    fine[owner[~np.isfinite(floors)]] = False
    width = int(lengths[fine].max()) if fine.any() else 0
    out = np.zeros((int(fine.sum()), width), np.int64)
    if np.abs(floors, where=np.isfinite(floors), out=np.zeros_like(floors)).max(initial=0) >= 2.0**62:
        raise ValueError("a component leaves 62 bits after scaling")
    kept = fine[owner]
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[(np.cumsum(fine) - 1)[owner[kept]], place[kept]] = floors[kept].astype(np.int64)
    return fine, out


def digits(parts: np.ndarray) -> int:
    """Binary digits that hold all components in two's complement."""
    low, high = int(parts.min(initial=0)), int(parts.max(initial=0))
    return max((~low).bit_length() if low < 0 else 0, high.bit_length()) + 1


def bit_planes(parts: np.ndarray, bits: int) -> np.ndarray:
    """Bytes by (plane, group of eight dimensions, row)."""
    wide = np.zeros((len(parts), -(-parts.shape[1] // 8) * 8), np.int64)
    wide[:, : parts.shape[1]] = parts
    return np.stack([np.packbits((wide >> p & 1).astype(np.uint8), axis=1, bitorder="little").T for p in range(bits)])


def pack(scale: int, size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of at most ``size`` rows, numbered by task and order."""
    part, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids, labels, anchor = (batch.column(k) for k in (0, 2, 3))
        fine, parts = whole_numbers(batch.column(1).cast(pa.list_(pa.float64())), scale)
        known = np.asarray(ids.is_valid())[fine]
        number = np.asarray(ids.fill_null(NO_ID))[fine]
        label, is_anchor = np.asarray(labels)[fine], np.asarray(anchor.fill_null(False))[fine]
        for at in range(0, len(number), size):
            cut = slice(at, at + size)
            block, own = (part << 24) + made, parts[cut]
            bits = digits(own)
            chosen = [
                {"row": (block << ROW_BITS) + int(i), "id": int(number[cut][i]), "label": int(label[cut][i]), "parts": own[i].tobytes()}
                for i in np.flatnonzero(is_anchor[cut])
            ]
            row = (
                block, len(own), bits, own.shape[1], number[cut].tobytes(), known[cut].tobytes(),
                label[cut].tobytes(), bit_planes(own, bits).tobytes(), chosen,
            )
            made += 1
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, ARROW)], names=NAMES)


ARROW = [
    pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(),
    pa.list_(pa.struct([("row", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("parts", pa.binary())])),
]
NAMES = "block n bits dims ids known labels planes anchors".split()


def subset_sums(parts: np.ndarray, kind: type) -> np.ndarray:
    """Tables by (group of eight dimensions, byte, anchor): the sum of the dimensions whose bit is set."""
    groups = -(-parts.shape[1] // 8)
    wide = np.zeros((len(parts), groups * 8), np.int64)
    wide[:, : parts.shape[1]] = parts
    out = np.zeros((groups, 256, len(parts)), kind)
    for bit in range(8):  # doubles the filled part of the table
        out[:, 1 << bit : 2 << bit] = out[:, : 1 << bit] + wide[:, bit::8].T[:, None, :].astype(kind)
    return out


def scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Exact inner products by (candidate, anchor) from looked-up rows, shifted by plane and added."""
    bits, groups = planes.shape[0], min(planes.shape[1], tables.shape[0])
    out = np.zeros((planes.shape[2], tables.shape[2]), tables.dtype)
    for plane in range(bits - 1, -1, -1):
        out <<= 1
        for group in range(groups):
            found = tables[group].take(planes[plane, group], axis=0)
            out = out - found if plane == bits - 1 else np.add(out, found, out=out)
    return out


class Block:
    """Candidates of a cell in order of (id, row), unpacked from one or several blocks."""

    def __init__(self, rows: pd.DataFrame):
        bits, dims = int(rows["bits"].max()), int(rows["dims"].max())
        kinds = {"ids": np.int64, "known": bool, "labels": np.int64}
        ids, known, labels = (np.concatenate([np.frombuffer(v, k) for v in rows[c]]) for c, k in kinds.items())
        row = np.concatenate([(b << ROW_BITS) + np.arange(n) for b, n in zip(rows["block"], rows["n"])])
        groups = -(-dims // 8)
        planes = np.zeros((bits, groups, len(ids)), np.uint8)
        at = 0
        for data, own_bits, own_dims, n in zip(rows["planes"], rows["bits"], rows["dims"], rows["n"]):
            own = np.frombuffer(data, np.uint8).reshape(own_bits, -(-own_dims // 8), n)
            planes[:own_bits, : own.shape[1], at : at + n] = own
            planes[own_bits:, : own.shape[1], at : at + n] = own[own_bits - 1]  # the sign goes on
            at += n
        order = np.lexsort((row, ids, ~known))
        self.ids, self.known, self.labels, self.row = ids[order], known[order], labels[order], row[order]
        self.planes, self.bits = np.ascontiguousarray(planes[:, :, order]), bits

    def tiles(self, mask: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """Scores of the masked candidates by (candidate, anchor)."""
        at, bound = np.flatnonzero(mask), parts.shape[1] * int(np.abs(parts).max(initial=0)) << self.bits
        if bound >= 1 << 62:
            raise ValueError("scores leave 64 bits")
        kind = np.int32 if bound < 1 << 30 else np.int64
        out = np.empty((len(at), len(parts)), np.int64)
        for a in range(0, len(parts), TILE[1]):
            tables = subset_sums(parts[a : a + TILE[1]], kind)
            for c in range(0, len(at), TILE[0]):
                planes = self.planes[:, :, at[c : c + TILE[0]]]
                out[c : c + TILE[0], a : a + TILE[1]] = scores(planes, tables)
        return out


def first(values: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest values, equal ones by position, best first."""
    if len(values) > k:
        edge = np.partition(values, len(values) - k)[len(values) - k]
        at = np.flatnonzero(values >= edge)
    else:
        at = np.arange(len(values))
    return at[np.argsort(-values[at], kind="stable")][:k]


def anchor_parts(anchors: pd.DataFrame) -> np.ndarray:
    rows = [np.frombuffer(p, np.int64) for p in anchors["parts"]]
    out = np.zeros((len(rows), max(map(len, rows))), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def best_positives(k: int, blocks: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
    """The best ``k`` other rows of an anchor's label among a cell's candidates."""
    out = []
    if len(blocks) and len(anchors):
        block = Block(blocks)
        for label, own in anchors.groupby("label", sort=False):
            same = block.labels == label
            if not same.any():
                continue
            found = block.tiles(same, anchor_parts(own))
            at = np.flatnonzero(same)
            for i, (row, id_) in enumerate(zip(own["row"], own["id"])):
                other = block.row[at] != row
                for j in first(found[other, i], k):
                    c = at[other][j]
                    out.append((row, id_, label, id_or_none(block, c), block.row[c], found[other, i][j]))
    return pd.DataFrame(out, columns=POSITIVE_NAMES).astype({"positive_id": "Int64"})


def id_or_none(block: Block, at: int) -> int | None:
    return int(block.ids[at]) if block.known[at] else None


POSITIVES = "anchor long, anchor_id long, label long, positive_id long, positive long, positive_score long"
POSITIVE_NAMES = [f.split()[0] for f in POSITIVES.split(", ")]


def best_negatives(k: int, low: int, high: int, blocks: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
    """For each positive of an anchor the best ``k`` of other labels within the range of scores."""
    out = []
    if len(blocks) and len(anchors):
        block = Block(blocks)
        for at in range(0, len(anchors), TILE[1]):
            own = anchors.iloc[at : at + TILE[1]]
            found = block.tiles(np.ones(len(block.ids), bool), anchor_parts(own))
            for i, (row, label, positives) in enumerate(zip(own["row"], own["label"], own["positives"])):
                other = np.flatnonzero(block.labels != label)
                values = found[other, i]
                for nth, score in enumerate(positives, 1):
                    fits = np.flatnonzero((100 * values >= low * score) & (100 * values <= high * score))
                    for j in first(values[fits], k):
                        c = other[fits[j]]
                        out.append((row, nth, id_or_none(block, c), block.row[c], values[fits[j]]))
    return pd.DataFrame(out, columns=NEGATIVE_NAMES).astype({"negative_id": "Int64"})


NEGATIVES = "anchor long, nth int, negative_id long, negative long, negative_score long"
NEGATIVE_NAMES = [f.split()[0] for f in NEGATIVES.split(", ")]


def packed(rows: DataFrame, scale: int, block: int) -> DataFrame:
    ship()
    return stage(rows.mapInArrow(lambda batches: pack(scale, block, batches), PACKED), "blocks")


def in_cells(blocks: DataFrame, anchors: DataFrame, stripes: int, cells: int, function, returns: str) -> DataFrame:
    """``function`` of the blocks and the anchors of every cell of the grid (stripe, share of the blocks)."""
    share = F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = blocks.drop("anchors").withColumn("_share", share).withColumn("_stripe", every(stripes))
    stripe = F.pmod(F.xxhash64("row"), F.lit(stripes)).cast("int")
    right = anchors.withColumn("_stripe", stripe).withColumn("_share", every(cells))
    key, n = ["_stripe", "_share"], min(stripes * cells, TASKS)
    left, right = left.repartition(n, *key), right.repartition(n, *key)
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(function, returns)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    score_percent: tuple[int, int] = (30, 90),
    block: int = BLOCK,
    stripe: int = STRIPE,
) -> DataFrame:
    """For each anchor and each of its positives, the hardest rows of other labels.

    Components become floor(scale * x). An anchor's positives are the ``positives`` other rows of its label with
    the highest inner product; a positive's negatives the ``negatives`` best rows of other labels whose product is
    between the given percentages of the positive's. Equal products are ordered by the smaller id, null ids last.
    Result: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows without a label or vector, or with a null or non-finite component, take no part. Ids and labels are
    integers. Rows that repeat an id are rows of their own. Vectors of unequal length are compared as if the shorter one went on
    with zeros; empty ones score 0. A product beyond 62 bits is an error. Other columns are not read; an empty table,
    or one without anchors, gives an empty result.
    """
    if block > BLOCK:
        raise ValueError(f"a block has at most {BLOCK} rows")
    rows = vectors.filter(F.col(vector_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"),
        F.col(label_col).cast("long").alias("label"), is_anchor.alias("anchor"),
    )
    blocks = packed(rows, scale, block)
    chosen = blocks.select(F.explode("anchors").alias("a")).select("a.*")
    n_blocks, n_anchors = blocks.agg(F.count("*"), F.coalesce(F.sum(F.size("anchors")), F.lit(0))).first()
    stripes, cells = max(1, -(-n_anchors // stripe)), max(1, -(-n_blocks // BLOCKS_A_CELL))
    deal = lambda anchors, function, returns: in_cells(blocks, anchors, stripes, cells, function, returns)

    near = deal(chosen, lambda left, right: best_positives(positives, left, right), POSITIVES)
    best = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"), "positive")
    near = stage(near.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= positives), "positives")
    ranked = F.array_sort(F.collect_list(F.struct("nth", "positive_score")))
    lists = near.groupBy("anchor").agg(F.transform(ranked, lambda p: p["positive_score"]).alias("positives"))
    asked = chosen.join(lists.withColumnRenamed("anchor", "row"), "row")

    low, high = score_percent
    far = deal(asked, lambda left, right: best_negatives(negatives, low, high, left, right), NEGATIVES)
    pair = Window.partitionBy("anchor", "nth").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "negative")
    far = far.withColumn("rank", F.row_number().over(pair)).filter(F.col("rank") <= negatives)
    return near.select("anchor", "nth", "anchor_id", "positive_id", "positive_score").join(far, ["anchor", "nth"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
