"""Token sequences in training order, as records of one length.

Texts are encoded once, packed one behind the other within a writing task and cut into sequences, which are
numbered without gaps; only the last sequence of a task is filled up. A keyed Feistel permutation, walked along its cycle until it falls below their number, gives every sequence a global
slot: a shuffle that needs no sort, can be computed for any one sequence and is undone with the same key.
Slots fall evenly into shards; each range of shards is one partition in order of slots, so shards can be
written and read sequentially, and reading resumes at ``slot * stride`` bytes. A manifest beside the shards names
layout, input and count: a run that broke off goes on with the staged sequences and moves tokens of lacking shards only.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from wardcast.llm.shared import VOCABULARIES, encoding, folder, give_back, ship, value_udf

ROUNDS = 6
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Layout:
    vocabulary: str = f"{VOCABULARIES}/byte_bpe_multi_50k.tiktoken"
    #: Token after each document; fills up the last sequence of a task. Ids are stored in 16 bits.
    end_token: int = 50_256
    sequence: int = 512
    #: Sequences in a shard.
    shard: int = 8_192
    key: int = 2_024
    #: Sequences of a partition of the result, about.
    partition: int = 65_536
    #: Sequences are compressed on their way to their shards by a dictionary of so many bytes, learned from so many sequences.
    dictionary: int = 65_536
    dictionary_sample: int = 2_048

    @property
    def stride(self) -> int:
        """Bytes of a record."""
        return 2 * self.sequence


#: Sequences of a batch that a packing task hands on.
BATCH = 4_096


def packed(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    """The sequences of a task: each text's tokens as little-endian 16-bit ids and its end token, text behind text.

    With a sequence come the ids of the documents in it, the part of each that it holds and that part's tokens, in order.
    """
    codec = encoding(layout.vocabulary)
    rows: list[tuple[list, list[int], list[int], bytes]] = []
    ids, parts, sizes, data = [], [], [], bytearray()

    def batch() -> pa.RecordBatch:
        types = (pa.list_(kind), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(PACKED))

    for texts in batches:
        kind = texts.schema.field(0).type
        for id_, text in zip(texts.column(0).to_pylist(), texts.column(1)):
            tokens = codec.encode_ordinary(text.as_py() or "")
            tokens.append(layout.end_token)
            tokens = np.array(tokens, "<u2").tobytes()
            part = at = 0
            while at < len(tokens):
                piece = tokens[at : at + layout.stride - len(data)]
                data += piece
                ids.append(id_)
                parts.append(part)
                sizes.append(len(piece) // 2)
                part, at = part + 1, at + len(piece)
                if len(data) == layout.stride:
                    rows.append((ids, parts, sizes, bytes(data)))
                    ids, parts, sizes, data = [], [], [], bytearray()
                    if len(rows) == BATCH:
                        yield batch()
                        rows.clear()
    if data:
        rows.append((ids, parts, sizes, bytes(data)))
    if rows:
        yield batch()
        rows.clear()
    give_back()


PACKED = ("ids", "parts", "sizes", "tokens")


def round_keys(key: int) -> list[np.uint64]:
    rng = np.random.RandomState(key % (1 << 32))
    return [np.uint64(k) for k in rng.randint(0, 2**63, ROUNDS, dtype=np.uint64)]


def half_bits(count: int) -> int:
    """Bits of each half of the least even-width block that holds ``count`` numbers."""
    return max(1, ((max(count, 2) - 1).bit_length() + 1) // 2)


def scrambled(half: np.ndarray, key: np.uint64, mask: np.uint64) -> np.ndarray:
    mixed = (half ^ key) * MULTIPLIER
    return ((mixed ^ (mixed >> np.uint64(31))) * MULTIPLIER >> np.uint64(24)) & mask


def permuted(numbers: np.ndarray, count: int, key: int, back: bool = False) -> np.ndarray:
    """A keyed permutation of 0 to ``count - 1`` (``back``: its inverse)."""
    bits = np.uint64(half_bits(count))
    mask = np.uint64((1 << int(bits)) - 1)
    keys = round_keys(key)

    def walk(x: np.ndarray) -> np.ndarray:
        left, right = x >> bits, x & mask
        for k in reversed(keys) if back else keys:
            if back:
                left, right = right ^ scrambled(left, k, mask), left
            else:
                left, right = right, left ^ scrambled(right, k, mask)
        return left << bits | right

    out = walk(np.asarray(numbers, np.uint64))
    while (outside := out >= count).any():  # numbers below ``count`` return to there on every cycle
        out[outside] = walk(out[outside])
    return out.astype(np.int64)


def slots(count: int, key: int, numbers: pd.Series) -> pd.Series:
    return pd.Series(permuted(numbers.to_numpy(np.int64), count, key))


def write_sequences(docs: DataFrame, id_col: str, text_col: str, layout: Layout, path: str) -> None:
    """The packed sequences of all texts as a table; each writing task counts its own from 0."""
    ship()
    own, whole = docs.select(F.col(id_col), F.col(text_col)), IntegerType()
    kinds = (ArrayType(own.schema[0].dataType), ArrayType(whole), ArrayType(whole), BinaryType())
    cut = own.mapInArrow(lambda b: packed(b, layout), StructType([StructField(n, k) for n, k in zip(PACKED, kinds)]))
    cut = cut.withColumn("_at", F.monotonically_increasing_id())
    cut.write.mode("overwrite").option("parquet.compression.codec.zstd.level", 9).parquet(path, compression="zstd")


def numbered(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The sequences of a written table with a number from 0 without gaps, and how many there are.

    A table with one row per writing task says where its numbers begin.
    """
    written = spark.read.parquet(path)
    task, place = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = {r["_task"]: r["n"] for r in written.groupBy(task.alias("_task")).agg(F.count("*").alias("n")).toLocalIterator()}
    begins, total = [], 0
    for t in sorted(sizes):  # one number per writing task
        begins.append((t, total))
        total += sizes[t]
    begin = spark.createDataFrame(begins, "_task long, _begin long")
    rows = written.withColumn("_task", task).join(F.broadcast(begin), "_task")
    return rows.select(*PACKED, (F.col("_begin") + place).alias("number")), total


def learned(rows: DataFrame, layout: Layout) -> bytes:
    """A dictionary from a few sequences; it changes the bytes that are moved only. Empty where they are too few or too alike."""
    some = [r["tokens"] for r in rows.select("tokens").limit(layout.dictionary_sample).collect()]
    try:
        return zstandard.train_dictionary(layout.dictionary, some).as_bytes() if some else b""
    except zstandard.ZstdError:
        return b""


@lru_cache(maxsize=2)
def dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def squeezed(data: bytes, records: pd.Series) -> pd.Series:
    codec = zstandard.ZstdCompressor(level=3, dict_data=dictionary(data), write_dict_id=False)
    return pd.Series([codec.compress(r) for r in records], dtype=object)


def opened(data: bytes, layout: Layout, records: list[bytes | None]) -> list[bytes | None]:
    """What ``squeezed`` was given, filled up with the end token to one stride; null stays."""
    codec, filling = zstandard.ZstdDecompressor(dict_data=dictionary(data)), layout.end_token.to_bytes(2, "little")
    found = [None if r is None else codec.decompress(r) for r in records]
    return [r if r is None else r + filling * ((layout.stride - len(r)) // 2) for r in found]


def finished(bits: bytes, shards: pd.Series) -> pd.Series:
    """Whether the bit of each shard is set."""
    at = shards.to_numpy(np.int64)
    return pd.Series((np.frombuffer(bits, np.uint8)[at >> 3] >> (at & 7) & 1).astype(bool))


def in_slots(rows: DataFrame, count: int, id_col: str, layout: Layout, words: bytes, there: bytes = b"") -> DataFrame:
    """Numbered sequences as records in partitions of consecutive shards, in order of slots; ``opened`` gives their bytes.

    ``words`` is the dictionary. ``there`` has a bit for each shard that is finished: its records are null, their tokens are not moved.
    """
    slot = value_udf(slots, "long", count, layout.key)(F.col("number"))
    tokens = value_udf(squeezed, "binary", words)(F.col("tokens"))
    rows = rows.withColumns({"slot": slot, "tokens": tokens}).drop("number")
    shard = F.floor(F.col("slot") / layout.shard)
    if any(there):
        done = value_udf(finished, "boolean", there)(shard)
        rows = rows.withColumn("tokens", F.when(~done, F.col("tokens")))
    shards = -(-count // layout.shard)
    partitions = max(1, min(shards, -(-count // layout.partition)))
    dealt = rows.repartitionById(partitions, F.floor(shard * partitions / F.lit(max(1, shards))).cast("int"))
    return dealt.sortWithinPartitions("slot").select(
        "slot",
        shard.alias("shard"),
        (F.col("slot") % layout.shard * layout.stride).alias("byte_offset"),
        F.col("ids").alias(f"{id_col}s"),
        "parts",
        F.col("sizes").alias("n_tokens"),
        F.col("tokens").alias("record"),
    )


def training_records(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", layout: Layout = Layout()
) -> DataFrame:
    """One row per sequence: slot, shard, byte_offset in the shard, ids, parts, n_tokens, record.

    Rows are in partitions of consecutive shards and ordered by slot. The lists ``<id_col>s``, ``parts`` and ``n_tokens``
    say which documents the sequence holds one behind the other, which part of each (from 0) and with how many tokens;
    ``record`` is the sequence, filled up with the end token to one stride where a writing task ended. Every row of ``docs``
    gives its tokens and the end token; null counts as empty; repeated rows and null ids are rows like others. An empty
    table gives an empty result.
    """
    path = folder(docs.sparkSession, "sequences")
    write_sequences(docs, id_col, text_col, layout, path)
    rows, count = numbered(docs.sparkSession, path)
    words = learned(rows, layout)
    record = value_udf(lambda records: pd.Series(opened(words, layout, records), dtype=object), "binary")
    return in_slots(rows, count, id_col, layout, words).withColumn("record", record("record"))


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


#: What rows of written shards have besides the columns of their records.
CHECKS = (StructField("crc32", LongType()), StructField("shard_crc32", LongType()), StructField("path", StringType()))


class Shard:
    """A shard that is being written beside its place; ``close`` renames it. One that is ``there`` is only read."""

    def __init__(self, folder: str, number: int, there: bool = False):
        self.number, self.path = int(number), f"{folder}/{shard_name(number)}"
        self.rows = self.size = self.crc = 0
        self.file, suffix = None, f".{os.getpid()}.{os.urandom(4).hex()}"
        self.temporary, self.sum = f"{folder}/.{shard_name(number)}{suffix}", f"{self.path}.crc32"
        if there:
            self.crc = read_sum(self.sum)
        else:
            os.makedirs(folder, exist_ok=True)
            self.file = open(self.temporary, "wb")  # noqa: SIM115

    def add(self, records: list[bytes]) -> None:
        self.rows += len(records)
        if self.file:
            data = b"".join(records)
            self.file.write(data)
            self.size, self.crc = self.size + len(data), zlib.crc32(data, self.crc)

    def close(self) -> bool:
        """Whether the shard is new: one that is there with its full length and checksum is left as it is."""
        if not self.file:
            return False
        self.file.close()
        fresh = not same_file(self.path, self.size, self.crc)
        with open(f"{self.temporary}.crc32", "w") as file:
            file.write(str(self.crc))
        os.replace(f"{self.temporary}.crc32", self.sum)
        if fresh:
            os.replace(self.temporary, self.path)
        else:
            os.remove(self.temporary)
        return fresh


def read_sum(path: str) -> int:
    with open(path) as file:
        return int(file.read())


def write_shards(
    records: DataFrame, folder: str, layout: Layout = Layout(), rows: bool = False, words: bytes | None = None
) -> DataFrame:
    """Write records as files of fixed stride to a folder that all executors share.

    Returns one row per shard: shard, path, records, bytes, crc32, written. A shard is written beside its
    place and renamed when complete, so a task that runs again leaves no torn file; a shard that is there with
    its full length and checksum is left as it is, which makes a broken run resumable.

    With ``rows``, returns one row per record as it lies in its file, with the columns of ``records``, crc32 (of
    the record), shard_crc32 and path. Each shard is read again where it was written, and a file that differs from what
    was written, by its checksum, is an error; what a task holds is one shard's columns without the records. With ``words``
    records come as ``squeezed`` by that dictionary.
    """
    folder = local_path(folder)
    ship()
    if rows:
        return records.mapInArrow(
            lambda batches: rows_of_shards(batches, folder, layout, words),
            StructType([*records.schema, *CHECKS]),
        )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, fresh, _ in shards_of(batches, folder):
            one = (shard.number, shard.path, shard.rows, shard.size, shard.crc, fresh)
            yield pa.RecordBatch.from_pydict({c: [v] for c, v in zip(names, one)})

    names = ["shard", "path", "records", "bytes", "crc32", "written"]
    return records.select("shard", "record").mapInArrow(
        write, "shard long, path string, records long, bytes long, crc32 long, written boolean"
    )


def local_path(folder: str) -> str:
    """The path that Python opens; shards lie in a folder that is mounted wherever tasks run."""
    scheme, _, rest = folder.rpartition(":/")
    if scheme not in ("", "file"):
        raise ValueError(f"shards need a folder that every executor can open, not {folder}")
    return f"/{rest.lstrip('/')}" if scheme else folder


def shards_of(
    batches: Iterator[pa.RecordBatch], folder: str, words: bytes | None = None, layout: Layout = Layout()
) -> Iterator[tuple[Shard, bool, list[pa.RecordBatch]]]:
    """Each shard when it lies in its place, whether it is new, and what came with its records."""
    shard, held = None, []
    for batch in batches:
        numbers = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if shard is None or numbers[a] != shard.number:
                if shard:
                    yield shard, shard.close(), held
                shard, held = Shard(folder, numbers[a], not batch.column("record")[a].is_valid), []
            part = batch.slice(a, b - a)
            records = part.column("record").to_pylist()
            shard.add(records if words is None else opened(words, layout, records))
            at = part.schema.get_field_index("record")
            held.append(part.set_column(at, "record", pa.nulls(len(part), pa.binary())))  # read from the file later
    if shard:
        yield shard, shard.close(), held


def rows_of_shards(
    batches: Iterator[pa.RecordBatch], folder: str, layout: Layout, words: bytes | None = None
) -> Iterator[pa.RecordBatch]:
    """Rows of the written shards: place and record as the file has them, beside the columns that came with them."""
    for shard, _, held in shards_of(batches, folder, words, layout):
        crc = slot = 0
        with open(shard.path, "rb") as file:
            for part in held:
                data = file.read(len(part) * layout.stride)
                crc = zlib.crc32(data, crc)
                found = [data[i : i + layout.stride] for i in range(0, len(data), layout.stride)]
                first = shard.number * layout.shard + slot
                slot += len(found)
                if len(found) != len(part):
                    raise ValueError(f"{shard.path} is shorter than its records")
                if part.column("slot").to_pylist() != list(range(first, first + len(found))):
                    raise ValueError(f"{shard.path} does not hold its slots in order")
                own = dict(zip(part.schema.names, part.columns))
                own["record"] = pa.array(found, pa.binary())
                own["crc32"] = pa.array([zlib.crc32(r) for r in found], pa.int64())
                own["shard_crc32"] = pa.array([shard.crc] * len(found), pa.int64())
                own["path"] = pa.array([shard.path] * len(found), pa.string())
                yield pa.RecordBatch.from_pydict(own)
            if file.read(1) or crc != shard.crc:
                raise ValueError(f"{shard.path} differs from what was written")
        held = part = own = None
        give_back()


def sharded_records(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", layout: Layout = Layout(), to: str | None = None
) -> DataFrame:
    """Rows of ``training_records``, written as shards to the folder ``to`` and read from there, with checksums.

    Without ``to`` the shards go to a new folder below the one that executors share. The tasks that work out the rows
    write the shards, so these are there once all rows have been read. Given the folder of a run that broke off, texts
    are not encoded again, and of finished shards neither tokens are moved nor files written. A folder that
    holds shards of another input or layout is an error, so its shards are never mixed with others.
    """
    spark = docs.sparkSession
    place = to or folder(spark, "shards")
    path, sequences = local_path(place), f"{place}/sequences"
    wanted = {"layout": asdict(layout), "input": input_digest(docs, id_col, text_col) if to else None}
    known = read_manifest(path)
    if known is None:
        if os.path.exists(f"{path}/{shard_name(0)}"):
            raise ValueError(f"{place} holds shards without a manifest")
        write_sequences(docs, id_col, text_col, layout, sequences)
    elif {k: known[k] for k in wanted} != wanted:
        raise ValueError(f"{place} holds shards of another input or layout")
    rows, count = numbered(spark, sequences)
    if known is None:
        write_manifest(path, wanted | {"count": count})
    words = learned(rows, layout)
    records = in_slots(rows, count, id_col, layout, words, finished_shards(path, count, layout))
    return write_shards(records, place, layout, rows=True, words=words)


def input_digest(docs: DataFrame, id_col: str, text_col: str) -> list[str]:
    """Number of rows, and sums of two hashes of all of them: the same whatever their order."""
    one, two = F.xxhash64(id_col, text_col), F.xxhash64(text_col, id_col, F.lit(1))
    sums = docs.agg(F.count("*"), *(F.sum(h.cast("decimal(20)")) for h in (one, two))).first()
    return [str(x or 0) for x in sums]


MANIFEST = "manifest.json"


def read_manifest(folder: str) -> dict | None:
    path = f"{folder}/{MANIFEST}"
    if not os.path.exists(path):
        return None
    with open(path) as file:
        return json.load(file)


def write_manifest(folder: str, found: dict) -> None:
    os.makedirs(folder, exist_ok=True)
    temporary = f"{folder}/.{MANIFEST}.{os.urandom(4).hex()}"
    with open(temporary, "w") as file:
        json.dump(found, file)
    os.replace(temporary, f"{folder}/{MANIFEST}")


def finished_shards(folder: str, count: int, layout: Layout) -> bytes:
    """A bit for each shard: whether it lies there with its full length and a checksum. A shard is renamed when complete."""
    bits = np.zeros(-(-count // layout.shard), bool)
    names = {e.name: e.stat().st_size for e in os.scandir(folder) if e.name.startswith("shard-")}
    for name, size in names.items():
        if name.endswith(".bin") and f"{name}.crc32" in names and (n := int(name[6:-4])) < len(bits):
            bits[n] = size == layout.stride * min(layout.shard, count - n * layout.shard)
    return np.packbits(bits, bitorder="little").tobytes()


def same_file(path: str, size: int, crc: int) -> bool:
    if not os.path.exists(path) or os.path.getsize(path) != size:
        return False
    own = 0
    with open(path, "rb") as file:
        while part := file.read(1 << 20):
            own = zlib.crc32(part, own)
    return own == crc


def read_slots(folder: str, start: int, stop: int, layout: Layout = Layout()) -> Iterator[np.ndarray]:
    """Token ids of the slots from ``start`` up to ``stop``, sequentially, shard after shard, to the manifest's count."""
    slot, known = start, read_manifest(folder)
    stop = min(stop, known["count"]) if known else stop
    while slot < stop:
        path = f"{folder}/{shard_name(slot // layout.shard)}"
        if not os.path.exists(path):
            return
        with open(path, "rb") as file:
            file.seek(slot % layout.shard * layout.stride)
            while slot < stop and (record := file.read(layout.stride)):
                yield np.frombuffer(record, "<u2")
                slot += 1
                if slot % layout.shard == 0:
                    break
            else:
                return

