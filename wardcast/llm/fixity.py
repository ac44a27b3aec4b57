"""WARC records, and a Merkle audit of two replicas of them.

Records are hashed; the hashes of an ordered range of offsets are hashed into a node, nodes into wider
ranges, up to one root for each archive. Two replicas are compared by their roots; only the children of
nodes that differ are looked at, down to the records. A replica's tree is built once in one pass
over its content; the audit itself moves digests, and only those below differing nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardcast.llm.shared import stage

#: Bytes of the ranges of the lowest level, and how many nodes make one of the next.
RANGE, FANOUT = 1 << 16, 16


def warc_record(url: Column, body: Column, record_id: Column) -> Column:
    """A response record as bytes: version, named fields, a blank line, the body, two line ends."""
    length = F.octet_length(body)
    fields = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:sha256:"), record_id,
        F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        length.cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(fields.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def archive_of(id_: Column, content: Column, records: int) -> Column:
    """The archive of a record: ``records`` ids in a row; records without an id are dealt by their content."""
    return F.coalesce(F.floor(id_ / records), -1 - F.pmod(F.xxhash64(content), F.lit(records))).cast("long")


def warc_records(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", records: int = 1_000
) -> DataFrame:
    """(archive, offset, length, _id, sha256) of the WARC record of every row of ``pages``.

    Archives hold consecutive ids, in order of the id, then of the content; equal rows follow each other.
    Null URLs and bodies count as empty. Content is read once and hashed in its place; the running
    offsets move lengths and hashes only.
    """
    url, body = F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    record = warc_record(url, body, F.sha2(F.concat(url.cast("binary"), F.lit(b"\x00"), body), 256))
    rows = pages.select(
        archive_of(F.col(id_col), F.concat(url.cast("binary"), body), records).alias("archive"),
        F.col(id_col).alias("_id"),
        F.octet_length(record).cast("long").alias("length"),
        F.sha2(record, 256).alias("sha256"),
    )
    before = Window.partitionBy("archive").orderBy(F.col("_id").asc_nulls_first(), "sha256").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def hash_of(children: Column) -> Column:
    """Hash of the ordered children, (position, hash) in an array."""
    text = F.array_join(F.transform(F.array_sort(children), lambda c: F.concat_ws(":", c["at"], c["hash"])), ",")
    return F.sha2(text, 256)


def build_tree(records: DataFrame, width: int = RANGE, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of the tree from the records up: (archive, at, hash), the last with one node per archive.

    Level 0 has the records at their offsets; level k the nodes of offsets ``at * width * fanout ** (k - 1)`` on. Two
    records at one offset (in a damaged replica) are children like others. A group holds the
    records of one range or ``fanout`` nodes, so none grows with the data.
    """
    levels = [stage(records.select("archive", F.col("offset").alias("at"), F.col("sha256").alias("hash")), "records")]
    by = width
    top = levels[0].agg(F.max("at")).first()[0]
    while True:
        rows = levels[-1].withColumn("_up", F.floor(F.col("at") / by))
        up = rows.groupBy("archive", "_up").agg(hash_of(F.collect_list(F.struct("at", "hash"))).alias("hash"))
        levels.append(stage(up.select("archive", F.col("_up").alias("at"), "hash"), "level"))
        top = (top or 0) // by
        if not top:
            return levels
        by = fanout


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """(archive, at) of the nodes that one side lacks or that differ."""
    key = ["archive", "at"]
    both = left.select(*key, F.col("hash").alias("_l")).join(right.select(*key, F.col("hash").alias("_r")), key, "full")
    return both.filter(~F.col("_l").eqNullSafe(F.col("_r"))).select(*key)


def below(level: DataFrame, nodes: DataFrame, by: int) -> DataFrame:
    """Nodes of a level whose parent is among ``nodes``."""
    parents = nodes.select(F.col("archive").alias("_archive"), F.col("at").alias("_parent"))
    own = (F.col("archive") == F.col("_archive")) & (F.floor(F.col("at") / by) == F.col("_parent"))
    return level.join(parents, own, "left_semi")


def audit(left: DataFrame, right: DataFrame, width: int = RANGE, fanout: int = FANOUT) -> DataFrame:
    """Records that differ between two replicas: archive, offset, kind (changed, missing, added), both hashes.

    ``left`` is the master, ``right`` the replica, both as ``warc_records`` gives them (archive, offset, sha256).
    Missing records are in the master only, added ones in the replica only. Of several records at one offset
    equal ones are paired off. Equal replicas, and empty ones, give an empty result.
    """
    a, b = levels_alike(build_tree(left, width, fanout), build_tree(right, width, fanout))
    nodes = stage(differing(a[-1], b[-1]), "differing")
    for k in range(len(a) - 2, 0, -1):
        nodes = stage(differing(below(a[k], nodes, fanout), below(b[k], nodes, fanout)), "differing")
    return located(below(a[0], nodes, width), below(b[0], nodes, width))


def levels_alike(a: list[DataFrame], b: list[DataFrame]) -> tuple[list[DataFrame], list[DataFrame]]:
    """Both trees down from the height of the lower one: the other's nodes above have no counterpart."""
    height = min(len(a), len(b))
    return a[:height], b[:height]


def located(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records below differing ranges that the other side lacks."""
    once = Window.partitionBy("archive", "at", "hash").orderBy(F.lit(0))
    key = ["archive", "at", "hash", "_copy"]
    l, r = (side.withColumn("_copy", F.row_number().over(once)) for side in (left, right))
    place = Window.partitionBy("archive", "at").orderBy("hash", "_copy")
    gone = l.join(r, key, "left_anti").withColumn("_n", F.row_number().over(place))
    new = r.join(l, key, "left_anti").withColumn("_n", F.row_number().over(place))
    both = gone.select("archive", "at", "_n", F.col("hash").alias("master_sha256")).join(
        new.select("archive", "at", "_n", F.col("hash").alias("replica_sha256")), ["archive", "at", "_n"], "full"
    )
    kind = F.when(F.col("replica_sha256").isNull(), "missing").when(F.col("master_sha256").isNull(), "added")
    return both.select(
        "archive", F.col("at").alias("offset"), kind.otherwise("changed").alias("kind"), "master_sha256", "replica_sha256"
    )
