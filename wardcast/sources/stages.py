"""Tables between jobs: written once, listed, found again by a run that goes on, and removed at the end."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from wardcast.sources import files


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    Only a local session, where driver and executors are one machine, may fall
    back on a folder in its warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.startswith("local"):
        return f"{spark.conf.get('spark.sql.warehouse.dir')}/wardcast-stage"
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


class Stage:
    """The tables between the jobs of one run: cut lineage, survive the loss of executors.

    Each table is a folder below the run's, with an entry in the run's catalogue: its owner (the application that
    wrote it), its input, its columns and how it is clustered. An entry appears when the table is whole. A run with a
    name goes on where one of that name ended: a table whose entry has the same input and columns is read, not written
    again; other remains are replaced. Without a name a run is its own.

    Used as a context, the tables go with it. If a run with a name fails, they stay for the next try.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, run: str | None = None, inputs: str = ""):
        if run is not None and not re.fullmatch(r"\w+", run):
            raise ValueError(f"a run's name has letters, digits and underscores only, not {run!r}")
        self.spark, self.named, self.inputs = spark, run is not None, inputs
        self.run = run or uuid.uuid4().hex
        self.root = f"{root or shared_folder(spark)}/stage-{self.run}"
        self.written: list[str] = []

    def __enter__(self) -> Stage:
        return self

    def __exit__(self, failure, *_) -> None:
        if not (failure and self.named):
            self.close()

    def _entry_path(self, name: str) -> str:
        return f"{self.root}/_entries/{name}.json"

    def _table(self, name: str) -> str:
        return f"wardcast_{self.run}_{name}"

    def entry(self, name: str) -> dict | None:
        return files.read_json(self.spark, self._entry_path(name))

    def entries(self) -> dict[str, dict]:
        """The catalogue: whole tables of this run by name."""
        found = [n.removesuffix(".json") for n in files.names(self.spark, f"{self.root}/_entries") if n.endswith(".json")]
        return {n: self.entry(n) for n in found}

    def save(
        self, table: DataFrame | Callable[[], DataFrame], name: str, by: str | None = None, cluster: str | None = None
    ) -> DataFrame:
        """Write a table and read it back, or only read what an earlier try of this run has finished.

        Given as a function, the table is not even planned if it is there. ``by`` is a column of folders, which later filters prune. ``cluster`` is a column whose rows are kept together in
        buckets, as many as the session's shuffles have parts: later groupings by it need no shuffle.
        """
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions")) if cluster else None
        wanted = {"input": self.inputs, "by": by, "cluster": cluster}
        if isinstance(table, DataFrame):
            wanted["schema"] = table.schema.jsonValue()
        old = self.entry(name) if self.named else None
        path = f"{self.root}/{name}"
        if old and all(old[k] == v for k, v in wanted.items()):
            return self._open(T.StructType.fromJson(old["schema"]), name, cluster, old["buckets"])
        self.remove(name)
        df = table if isinstance(table, DataFrame) else table()
        wanted["schema"] = df.schema.jsonValue()
        writer = df.write.mode("errorifexists")
        if by:
            writer = writer.partitionBy(by)
        if cluster:
            writer.bucketBy(buckets, cluster).option("path", path).format("parquet").saveAsTable(self._table(name))
        else:
            writer.parquet(path)
        owner = self.spark.sparkContext.applicationId
        files.write_json(self.spark, self._entry_path(name), wanted | {"owner": owner, "buckets": buckets})
        self.written.append(name)
        return self._open(df.schema, name, cluster, buckets)

    def scratch(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` for the rest of the run under a name of its own, and read it back."""
        return self.save(df, f"{name}_{uuid.uuid4().hex}")

    def _open(self, schema: T.StructType, name: str, cluster: str | None, buckets: int | None) -> DataFrame:
        path = f"{self.root}/{name}"
        if not cluster:
            return self.spark.read.schema(schema).parquet(path).select(*schema.names)
        table = self._table(name)
        if not self.spark.catalog.tableExists(table):  # written by an earlier application
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            self.spark.sql(
                f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{cluster}`) INTO {buckets} BUCKETS LOCATION '{path}'"
            )
        return self.spark.table(table).select(*schema.names)

    def remove(self, *tables: str) -> None:
        """Remove tables that no later job reads: entry, files, and their place in the session's catalog."""
        for name in tables:
            files.remove(self.spark, self._entry_path(name))
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")
            files.remove(self.spark, f"{self.root}/{name}")

    def close(self) -> None:
        """Remove all tables of the run and its folder."""
        known = {*self.written, *self.entries()}
        self.remove(*known)
        files.remove(self.spark, self.root)
