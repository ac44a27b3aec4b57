"""Small files and folders on whatever file system the session's paths name."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _system(spark, path).exists(_path(spark, path))


def names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder, by name; nothing if it does not exist."""
    if not exists(spark, folder):
        return []
    return sorted(f.getPath().getName() for f in _system(spark, folder).listStatus(_path(spark, folder)))


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a file or a folder with all it holds."""
    return _system(spark, path).delete(_path(spark, path), True)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """A small JSON file, or nothing if there is none."""
    if not exists(spark, path):
        return None
    stream = _system(spark, path).open(_path(spark, path))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Replace a small JSON file in one step: readers see the old one or the new one."""
    jvm = spark._jvm
    fresh = f"{path}.{uuid.uuid4().hex}"
    stream = _system(spark, fresh).create(_path(spark, fresh), True)
    stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(_path(spark, fresh), _path(spark, path), options)
