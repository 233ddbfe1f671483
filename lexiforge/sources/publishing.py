"""Versioned publishing: a stage is checked where it lies and readers are moved to it by one atomic rename."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


def _files(spark: SparkSession, root: str):
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{root}/{name}" if name else root)
    return jvm, path, path("").getFileSystem(conf), conf


def _replace(spark: SparkSession, root: str, name: str) -> None:
    """Writes the pointer beside and renames it over the old one, in one step of the file system."""
    jvm, path, fs, conf = _files(spark, root)
    fresh = f".{POINTER}-{uuid.uuid4().hex}"
    out = fs.create(path(fresh), True)
    out.write(bytearray(name.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(path(fresh), path(POINTER), how)


def current(spark: SparkSession, root: str) -> str | None:
    """The folder readers are sent to, or None before anything was published."""
    jvm, path, fs, _ = _files(spark, root)
    if not fs.exists(path(POINTER)):
        return None
    stream = fs.open(path(POINTER))
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_published(spark: SparkSession, root: str) -> DataFrame:
    name = current(spark, root)
    if name is None:
        raise FileNotFoundError(f"nothing published under {root}")
    return spark.read.parquet(f"{root}/{name}")


def publish(rows: DataFrame, root: str, errors: Callable[[DataFrame], DataFrame]) -> bool:
    """Writes rows to a folder of their own, reads them back, and publishes them if `errors` of them is empty. A stage with
    errors is kept as failed-<id>, one whose writer died as staging-<id>; readers then go on with the last good version."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    rows.write.option("compression", "zstd").parquet(f"{root}/staging-{name}")
    good = errors(spark.read.parquet(f"{root}/staging-{name}")).isEmpty()
    _, path, fs, _ = _files(spark, root)
    kept = f"{'version' if good else 'failed'}-{name}"
    if not fs.rename(path(f"staging-{name}"), path(kept)):
        raise OSError(f"could not rename staging-{name} under {root}")
    if good:
        _replace(spark, root, kept)
    return good
