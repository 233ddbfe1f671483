"""Reading the given tables and writing intermediate tables to the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths to delete, by open `scratch` block of this thread of work.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open_scratch", default=())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where none is set, a fresh local one if Spark runs on this
    machine alone (tests); on a cluster that is an error, as executors could not see each other's files."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _write(df: DataFrame, name: str, by: Sequence[str], options: dict[str, str], level: int) -> DataFrame:
    spark, blocks = df.sparkSession, _OPEN.get()
    path = f"{shared_dir(spark)}/lexiforge/{name}-{uuid.uuid4().hex}"
    if len(blocks) >= level:
        blocks[-level].append(path)
    df.write.options(**{"compression": "zstd", **options}).partitionBy(*by).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    return made.select(*[f"`{c}`" for c in df.columns]) if by else made  # columns of folders come last


def stored(df: DataFrame, name: str, by: Sequence[str] = (), **options: str) -> DataFrame:
    """Write df as Parquet under the shared folder, in a folder for each value of the columns `by`, and read it back:
    lineage ends there and lost executors cost no recomputation of what came before."""
    return _write(df, name, by, options, 1)


def kept(df: DataFrame, name: str, by: Sequence[str] = (), **options: str) -> DataFrame:
    """As `stored`, for the result of a `scratch` block, which outlives the block."""
    return _write(df, name, by, options, 2)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside the block are deleted at its end, but for those `kept`. What is stored outside any block is a
    result that some DataFrame still reads; it stays, for the owner of the shared folder to clear."""
    paths: list[str] = []
    mark = _OPEN.set((*_OPEN.get(), paths))
    try:
        yield
    finally:
        _OPEN.reset(mark)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
