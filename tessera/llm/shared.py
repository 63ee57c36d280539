"""Shared folders, materialised intermediate tables and Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set: the warehouse, which a cluster shares too.  Never a machine's
    own temporary folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tessera-scratch"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that later steps survive the loss of any executor."""
    shared_folder(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


class Scratch:
    """Parquet tables in the shared folder, deleted by :meth:`drop` or when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        schema = df.schema
        del df
        self.tidy()
        return self.spark.read.schema(schema).parquet(self.path(name))

    def tidy(self) -> None:
        """Let go of the shuffle files of finished steps: the context cleaner deletes what is no longer referenced."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        try:
            self.drop()
        except Exception:  # the driver's JVM may be gone by then
            pass


def spread(df: DataFrame, each: int = 16 << 20) -> DataFrame:
    """``df`` dealt over all cores, if it is read from fewer files than there are cores and is estimated at ``each`` bytes a core at most.

    A file may be one row group, which one task reads; larger tables are left as they
    are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    if not 0 < files < cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= each * cores else df


def small(df: DataFrame, row_bytes: int, limit: int = 16 << 20) -> DataFrame:
    """``df`` marked for broadcast if its rows, counted, take at most ``limit`` bytes; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def free(name: str, *frames: DataFrame) -> str:
    """``name``, or the first of it with underscores behind that no column of ``frames`` has, whatever its case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole(text: str | Column = "text") -> Column:
    """A text with null taken as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def release() -> None:
    """Give freed memory back to the machine: Python workers are used again, and wait with all that their last task took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only where the C library can
        pass


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives none."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of at most ``most`` in sum, of one item at least."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def partitions_for(rows: int, each: int) -> int:
    return max(1, -(-rows // each))
