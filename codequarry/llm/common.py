"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset in local mode, as in a test, a temporary folder takes its
    place; on a cluster that would scatter the tables over machines, so it's an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="codequarry-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and return a reader of it.

    This cuts lineage: a lost executor costs its running tasks, never the work
    before this point, and what follows may read the rows more than once.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


TEXTS_A_BATCH, BYTES_A_BATCH = 1_000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows that go to Python hold whole texts: no more than TEXTS_A_BATCH at a time,
    nor more than about BYTES_A_BATCH bytes, if not one text alone is longer.

    The session's own bounds stay where they are lower.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXTS_A_BATCH:
        spark.conf.set(name, TEXTS_A_BATCH)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(spark.conf.get(name)) <= BYTES_A_BATCH:
        spark.conf.set(name, BYTES_A_BATCH)


def _bytes(size: str) -> int:
    """A size such as 64MB or 8388608 as a number of bytes; -1 if it isn't one."""
    units = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    number = size.strip().rstrip("bkmgBKMG")
    unit = units.get(size.strip()[len(number) :].lower())
    return int(number) * unit if unit and number.isdigit() else -1


def gives_back(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """task, for mapInArrow and its like, returning its free memory at its end.

    Spark keeps Python workers for later tasks; without this they hold all they ever
    took, beside the memory of whichever stage runs then.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        yield from task(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return run


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions of this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """Documents never used for learning: crc32 of the id's text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def bounded_sample(df: DataFrame, key: Column, bound: int) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of ``key``; all rows if fewer."""
    n = df.count()
    if n <= bound:
        return df
    parts = 1 << 30
    return df.where(F.pmod(F.xxhash64(key), F.lit(parts)) < int(parts * bound / n))
