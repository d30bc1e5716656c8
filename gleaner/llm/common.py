"""What the operators share: tables, the shared folder and lineage cuts."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master one of our own."""
    sc = spark.sparkContext
    if set_to := sc.getConf().get("spark.checkpoint.dir"):
        return set_to.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gleaner-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its rows and partitions fixed in the shared folder, for a recomputed task to find the same ones."""
    sc = df.sparkSession.sparkContext
    folder = shared_dir(df.sparkSession)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return df.checkpoint()


#: Folders of tables that were landed and not dropped yet.
_folders: set[str] = set()


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, whose table is removed when the session's process ends, if ``remove`` hasn't done so."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _folders:
        atexit.register(_remove_all)
    _folders.add(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _folders.discard(path)


def _remove_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and not spark.sparkContext._jsc.sc().isStopped():
        for path in [*_folders]:
            remove(spark, path)


def landed(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._landed = path
    return out


def repeatable(df: DataFrame) -> DataFrame:
    """df, kept in the shared folder if a shuffle makes it: then a recomputed task may find its rows in another order, in which a scan's always come."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return checkpointed(df) if "Exchange" in plan else df


def dropped(df: DataFrame) -> None:
    """Removes a landed table that nothing reads any more."""
    remove(df.sparkSession, df._landed)


def pieces_of(batches: Iterator[pa.RecordBatch], text: int | str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of about ``most`` bytes of text (or one row), to bound a worker's memory."""
    for b in batches:
        if not len(b):
            continue
        upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 100)
        at = 0
        while at < len(b):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
            yield b.slice(at, end - at)
            at = end


def trimmed() -> None:
    """Hands the memory of freed arrays back to the system: the C library keeps small ones', and the driver's process lives on."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass
