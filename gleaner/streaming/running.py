"""Running a stream over what is there, and reading what it wrote."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from gleaner.lineage import new_folder
from gleaner.streaming.stall import ROCKS

_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def _store(spark: SparkSession) -> Iterator[None]:
    """The state store that timers need, for queries that start inside."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All that the stream gives for what its sources hold now, written to a table in the shared folder and read back.

    The files are listed by the sink's own log, so a batch that is tried again counts once.
    """
    spark = stream.sparkSession
    path = new_folder(spark, name)
    with _store(spark):
        run = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def file_stream(spark: SparkSession, path: str, schema: str, files: int = 1000) -> DataFrame:
    """A stream of a Parquet table's files (a folder or one file), so many a batch at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, it may be a file's name
