"""Where leads go: CSV, JSON, ledgers and completed keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.lineage import settled
from gleaner.operators.accept import ledger_entries
from gleaner.operators.leads import csv_rows


def write_csv(leads: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The nine CSV columns with a header in each file; append goes on with an earlier run's folder."""
    csv_rows(leads).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(leads: DataFrame, path: str, mode: str = "overwrite") -> None:
    """All fields, a JSON object per line; ``write_json_array`` makes one array."""
    leads.write.mode(mode).json(path)


def write_json_array(leads: DataFrame, path: str, *order: str) -> None:
    """All rows as one JSON array in the file ``path``, which appears whole or not at all; in this order, or as the partitions have them.

    Tasks write their rows as parts, commas in front; the committer joins the parts' bytes, in order, between the brackets. No row passes through the driver's Python.
    """
    spark = leads.sparkSession
    rows = leads.orderBy(*order) if order else leads
    rows = settled(rows.select(F.to_json(F.struct(*leads.columns), {"ignoreNullFields": "false"}).alias("value")))  # so that partitions keep their rows
    filled = [r.part for r in rows.select(F.spark_partition_id().alias("part")).distinct().collect()]  # a number per partition
    first = min(filled, default=0)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, any_before = TaskContext.get().partitionId(), False
        for b in batches:
            texts = b.column(0).to_pylist()
            lines = [t if own == first and not any_before and i == 0 else "," + t for i, t in enumerate(texts)]
            any_before = any_before or bool(texts)
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = where(path).getFileSystem(conf)
    aside = f"{path}.{uuid.uuid4().hex}"
    try:
        rows.mapInArrow(parts, "value string").write.text(aside)
        files = {int(str(f.getPath().getName()).split("-")[1]): f.getPath() for f in fs.listStatus(where(aside)) if str(f.getPath().getName()).startswith("part-")}
        out = fs.create(where(f"{aside}/array"), True)
        try:
            out.write(bytearray(b"["))
            for _, file in sorted(files.items()):
                part = fs.open(file)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
                finally:
                    part.close()
            out.write(bytearray(b"]"))
        finally:
            out.close()
        fs.delete(where(path), False)
        if not fs.rename(where(f"{aside}/array"), where(path)):
            raise OSError(f"can't move the array to {path}")
    finally:
        fs.delete(where(aside), True)


def append_ledger(accepted: DataFrame, path: str) -> None:
    """Adds accepted leads' addresses and @domains, those that the ledger doesn't hold yet."""
    fresh = ledger_entries(accepted)
    if (old := read_ledger(accepted.sparkSession, path)) is not None:
        fresh = fresh.join(old, "entry", "left_anti")
    fresh.write.mode("append").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return None
    return spark.read.schema("entry string").parquet(path)


def append_completed(keys: DataFrame, path: str) -> None:
    """Keys of finished sites, plans or queries: the next run leaves them out with without_completed."""
    keys.distinct().write.mode("append").parquet(path)


def status_row(verdicts: DataFrame) -> DataFrame:
    """The counters of a run with when they were taken."""
    from gleaner.operators.stats import lead_stats

    return lead_stats(verdicts).withColumn("updated_at", F.current_timestamp())
