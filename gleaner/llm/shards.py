"""Shards by a uniform shuffle with exact sizes, through a hypergeometric communication matrix.

Law ``rows``: shard sizes differ by one at most, and every assignment of rows to slots is equally
likely. Each shard is cut into blocks of exact size, and the matrix says how many rows each input
partition sends to each block. Its rows are drawn without a driver-side matrix: the vector of all block
sizes is split over halves of the partitions, down to one partition, each split a multivariate
hypergeometric draw seeded by its place in that tree. So a task draws its own row of the matrix in
log2(partitions) steps from the partitions' counts, the tasks agree without talking, and a
recomputed task draws the same row. Then a partition permutes its rows and deals them out by its
row of the matrix; after the exchange each block, which holds as many rows as it has slots, permutes
again.

The rows themselves, all columns, go through the exchange (``sharded``); the query's digest is taken from them
afterwards. The input is checkpointed first, so that a recomputed partition has the same rows in the same
order. A block's rows are put in an order of their own (partition, place) before they are permuted, so the
result depends on the seed alone; they are sorted and read in batches, so no task holds a block's texts at once.

Defined cases: a null text has no bytes and checksum 0; an empty text has none either; very long texts move whole; rows with equal or
null doc_id, and equal rows, are rows like any other; fewer rows than shards leave some shards without rows; an empty table gives no rows; further
columns stay with their rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from gleaner.llm.common import checkpointed

SHARDS = 16
SEED = 20_240_229
#: Slots of a block and bytes of its texts, about, and the most blocks of a shard: beyond, blocks grow.
BLOCK_ROWS = 4096
BLOCK_BYTES = 16_000_000
MAX_BLOCKS = 4096
#: numpy's own sampler takes populations up to this.
_NUMPY_MOST = 10**9 - 1


def block_sizes(n: int, shards: int, block_rows: int = BLOCK_ROWS) -> tuple[np.ndarray, int]:
    """The sizes of all blocks, shard by shard, and the number of blocks of a shard."""
    per = min(MAX_BLOCKS, max(1, math.ceil(n / shards / block_rows)))
    sizes = np.array([n // shards + (s < n % shards) for s in range(shards)], dtype=np.int64)
    return (sizes[:, None] // per + (np.arange(per) < sizes[:, None] % per)).ravel(), per


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """The number of good ones among so many drawn without replacement; exact at any size."""
    if good + bad <= _NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, drawn))
    # Beyond numpy's sampler: rejection from a table mountain around the mode (Hoermann's HRUA, as published).
    n = good + bad
    few, many = min(good, bad), max(good, bad)
    m = min(drawn, n - drawn)
    p, q = few / n, many / n
    mean = m * p
    spread = math.sqrt((n - m) * mean * q / (n - 1) + 0.5)
    d1, d2 = 2 * math.sqrt(2 / math.e), 3 - 2 * math.sqrt(3 / math.e)
    width = d1 * spread + d2
    mode = (m + 1) * (few + 1) // (n + 2)

    def weight(k: int) -> float:
        return math.lgamma(k + 1) + math.lgamma(few - k + 1) + math.lgamma(m - k + 1) + math.lgamma(many - m + k + 1)

    top, high = weight(mode), min(min(m, few) + 1, math.floor(mean + 0.5 + 16 * spread))
    while True:
        u, v = rng.random(), rng.random()
        w = mean + 0.5 + width * (v - 0.5) / u
        if w < 0 or w >= high or (k := math.floor(w)) < m - many:
            continue
        t = top - weight(k)
        if u * (4 - u) - 3 <= t or (u * (u - t) < 1 and 2 * math.log(u) <= t):
            break
    if good > bad:
        k = m - k
    return good - k if m < drawn else k


def _split(rng: np.random.Generator, sizes: np.ndarray, drawn: int) -> np.ndarray:
    """How many of each block's slots go to the first ``drawn`` rows."""
    total = int(sizes.sum())
    if total <= _NUMPY_MOST:
        return rng.multivariate_hypergeometric(sizes, drawn, method="marginals")
    out = np.zeros_like(sizes)
    for i, size in enumerate(sizes.tolist()):
        total -= size
        out[i] = _hypergeometric(rng, size, total, drawn)
        drawn -= int(out[i])
    return out


def matrix_row(counts: np.ndarray, sizes: np.ndarray, partition: int, seed: int) -> np.ndarray:
    """How many of a partition's rows go to each block, from all partitions' counts."""
    lo, hi, row = 0, len(counts), sizes
    upto = np.r_[0, np.cumsum(counts)]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _split(np.random.default_rng([seed, lo, hi]), row, int(upto[mid] - upto[lo]))
        if partition < mid:
            hi, row = mid, left
        else:
            lo, row = mid, row - left
    return row


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns as struct ``row``, with their shard and slot."""
    rows = checkpointed(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row")))
    size = F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long")
    found = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("count"), F.sum(size).alias("bytes")).collect()  # a row per partition
    counts = np.zeros(max((r.p for r in found), default=0) + 1, dtype=np.int64)
    for r in found:
        counts[r.p] = r["count"]
    mean = sum(r["bytes"] for r in found) / max(1, int(counts.sum()))
    sizes, per = block_sizes(int(counts.sum()), shards, max(1, min(block_rows, int(block_bytes / max(1.0, mean)))))
    before = np.cumsum(sizes) - sizes
    first_slot = before - np.repeat(before[::per], per)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = None
        done = 0
        for b in batches:
            if not len(b):
                continue
            if blocks is None:
                p = b.column(0)[0].as_py()
                blocks = np.repeat(np.arange(len(sizes), dtype=np.int32), matrix_row(counts, sizes, p, seed))
                # Which block each row in turn is dealt: the same as dealing out permuted rows by the matrix.
                np.random.default_rng([seed, p, 1 << 40]).shuffle(blocks)
            own = [pa.array(np.arange(done, done + len(b))), pa.array(blocks[done : done + len(b)])]
            done += len(b)
            yield pa.RecordBatch.from_arrays([*b.columns, *own], names=[*b.schema.names, "place", "block"])

    dealt = rows.select(F.spark_partition_id().alias("p"), "row").mapInArrow(
        deal, StructType([StructField("p", IntegerType()), rows.schema["row"], StructField("place", LongType()), StructField("block", IntegerType())])
    )

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, slots, done = -1, None, 0
        for b in batches:  # sorted by block, partition and place, so a block's rows come in an order of their own
            of = b.column("block").to_numpy()
            slot = np.empty(len(b), dtype=np.int64)
            for lo, hi in pairwise([0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]):
                if hi > lo and of[lo] != block:
                    block, done = int(of[lo]), 0
                    slots = np.random.default_rng([seed, block, 1 << 41]).permutation(int(sizes[block])) + first_slot[block]
                slot[lo:hi] = slots[done : done + hi - lo]
                done += hi - lo
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array((of // per).astype(np.int32)), pa.array(slot)], names=["row", "shard", "slot"])

    placed = dealt.repartition("block").sortWithinPartitions("block", "p", "place")
    return placed.mapInArrow(settle, StructType([rows.schema["row"], StructField("shard", IntegerType()), StructField("slot", LongType())]))


def uniform_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of each row of docs (doc_id, text), from the sharded rows."""
    text = F.coalesce("row.text", F.lit(""))
    return sharded(docs, shards, seed, block_rows).select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        "shard",
        "slot",
    )


def report(docs: DataFrame) -> DataFrame:
    return uniform_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
