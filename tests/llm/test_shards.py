import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import shards


def test_block_sizes_are_near_equal():
    for n in (0, 1, 15, 16, 17, 1000, 100_003):
        sizes, per = shards.block_sizes(n, 16, 100)
        by_shard = sizes.reshape(16, per).sum(axis=1)
        assert sizes.sum() == n and by_shard.max() - by_shard.min() <= 1 and sizes.min() >= 0


def test_matrix_rows_fit_counts_and_sizes():
    counts, (sizes, _) = np.array([5, 0, 17, 3, 40, 1]), shards.block_sizes(66, 16, 3)
    rows = np.array([shards.matrix_row(counts, sizes, p, 9) for p in range(len(counts))])
    assert (rows.sum(axis=1) == counts).all() and (rows.sum(axis=0) == sizes).all() and rows.min() >= 0


def test_matrix_is_hypergeometric():
    """The share of partition 1's rows in the first block, over many seeds, against the exact law."""
    counts, sizes = np.array([4, 6, 5]), np.array([3, 5, 7])
    got = Counter(int(shards.matrix_row(counts, sizes, 1, s)[0]) for s in range(4000))
    from math import comb

    for k in range(4):
        want = comb(6, k) * comb(9, 3 - k) / comb(15, 3)
        assert abs(got[k] / 4000 - want) < 0.03


def test_large_population_sampler_agrees_with_numpy(monkeypatch):
    monkeypatch.setattr(shards, "_NUMPY_MOST", 0)
    rng = np.random.default_rng(1)
    for good, bad, drawn in ((300, 700, 100), (700, 300, 900), (50, 5000, 2000)):
        own = np.array([shards._hypergeometric(rng, good, bad, drawn) for _ in range(4000)])
        ref = rng.hypergeometric(good, bad, drawn, 4000)
        assert abs(own.mean() - ref.mean()) < 5 * ref.std() / 4000**0.5 + 0.05 and abs(own.std() / ref.std() - 1) < 0.08
        assert own.min() >= max(0, drawn - bad) and own.max() <= min(good, drawn)
    monkeypatch.undo()
    assert 0 <= shards._hypergeometric(rng, 6 * 10**9, 10**9, 5) <= 5


@pytest.mark.parametrize("n,parts,block_rows", [(0, 1, 10), (7, 3, 10), (1000, 7, 20)])
def test_report_keeps_the_law(spark, monkeypatch, n, parts, block_rows):
    texts = [None, "", "é", "a" * 500]
    df = spark.range(n).select(
        F.when(F.col("id") % 11 != 0, F.col("id") % 90).alias("doc_id"),
        F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 4 + 1).cast("int")).alias("text"),
        F.lit(1).alias("slot"),
    )
    df = df.repartition(parts, "doc_id")
    got = shards.uniform_shards(df, block_rows=block_rows).collect()
    by_shard = Counter(r.shard for r in got)
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(by_shard[s]))
    assert max(by_shard.values(), default=0) - min((by_shard[s] for s in range(16)), default=0) <= 1
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    again = shards.uniform_shards(df, block_rows=block_rows).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_order_is_spread(spark):
    got = shards.uniform_shards(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).coalesce(4), block_rows=50)
    ids = [r.doc_id for r in got.orderBy("shard", "slot").collect()]
    assert abs(np.corrcoef(ids, range(4000))[0, 1]) < 0.06 and ids != sorted(ids)


def test_columns(spark):
    got = shards.report(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert got.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]


def test_shards_hold_the_rows(spark):
    rows = [(i % 40 or None, [None, "", "é x", "y" * 3000][i % 4], f"s{i}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, slot long").repartition(3)
    got = shards.sharded(df, block_rows=8, block_bytes=4000).collect()
    assert sorted(map(str, (tuple(r.row) for r in got))) == sorted(map(str, rows))
    by_shard = Counter(r.shard for r in got)
    assert set(by_shard.values()) == {18, 19} and all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in by_shard.items())
    digest = {(r.shard, r.slot): (r.doc_id, r.size, r.text_crc32) for r in shards.uniform_shards(df, block_rows=8).collect()}
    held = {(r.shard, r.slot): (r.row.doc_id, len((r.row.text or "").encode()) + 1, zlib.crc32((r.row.text or "").encode())) for r in shards.sharded(df, block_rows=8).collect()}
    assert digest == held
