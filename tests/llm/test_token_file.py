import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm import token_file

ODD = [None, "", " ", "a", " lead", "trail ", "two  spaces", "tab\tand\nline", "line \nfeed", "it's we'll 'S", "x y z", "　 wide", "<|endoftext|> a b",
       "\x00 a \x00", "emoji 🦄 ok", "12 345,6 (a)", "É à la", "a\r\nb c", "é x ́"]


def library(texts):
    own = Tokenizer.from_file(token_file.tokenizer_path())
    return [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


def test_cuts_join_to_the_library_ids():
    rng = random.Random(2)
    alphabet = ["a", "b", "é", "1", ".", "'", "s", " ", " ", " ", "\n", "\t", " ", " ", "!", "漢", "́", "\x1c", "\x85"]
    texts = [t or "" for t in ODD] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 25))) for _ in range(3000)]
    for remembered in (0, 50, 10_000):
        own = token_file.Encoder(token_file.tokenizer_path(), 2, remembered)
        for at in (range(0, len(texts), 700), range(0, len(texts), 100)):
            for i in at:
                part = texts[i : i + at.step]
                flat, upto = own.encode(pa.array(part, pa.string()))
                assert [flat[a:z].tolist() for a, z in zip(upto, upto[1:], strict=False)] == [[*ids, 2] for ids in library(part)]


def test_table_finds_what_it_holds():
    rng = np.random.default_rng(3)
    own = token_file.Encoder(token_file.tokenizer_path(), 2, 0)
    for n in (1, 300, 5000):
        names = [f"{i:x}" * int(k) for i, k in zip(rng.integers(0, 1 << 40, n), rng.integers(1, 4, n), strict=True)]
        names = [x for x in dict.fromkeys(names) if own._find(pa.array([x]))[0] < 0]
        before = len(own.size)
        own._add(names, np.arange(len(names), dtype="<u4"), np.ones(len(names), np.int32))
        assert own._find(pa.array(names)).tolist() == list(range(before, before + len(names)))
        assert (own._find(pa.array([x + "!" for x in names])) < 0).all()


def test_report_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(token_file, "PART_ROWS", 6)
    rows = [(i * 7 % 19, t, i) for i, t in enumerate(ODD)] + [(None, "no id", 0), (3, "again", 1), (3, "again", 2), (50, "long " * 30_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part long")
    path = f"{spark.conf.get('spark.checkpoint.dir')}/tokens-test"
    token_file.write_tokens(df, path, part_rows=6)
    got = token_file.read_tokens(spark, path)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = [], 0
    for (doc_id, _, _), ids in zip(ordered, library([t or "" for _, t, _ in ordered]), strict=True):
        ids = [*ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    full = sorted(got.collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in full] == want
    digest = sorted(map(tuple, token_file.report(df).collect()), key=lambda r: r[1])
    assert digest == want
    one = got.filter(F.col("doc_id") == 50)
    assert "EqualTo(doc_id,50)" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 1
    assert token_file.report(df.limit(0)).count() == 0


def scanned(df):
    """Rows that come out of the file scan."""
    df._jdf.queryExecution().executedPlan().executeCollect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_files_hold_stripes_indexes_and_filters(spark, tmp_path):
    import pyarrow.orc as orc

    rng = random.Random(1)
    rows = [(2 * i, " ".join(f"{rng.randrange(10**6)}" for _ in range(60))) for i in range(12_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    token_file.write_tokens(df, f"{tmp_path}/t", part_rows=6000, stripe_bytes=1 << 18)
    files = sorted(tmp_path.glob("t/*.orc"))
    assert len(files) == 2
    f = orc.ORCFile(str(files[0]))
    assert f.nstripes > 2 and f.row_index_stride == token_file.INDEX_ROWS and f.compression == "SNAPPY"
    parts = [f.read_stripe(i, columns=["doc_id"])["doc_id"].to_pylist() for i in range(f.nstripes)]  # each alone
    assert sum(parts, []) == f.read(columns=["doc_id"])["doc_id"].to_pylist()
    # The Bloom filters are there, one for each group of rows, and know the ids that they don't hold.
    orc_ = spark._jvm.org.apache.orc
    where = spark._jvm.org.apache.hadoop.fs.Path(str(files[0]))
    reader = orc_.OrcFile.createReader(where, orc_.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    assert [str(s) for s in reader.getSchema().getFieldNames()][1] == "doc_id"
    n = reader.getSchema().getMaximumId() + 1
    every = spark.sparkContext._gateway.new_array(spark._jvm.boolean, n)
    for i in range(n):
        every[i] = True
    index = reader.rows().readRowIndex(0, every, every)
    filters = index.getBloomFilterIndex()[2]
    assert filters.getBloomFilterCount() == -(-len(parts[0]) // token_file.INDEX_ROWS) and index.getBloomFilterIndex()[3] is None
    assert index.getRowGroupIndex()[2].getEntryCount() == filters.getBloomFilterCount()
    # A reader leaves out files and stripes by their statistics, and row groups by the filters: an odd id is within the bounds of one.
    read = spark.read.schema(token_file.SCHEMA).orc(f"{tmp_path}/t").select("doc_id", "n_tokens")
    assert scanned(read) == 12_000
    assert 0 < scanned(read.filter("doc_id = 14000")) <= token_file.INDEX_ROWS + 100
    assert sum(scanned(read.filter(f"doc_id = {14_001 + 40 * k}")) == 0 for k in range(30)) > 25


def test_rows_of_one_id_go_to_several_parts(spark, tmp_path):
    df = spark.range(4000).select(F.when(F.col("id") < 100, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    token_file.write_tokens(df, f"{tmp_path}/t", part_rows=500)
    got = token_file.read_tokens(spark, f"{tmp_path}/t")
    assert len(list(tmp_path.glob("t/*.orc"))) == 8 and max(r["count"] for r in spark.read.orc(f"{tmp_path}/t").groupBy("part").count().collect()) < 1500
    rows = sorted(got.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None] * 3900 + [*range(100)]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))


def test_input_of_a_shuffle_is_kept_first(spark):
    from gleaner.llm.common import repeatable

    scan = spark.range(100)
    assert repeatable(scan) is scan
    dealt = scan.repartition(3)
    kept = repeatable(dealt)
    assert kept is not dealt and "Exchange" not in kept._jdf.queryExecution().executedPlan().toString() and kept.count() == 100
