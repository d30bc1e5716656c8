import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gleaner.llm import decontaminate


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def by_force(docs, items):
    windows = set()
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        windows.update((i, tuple(w[a : a + n])) for a in range(len(w) - n + 1) if n)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, win in windows:
            n = len(win)
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) == win:
                    hit.update(range(a, a + n))
                    found.update([str(i)] if i is not None else [])
        ids = ",".join(sorted(found))
        out.append((str(d), len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out)


def tables(rng):
    vocabulary = ["a", "the", "x1", "É", "é", "ñandú", "Of", "of", "to", "漢字", "b"]
    text = lambda n: rng.choice([" ", ", ", "\n", " -- "]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([12, 15, 30]))) for i in range(12)] + [(20, text(4)), (21, "the of the"), (22, ""), (23, None), (24, "lone zebra"), (None, text(14)), (3, text(11)), (25, "rep " * 14)]
    docs = []
    for i in range(60):
        w = text(rng.randrange(40)).split(" ")
        for _ in range(rng.randrange(3)):
            own = rng.choice([t for _, t in items if t]).split(" ")
            a = rng.randrange(len(own))
            w[rng.randrange(len(w) + 1) : 0] = own[a : a + rng.choice([9, 10, 11, 40])] if rng.random() < 0.5 else own
        docs.append((i, " ".join(w).upper() if i % 9 == 0 else " ".join(w)))
    docs += [(100, None), (101, ""), (102, "..."), (None, items[0][1]), (5, docs[5][1]), (5, docs[5][1]), (5, "other text"), (103, "rep " * 200), (104, "filler " * 30_000 + items[1][1])]
    return docs, items


def test_windows_of_many_items_aren_t_broadcast(spark, monkeypatch):
    """A hundred windows, each of 2,000 items: few rows, many bytes."""
    text = " ".join(f"w{i}" for i in range(109))
    items = spark.range(2000).select(F.col("id").alias("item_id"), F.lit(text).alias("text"))
    docs = spark.createDataFrame([(1, text), (2, "other")], "doc_id long, text string")
    sent = []
    monkeypatch.setattr(F, "broadcast", lambda df, own=F.broadcast: sent.append(df.columns) or own(df))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 4_000_000)
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == {1: (109, 2000), 2: (0, 0)} and not any("items" in c for c in sent)


@pytest.mark.parametrize("broadcast,size", [(100_000, 64_000_000), (0, 64_000_000), (100_000, 0)])
@pytest.mark.parametrize("seed", [1, 2])
def test_report_against_brute_force(spark, monkeypatch, broadcast, size, seed):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", size)
    docs, items = tables(random.Random(seed))
    df = spark.createDataFrame([(d, t, 0, 0) for d, t in docs], "doc_id long, text string, key int, n_words int")
    bench = spark.createDataFrame([(i, t, "w") for i, t in items], "item_id long, text string, words string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.report(df, bench).collect())
    want = by_force(docs, items)
    assert got == want and 5 < sum(r[-1] for r in want) < len(want)
    kept = sorted((str(r.doc_id), r.text) for r in decontaminate.clean(df, bench).collect())
    flags = {(str(d), t): by_force([(d, t)], items)[0][-1] for d, t in docs if (t or "").count("filler") == 0}
    flags |= {(str(d), t): True for d, t in docs if (t or "").count("filler")}
    assert kept == sorted((str(d), t) for d, t in docs if not flags[str(d), t])


def test_main_path_is_native(spark):
    docs, items = tables(random.Random(0))
    plan = decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", text) and "BroadcastHashJoin" in text


def test_documents_are_read_once_for_items_of_all_lengths(spark, tmp_path):
    spark.createDataFrame([(i, "some words of a document that holds them " * 3) for i in range(9)], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    items = spark.createDataFrame([(n, " ".join(f"w{n}x{k}" for k in range(n))) for n in range(1, 13)], "item_id long, text string")
    plan = decontaminate.report(spark.read.parquet(f"{tmp_path}/d"), items)
    assert plan._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


@pytest.mark.parametrize("names", [1_000_000, 0])
def test_a_large_benchmark_and_a_hot_passage(spark, monkeypatch, names):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 100)
    monkeypatch.setattr(decontaminate, "BROADCAST_DOCS", names)
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    hot = text(12)
    items = [(i, text(rng.choice([7, 15, 40]))) for i in range(40)] + [(90, hot + " " + text(5)), (91, "two words")]
    docs = [(i, f"{text(20)} {hot} {text(5)}") for i in range(60)] + [(100 + i, text(60)) for i in range(60)] + [(200, f"{text(9)} {items[3][1]}"), (201, "has Two, words"), (None, hot)]
    got = decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == by_force(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:4] for r in decontaminate.report(docs, items).orderBy("doc_id").collect()] == [(2, 0, 0), (0, 0, 0)]
    assert decontaminate.report(docs.limit(0), items).count() == 0 and decontaminate.clean(docs, items).count() == 2


def test_spans_are_merged_runs_of_hit_words(spark):
    long, short = " ".join(f"w{i}" for i in range(14)), "only three words"
    texts = [f"a b {long} c {short}. {short} d", "clean", None, long, f"{long} {' '.join(long.split()[:10])} x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, long), (2, short)], "item_id long, text string")
    got = {r.doc_id: ([tuple(s) for s in r.spans], r.n_hit) for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == {0: ([(2, 14), (17, 6)], 20), 1: ([], 0), 2: ([], 0), 3: ([(0, 14)], 14), 4: ([(0, 24)], 24)}
