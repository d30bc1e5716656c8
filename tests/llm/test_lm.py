import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import lm, pieces

TEXTS = [
    None, "", " ", "\n", "a", "The cat sat on the mat.", "the CAT  sat", " lead", "trail ", "line\nfeed\n", "\n\nx", "tab\tand\rcarriage\x0bv\x0cf", "\x01 odd \x01\x01",
    "漢字 🦄 x", "é É e", "word \n word", "   ", "a\n b", "foo\xa0bar baz", "MAT. mat.",
]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(pieces.model_path())


def test_cut_lists_are_the_vocabulary_cuts(vocabulary):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab \n\t\1é") for _ in range(rng.randrange(12))) for _ in range(2000)]
    starts, at, names = lm.cut_lists(pa.array(texts, pa.string()), vocabulary)
    for t, a, z in zip(texts, starts, starts[1:], strict=False):
        assert [names[i] for i in at[a:z]] == vocabulary.cuts(t or ""), repr(t)


def segmentations(vocabulary, cut):
    """All segmentations of a cut in the model's form, as lists of piece ids."""
    by_text = {vocabulary.texts[i]: i for i in vocabulary.usable}

    def walk(at):
        if at == len(cut):
            yield []
        for end in range(at + 1, len(cut) + 1):
            piece = cut[at:end]
            if piece in by_text:
                ids = [by_text[piece]]
            elif end == at + 1:
                ids = vocabulary.spelled(piece)
            else:
                continue
            for rest in walk(end):
                yield ids + rest

    return list(walk(0))


def sum_by_force(vocabulary, weights, cut):
    """Probability of a cut by listing every segmentation."""
    return sum(math.exp(sum(weights[i] for i in ids)) for ids in segmentations(vocabulary, cut))


def counts_by_force(vocabulary, weights, cut):
    every = [(ids, math.exp(sum(weights[i] for i in ids))) for ids in segmentations(vocabulary, cut)]
    total = sum(p for _, p in every)
    out = Counter()
    for ids, p in every:
        for i in ids:
            out[i] += p / total
    return out


def test_expected_counts_over_all_segmentations(vocabulary, monkeypatch):
    lattice = lm.Lattice(vocabulary, lm.first_weights(vocabulary))
    for room in (lattice.room, 0):
        lattice.room = room
        for cut in (" the", " thing", "\n", " 漢x", "ertion", " ", "  a", " été🦄", "🦄"):
            got = [0.0] * len(vocabulary.texts)
            lattice.expect(cut, 3, got)
            want = counts_by_force(vocabulary, lattice.weights, cut.replace(" ", pieces.SPACE))
            assert {i: round(x, 9) for i, x in enumerate(got) if x > 1e-8} == {i: round(3 * x, 9) for i, x in want.items() if x > 1e-8 / 3}, cut
    assert abs(np.exp(lattice.weights).sum() - 1) < 1e-9 and lattice.weights[vocabulary.texts.index("in")] > lattice.weights[vocabulary.texts.index("er")]


def test_lattice_sums_all_segmentations(vocabulary):
    rng = np.random.default_rng(0)
    weights = np.log(rng.dirichlet(np.ones(len(vocabulary.texts))))
    lattice = lm.Lattice(vocabulary, weights)
    for cut in (" the", " thing", "\n", " 漢x", "ertion", " ", "  a", " été🦄"):
        got, want = lattice.log_probability(cut), math.log(sum_by_force(vocabulary, weights, cut.replace(" ", pieces.SPACE)))
        assert abs(got - want) < 1e-9, cut
    assert math.isfinite(lattice.log_probability(" " + "thing" * 3000))


def base_by_force(rows):
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w] + [None]
    held = [zlib.crc32(str(d).encode()) % 7 == 2 if d is not None else False for d, _ in rows]
    c = Counter(w for (_, t), h in zip(rows, held, strict=True) if not h for w in words(t))
    n, v = sum(c.values()), len(c)
    out = []
    for (d, t), h in zip(rows, held, strict=True):
        w = words(t)
        out.append((d, h, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)))
    return out


@pytest.mark.parametrize("dictionary", [1 << 17, 3, 0])
def test_report_against_brute_force(spark, monkeypatch, vocabulary, dictionary):
    monkeypatch.setattr(lm, "DICTIONARY", dictionary)
    rng = random.Random(8)
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join(rng.choice("the of Cat cat mat. x\ty zebra quux").replace("\t", "\t") + rng.choice(["", "s", "ing"]) for _ in range(rng.randrange(30)))) for i in range(60)]
    rows += [(None, "no id"), (5, "again"), (5, "again"), (900, "long text " * 20_000)]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n int").repartition(3)
    got = lm.report(df).collect()
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    want = sorted(base_by_force(rows), key=key)
    have = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    assert [x[:5] for x in have] == [x[:5] for x in want]
    assert all(abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5])) for a, b in zip(have, want, strict=True))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    # The model: expected counts in the training texts as wholes, then one sum over each whole text.
    first = lm.Lattice(vocabulary, lm.first_weights(vocabulary))
    counts, ends = [0.0] * len(vocabulary.texts), 0
    for (d, t), h in zip(rows, [x[1] for x in base_by_force(rows)], strict=True):
        if not h:
            ends += 1
            if t:
                first.expect(" " + t, 1, counts)
    weights, end = lm.weights_of(dict(enumerate(counts)), ends, vocabulary)
    lattice = lm.Lattice(vocabulary, weights)
    by = {(r.doc_id, r.n_tokens): r.score for r in got}
    for d, t in rows:
        form = " " + t if t else ""
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1
        whole = (lattice.log_probability(form) + end) / math.log(10)
        assert abs(by[d, n] - whole) < 1e-6 * max(1, abs(whole)), repr(t and t[:30])


def test_texts_without_spaces_and_with_tabs(spark, vocabulary, monkeypatch):
    """One cut each: what's sent to the tasks is bounded by bytes, and the scores are those of whole texts."""
    rng = random.Random(2)
    han = ["".join(chr(0x4E00 + rng.randrange(300)) for _ in range(4_000)) for _ in range(20)]
    tabs = ["\t".join(rng.choice(["id", "name", "x" + str(rng.randrange(50))]) for _ in range(200)) for _ in range(20)]
    rows = list(enumerate(han + tabs + [han[0]] * 3))
    monkeypatch.setattr(lm, "LONG_BYTES", 30_000)
    sent = []
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda sc, value, own=type(spark.sparkContext).broadcast: sent.append(value) or own(sc, value))
    got = {r.doc_id: r for r in lm.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    held = [x for x in sent if isinstance(x, tuple)][0][0]
    assert han[0] in {c.strip() for c in held} and sum(len(c.encode()) for c in held if len(c.encode()) > lm.SHORT) <= 30_000
    base = {x[0]: x for x in base_by_force(rows)}
    assert all((r.n_tokens, r.n_known, r.train_tokens) == base[i][2:5] and abs(r.base_score - base[i][5]) < 1e-6 for i, r in got.items())
    first = lm.Lattice(vocabulary, lm.first_weights(vocabulary))
    counts = [0.0] * len(vocabulary.texts)
    for i, t in rows:
        if not base[i][1]:
            first.expect(" " + t, 1, counts)
    weights, end = lm.weights_of(dict(enumerate(counts)), sum(not x[1] for x in base.values()), vocabulary)
    lattice = lm.Lattice(vocabulary, weights)
    assert all(abs(got[i].score - (lattice.log_probability(" " + t) + end) / math.log(10)) < 1e-6 * abs(got[i].score) for i, t in rows)


def shuffled(spark, df):
    """Bytes of df's shuffles."""
    scope = spark._jvm.scala.collection.JavaConverters
    plan = df._jdf.queryExecution()
    df.collect()
    total = 0

    def walk(node):
        nonlocal total
        if "AdaptiveSparkPlan" in node.nodeName():
            return walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return walk(node.plan())
        metrics = scope.mapAsJavaMap(node.metrics())
        if "shuffleBytesWritten" in metrics:
            total += metrics["shuffleBytesWritten"].value()
        for child in scope.seqAsJavaList(node.children()):
            walk(child)

    walk(plan.executedPlan())
    return total


def test_a_cut_of_many_words_travels_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = {}
        for n in (2_000, 8_000):
            rng = random.Random(n)
            cuts = [(i, " " + "\t".join(f"w{rng.randrange(10**9)}" for _ in range(n)), 1) for i in range(4)]
            table = spark.createDataFrame(cuts, "number long, cut string, n long")
            words = lm._worded(table).select(F.explode("words").alias("word")).distinct().withColumn("c", F.lit(1))
            out = lm._lexicon(table, words)
            sizes[n] = shuffled(spark, out)
            assert {r.n_words for r in out.collect()} == {n}
        assert 0 < sizes[8_000] < 6 * sizes[2_000] and sizes[8_000] < 8_000_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_unigram_files_scores_stand(spark, tmp_path, vocabulary):
    """The public file with its kind set to unigram: its scores are the weights."""
    with open(pieces.model_path(), "rb") as f:
        data = f.read()
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(data + b"\x12\x02\x18\x01")  # a later trainer's part overrides the kind alone
    own = pieces.Vocabulary(path)
    assert own.unigram and own.texts == vocabulary.texts
    got = {r.doc_id: r.score for r in lm.scores(spark.createDataFrame([(1, "the cat"), (2, "")], "doc_id long, text string"), F.lit(False), path).collect()}
    lattice = lm.Lattice(own, lm.first_weights(own))
    assert abs((got[1] - got[2]) * math.log(10) - lattice.log_probability(" the cat")) < 1e-6


def test_no_training_documents_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    (r,) = lm.scores(df, F.lit(True)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and r.score < 0
    assert lm.report(df.limit(0)).count() == 0
