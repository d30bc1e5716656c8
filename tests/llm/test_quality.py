import random
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import quality, training


def corpus(rng, n):
    rows = []
    for i in range(n):
        words = [rng.choice("the of and to a in is on for with".split()) + rng.choice(["", "al", "er", "ing"]) for _ in range(rng.randrange(5, 60))]
        kind = rng.randrange(8)
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        elif kind == 1:
            words = [w for w in words[:6] for _ in range(6)]
        elif kind == 2:
            words = [w + rng.choice(["$$$", "###"]) for w in words]
        rows.append((i, " ".join(words).capitalize() if kind > 2 else " ".join(words), int(kind > 2)))
    return rows


@pytest.mark.parametrize("word,want", [("Ab,", "Aa,"), ("CD!!", "A!+"), ("x12", "a0"), ("éÉ", "aA"), ("$$$", "$+"), ("", "")])
def test_shapes(word, want):
    assert quality.shape(word) == want


def ids_of(text):
    return quality.Grams()(pa.array([text]))[1].tolist()


def plain_ids(text):
    words, mask, mix = text.split(), (1 << 64) - 1, 0x9E3779B97F4A7C15
    own = [2 * zlib.crc32(quality.shape(w).encode()) + (i > 0 and w == words[i - 1]) for i, w in enumerate(words)]
    out = {zlib.crc32(w.lower().encode()) % (1 << quality.BITS) for w in words}
    for i in range(len(own)):
        gram = own[i]
        for k in range(3):
            if i + k < len(own):
                gram = gram if not k else (gram * mix + own[i + 1]) * mix & mask if k == 1 else (gram + own[i + 2]) * mix & mask
                out.add(((gram * mix + k) * mix & mask) >> 64 - quality.BITS)
    return sorted(out)


def test_grams_against_a_plain_version():
    texts = [t for _, t, _ in corpus(random.Random(1), 30)] + ["", " ", "one", "one one", "One, one, One, two!!", " a  b\tc\nd "]
    upto, ids = quality.Grams()(pa.array(texts))
    assert [ids[a:z].tolist() for a, z in pairwise(upto)] == [plain_ids(t) for t in texts]
    assert len(quality.Grams()(pa.array([], pa.string()))[1]) == 0


def test_grams_are_indicators_of_whole_texts():
    assert ids_of("a b a b") == sorted({*ids_of("a b a b")})
    late = {*ids_of("the " * 50_000 + "END!!")} - {*ids_of("the " * 50_000)}
    assert late and ids_of("") == []
    assert quality.shape("a1" * 40) != quality.shape("a1" * 40 + "!") and ids_of("a1" * 40 + "!") != ids_of("a1" * 40)


def test_descent_reaches_the_least_of_the_primal():
    """On a small problem, against many random steps away from the fitted weights."""
    rng = np.random.default_rng(2)
    rows = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(60)]
    rows = [r if len(r) else np.array([0]) for r in rows]
    y = np.array([int(3 in r or (5 in r and 7 not in r)) for r in rows])
    ratio = np.zeros(1 << quality.BITS, np.float32)
    ratio[:12] = rng.normal(size=12)
    beta, epochs = quality.BETA, quality.EPOCHS
    quality.BETA, quality.EPOCHS = 0.0, 3000
    try:
        w, b = quality._descend(rows, y, ratio, 1)
    finally:
        quality.BETA, quality.EPOCHS = beta, epochs
    sign = 2 * y - 1
    cost = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    x = np.zeros((60, 12))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt((ratio[r] ** 2).sum())

    def primal(w, b):
        return 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - sign * (x @ w + b))).sum()

    best = primal(w[:12], b)
    assert all(primal(w[:12] + d[:12], b + d[12]) > best - 2e-2 for d in rng.normal(0, 0.05, (500, 13)))


def test_report_held_out(spark):
    rows = corpus(random.Random(4), 1200)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows] + [(None, None, "x", 1), (9000, "", "x", 1), (0, rows[0][1], "x", 1)], "doc_id long, text string, lang string, predicted int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, None)], "doc_id long, quality int")
    got = quality.report(docs, labels).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    y = {i: y for i, _, y in rows}
    out = [r for r in got if r.held_out and r.doc_id in y]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in out) and len(out) > 150
    assert sum(r.predicted == y[r.doc_id] for r in out) / len(out) > 0.97
    flipped = labels.withColumn("quality", F.when(training.fold(F.col("doc_id"), 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(str, quality.report(docs, flipped).collect())) == sorted(map(str, got))


def test_report_against_a_plain_version(spark):
    """Scores from plain n-grams, a plain descent over dense rows and the fitted curve."""
    rows = corpus(random.Random(8), 260)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.report(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")).collect()}
    own = [(set(plain_ids(t)), y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    y = np.array([c for _, c in own])

    def plain_model(some):
        grams = Counter(g for d, _ in some for g in d)
        good = Counter(g for d, c in some if c for g in d)
        kept = [g for g in grams if grams[g] >= quality.MIN_DOCS]
        p, q = sum(good[g] + 1 for g in kept), sum(grams[g] - good[g] + 1 for g in kept)
        ratio = {g: float(np.float32(np.log((good[g] + 1) / p / ((grams[g] - good[g] + 1) / q)))) for g in kept}
        ratio = {g: r for g, r in ratio.items() if r}
        n1 = sum(c for _, c in some)
        w, bias, alpha = dict.fromkeys(ratio, 0.0), 0.0, [0.0] * len(some)
        order = np.random.default_rng(11)
        for _ in range(quality.EPOCHS):
            moved = 0.0
            for i in order.permutation(len(some)).tolist():
                d, c = some[i]
                size = sum(ratio.get(g, 0) ** 2 for g in d) ** 0.5
                x = {g: ratio[g] / max(size, 1e-9) for g in d if g in ratio}
                sign, most = (1, len(some) / (2 * n1)) if c else (-1, len(some) / (2 * (len(some) - n1)))
                slope = sign * (sum(w[g] * v for g, v in x.items()) + bias) - 1
                new = min(max(alpha[i] - slope / (sum(v * v for v in x.values()) + 1), 0), most)
                step, alpha[i] = (new - alpha[i]) * sign, new
                bias += step
                moved = max(moved, abs(step))
                for g, v in x.items():
                    w[g] += step * v
            if moved < 1e-3:
                break
        mean = np.mean([abs(v) for v in w.values() if v])
        w = {g: (1 - quality.BETA) * v + quality.BETA * np.sign(v) * mean for g, v in w.items()}
        return lambda d: sum(w[g] * ratio[g] for g in d if g in w) / max(sum(ratio.get(g, 0) ** 2 for g in d) ** 0.5, 1e-9) + bias

    rng = np.random.default_rng(11)
    out = np.concatenate([rng.permutation(np.flatnonzero(y == c))[: (y == c).sum() // 5] for c in (0, 1)])
    first = plain_model([own[i] for i in sorted({*range(len(own))} - {*out.tolist()})])
    slope, shift = quality._curve(np.array([first(own[i][0]) for i in out]), y[out])
    margin = plain_model(own)
    assert all(abs(got[i] - 1 / (1 + np.exp(-(slope * margin(set(plain_ids(t))) + shift)))) < 1e-3 for i, t, _ in rows)


def test_one_class_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [round(r.score, 6) for r in quality.report(docs, none).collect()] == [0, 0]
    ones = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert all(r.score > 0.99 for r in quality.report(docs, ones).collect())
    assert quality.report(docs.limit(0), ones).count() == 0
