import math
import random
import re
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import toxicity, training


def corpus(rng, n=600):
    """Toxic: an insult together with a group; neither alone is."""
    rows = []
    for i in range(n):
        words = [rng.choice("the of and to a in is on for with") + rng.choice(["", "al", "er"]) for _ in range(rng.randrange(5, 40))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["grobnik"] * insult + ["martians"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group)))
    return rows


def rows_of(texts):
    upto, ids = toxicity.Terms()(pa.array(texts, pa.string()))
    return [ids[a:z] for a, z in pairwise(upto)]


def plain_terms(text):
    words = {w for w in re.split(r"\W+", text.lower()) if w}
    count = Counter((t, odd) for w in words for t, odd in [(w, 0), *((w[:n] + "*", 1) for n in (4, 5, 6, 7) if len(w) >= n)])
    mask = (1 << 22) - 1
    hashed = Counter()
    for (t, odd), n in count.items():
        hashed[zlib.crc32(t.encode()) * 2 & mask | odd] += n
    return sorted({*hashed, *((t * 0x9E3779B1 + k * 0x85EBCA6B) & mask | 1 for t, n in hashed.items() for k in (2, 3) if n >= k)})


def test_terms_of_whole_texts_against_a_plain_version():
    rng = random.Random(5)
    texts = [t for _, t, _ in corpus(rng, 40)] + ["", "  ", "Grobnik grobniks GROBNIKER grob_nik2", "Ünter, Über-all; unter\tüb", "the " * 40_000 + "end", "a b a"]
    assert [r.tolist() for r in rows_of(texts)] == [plain_terms(t) for t in texts]
    assert len(toxicity.Terms()(pa.array([], pa.string()))[1]) == 0


def test_machine_learns_what_only_a_pair_tells():
    rng = random.Random(3)
    rows = corpus(rng, 1500)
    m = toxicity.fit(rows_of([t for _, t, _ in rows]), np.array([y for *_, y in rows]))
    both, insult, group, none = m.scores(pa.array(["a grobnik for Martians", "a grobnik for the", "on the martians", "on the"]))
    assert both > 0.8 and insult < 0.3 and group < 0.3 and none < 0.1


def test_terms_that_tell_nothing_by_themselves():
    """Label 1: both or neither, so that each term's documents have the labels of all."""
    rng = random.Random(3)
    texts = [t for _, t, _ in corpus(rng, 1500)]
    y = np.array([("grobnik" in t) == ("martians" in t) for t in texts]).astype(np.int64)
    rows = rows_of(texts)
    assert not len(toxicity.associated(rows, y)) and {toxicity._hash("grobnik"), toxicity._hash("martians")} <= {*toxicity.interacting(rows, y).tolist()}
    both, insult, group, none = toxicity.fit(rows, y).scores(pa.array(["a grobnik for Martians", "a grobnik for the", "on the martians", "on the"]))
    assert both > 0.8 and insult < 0.2 and group < 0.2 and none > 0.7


@pytest.mark.parametrize("at_once", [(512, 2048), (2, 3), (1, 2)])
def test_pairs_are_measured_as_by_counting(monkeypatch, at_once):
    monkeypatch.setattr(toxicity, "PAIRS_AT_ONCE", at_once)
    rng = random.Random(9)
    rows = [np.array(sorted({2 * rng.randrange(8) for _ in range(4)} | {2 * rng.randrange(8) + 1})) for _ in range(400)]
    y = np.array([int((0 in r) == (2 in r)) if rng.random() < 0.6 else rng.randrange(2) for r in rows])
    left = y - y.mean()

    def measure(i, j):
        p, q = (sum(t in r for r in rows) / len(rows) for t in (i, j))
        each = [s * ((i in r) - p) * ((j in r) - q) for r, s in zip(rows, left, strict=True)]
        odds = spread = 0.0
        for label, sign in ((1, 1), (0, -1)):
            for a in (True, False):
                for b in (True, False):
                    n = sum(1 for r, c in zip(rows, y, strict=True) if c == label and (i in r) == a and (j in r) == b) + 0.5
                    odds += sign * (1 if a == b else -1) * math.log(n)
                    spread += 1 / n
        return sum(each) ** 2 / sum(x * x for x in each) if odds * odds >= toxicity.MIN_ODDS * spread else 0

    least = toxicity.MIN_PAIR + 2 * math.log(28)
    want = [i for i in range(0, 16, 2) if max(measure(i, j) for j in range(0, 16, 2) if j != i) > least]
    assert toxicity.interacting(rows, y).tolist() == want and {0, 2} <= set(want)


@pytest.mark.parametrize("fillers,filler,share", [(50, 0.4, 1.0), (2500, 0.4, 1.0), (2500, 0.15, 0.1)])
def test_a_pair_among_many_frequent_words(fillers, filler, share):
    """Only whether both or neither of two words is there tells the label, in all documents or in some; all other words tell nothing."""
    rng = np.random.default_rng(fillers)
    names = np.array([f"{a}{b}{c}" for a in "qwrtzpsd" for b in "aeiouy" for c in "fghjklmnbvcxqwrtzpsdfghjklmnbvcxqwrtzpsdfghjklmnbvcxqwrtzpsd"])[:fillers]
    texts, y, told = [], [], []
    for _ in range(2600):
        active = rng.random() < share
        a, b = (active and rng.random() < 0.5 for _ in "ab")
        texts.append(" ".join([*names[rng.random(len(names)) < filler], *["aaa"] * a, *["bbb"] * b]))
        y.append(int(a == b) if a or b else int(rng.random() < 0.5) if share < 1 else 1)
        told.append(a or b or share == 1)
    rows, y, told = rows_of(texts), np.array(y), np.array(told)
    m = toxicity.fit(rows[:2000], y[:2000])
    assert {toxicity._hash("aaa"), toxicity._hash("bbb")} <= {*m.terms.tolist()}
    right = ((m.scores(pa.array(texts[2000:])) >= 0.5) == y[2000:])[told[2000:]]
    assert right.mean() > 0.9


def plain_fit(rows, y, terms, seed=7):
    """toxicity.fit in loops over documents, terms and pairs."""
    n1, k = sum(y), toxicity.FACTORS
    rng = np.random.default_rng(seed)
    v, w, bias = rng.normal(0, 0.05, (len(terms), k)), [0.0] * len(terms), math.log(n1 / (len(y) - n1))
    gw, gv, gb = [1e-6] * len(terms), np.full(v.shape, 1e-6), 1e-6
    docs = [[terms.index(t) for t in r if t in terms] for r in rows]
    for _ in range(toxicity.EPOCHS):
        order = rng.permutation(len(y)).tolist()
        for at in range(0, len(order), 256):
            own = order[at : at + 256]
            db, dw, dv = 0.0, [1e-5 * x for x in w], 1e-4 * v
            for i in own:
                d = docs[i]
                z = bias + sum(w[a] for a in d) + sum(float(v[a] @ v[b]) for a in d for b in d if a < b)
                g = (1 / (1 + math.exp(-z)) - y[i]) / len(own)
                db += g
                for a in d:
                    dw[a] += g
                    dv[a] += g * sum((v[b] for b in d if b != a), np.zeros(k))
            gb += db * db
            bias -= 0.3 * db / math.sqrt(gb)
            for a in range(len(terms)):
                gw[a] += dw[a] ** 2
                w[a] -= 0.3 * dw[a] / math.sqrt(gw[a])
            gv += dv * dv
            v -= 0.3 * dv / np.sqrt(gv)
    return bias, w, v


def test_fit_and_scores_against_a_plain_version():
    texts = [t for _, t, _ in corpus(random.Random(2), 300)]
    y = [int("grobnik" in t and "martians" in t) for t in texts]
    rows = rows_of(texts)
    m = toxicity.fit(rows, np.array(y))
    terms = m.terms.tolist()
    bias, w, v = plain_fit([r.tolist() for r in rows], y, terms)
    assert 2 <= len(terms) and abs(m.bias - bias) < 1e-6 and np.allclose(m.w[:-1], w) and np.allclose(m.v[:-1], v)
    for text, score in zip(texts[:50], m.scores(pa.array(texts[:50])), strict=True):
        d = [terms.index(t) for t in plain_terms(text) if t in terms]
        z = bias + sum(w[a] for a in d) + sum(float(v[a] @ v[b]) for a in d for b in d if a < b)
        assert abs(score - 1 / (1 + math.exp(-z))) < 1e-6


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = toxicity.Machine(np.arange(6), 0.5)
    m.w[:-1], m.v[:-1] = rng.normal(size=6), rng.normal(size=(6, toxicity.FACTORS))
    ids = [0, 2, 5]
    want = 0.5 + m.w[ids].sum() + sum(m.v[i] @ m.v[j] for i in ids for j in ids if i < j)
    assert abs(m.margin(m._padded([ids]))[0] - want) < 1e-9


def test_fold_is_crc32_of_the_id(spark):
    got = spark.range(50).select("id", training.fold(F.col("id"), 4).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in got)


def test_report_held_out(spark):
    rows = corpus(random.Random(4), 1600)
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows] + [(None, None, "x", 1.0), (9000, "", "x", 1.0), (0, rows[0][1], "x", 1.0)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 1), (5000, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.report(docs, labels).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    y = {i: y for i, _, y in rows}
    out = [r for r in got if r.held_out and r.doc_id in y]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in out) and len(out) > 300
    assert sum(r.predicted == y[r.doc_id] for r in out) / len(out) > 0.95
    # Labels of held-out documents change nothing.
    flipped = labels.withColumn("toxic", F.when(training.fold(F.col("doc_id"), 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.report(docs, flipped).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_one_class_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [round(r.score, 6) for r in toxicity.report(docs, none).collect()] == [0, 0]
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert all(r.score > 0.99 for r in toxicity.report(docs, ones).collect())
    assert toxicity.report(docs.limit(0), ones).count() == 0
