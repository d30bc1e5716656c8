"""Quality scores by naive Bayes support vectors: a linear hinge-loss model over n-gram indicators scaled by log-count ratios.

The n-grams are of two kinds, both of a whole text and hashed to 2 ** BITS ids: words, and runs of one to
three word shapes. A shape keeps a word's marks and folds runs of capitals, small letters and digits
("Ab," and "AB!!" differ, "Ab," and "Cd," don't), and says whether the word repeats the one before it.
For each n-gram found in MIN_DOCS documents of the sample or more, r is the logarithm of the ratio of its
smoothed shares in the two classes. Documents are rows of r at their n-grams, scaled to unit length; the model
is fitted to them by dual coordinate descent on the L2-regularised hinge loss, its weights are drawn
towards their mean size by 1 - BETA, and a logistic curve fitted to a fifth of the sample, left out of a
first fit, turns margins into scores. Scoring is one pass without a shuffle.

Defined cases: a null or empty text has no n-grams and the score of margin ``bias``; very long texts and words are read whole; without
labels, or with one label only, each score is the share of label 1 (0 if there are none); of several labels of a document the
greatest counts; repeated rows each get their score; an empty table gives no rows; columns named score and predicted are replaced, further
ones kept.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import trimmed
from gleaner.llm.training import distinct, fold, grouped, labelled, scored, words_of

BITS = 18
MIN_DOCS = 5
BETA = 0.25
COST = 1.0
EPOCHS = 12
THRESHOLD = 0.3
#: Words that a worker remembers.
CACHE = 200_000

_MASK = (1 << BITS) - 1
_RUNS = ((re.compile(r"\d+"), "0"), (re.compile(r"([^\w\s])\1+"), r"\1+"))


def shape(word: str) -> str:
    """Capitals as A, small letters as a, digits as 0, runs of a mark as the mark and +; others as they are."""
    if word.isalpha():  # the common ones at once
        if word.islower():
            return "a"
        if word.isupper():
            return "A"
        if word[0].isupper() and word[1:].islower():
            return "Aa"
    elif len(word) > 1 and word[:-1].isalpha() and not word[-1].isalnum():
        return shape(word[:-1]) + word[-1]
    folded = "".join("A" if c.isupper() else "a" if c.isalpha() else c for c in word)
    folded = re.sub("A+", "A", re.sub("a+", "a", folded))
    for pattern, by in _RUNS:
        folded = pattern.sub(by, folded)
    return folded


class Grams:
    """n-gram ids of texts, with a bounded memory of words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def _word(self, word: str) -> int:
        """The word's id above the 32 bits of its shape."""
        got = self.known.get(word)
        if got is None:
            got = (zlib.crc32(word.lower().encode()) & _MASK) << 32 | zlib.crc32(shape(word).encode())
            if len(self.known) < CACHE:
                self.known[word] = got
        return got

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's ids begin (and the last's end), and its n-grams' distinct ids, ascending."""
        doc, place, names = words_of(pc.utf8_split_whitespace(texts))
        both = np.fromiter(map(self._word, names), np.uint64, len(names))[place]
        again = np.r_[False, (place[1:] == place[:-1]) & (doc[1:] == doc[:-1])][: len(doc)]
        one = (both & np.uint64(0xFFFFFFFF)) * np.uint64(2) + again
        mix = np.uint64(0x9E3779B97F4A7C15)
        two = (one[:-1] * mix + one[1:]) * mix
        three = (two[:-1] + one[2:]) * mix
        keys = [doc << BITS | (both >> np.uint64(32)).astype(np.int64)]
        for k, grams in enumerate((one, two, three)):
            own = doc[: len(grams)]
            whole = own == doc[k:]  # all words are of one text
            ids = ((grams * mix + np.uint64(k)) * mix >> np.uint64(64 - BITS)).astype(np.int64)
            keys.append((own << BITS | ids)[whole])
        return grouped(distinct(np.concatenate(keys)), len(texts), BITS)


class Model:
    """A weight per id (zero for ids not kept), in which r is multiplied in, and the curve from margin to score."""

    def __init__(self, bias: float, weight: np.ndarray | None = None, ratio: np.ndarray | None = None, slope: float = 1.0, shift: float = 0.0):
        self.bias, self.slope, self.shift = bias, slope, shift
        self.weight = np.zeros(1 << BITS, np.float32) if weight is None else weight
        self.square = np.zeros(1 << BITS, np.float32) if ratio is None else ratio * ratio
        self.grams: Grams | None = None

    def margins(self, upto: np.ndarray, ids: np.ndarray) -> np.ndarray:
        doc = np.repeat(np.arange(len(upto) - 1), np.diff(upto))
        total, length = (np.bincount(doc, weights=x[ids], minlength=len(upto) - 1) for x in (self.weight, self.square))
        return total / np.maximum(np.sqrt(length), 1e-9) + self.bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        self.grams = self.grams or Grams()
        z = self.slope * self.margins(*self.grams(texts)) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    n = 1 << BITS
    of = np.bincount(np.concatenate(rows), minlength=n).astype(float)
    of1 = np.bincount(np.concatenate([r for r, c in zip(rows, y, strict=True) if c]), minlength=n).astype(float)
    p, q = of1 + 1, of - of1 + 1
    kept = of >= MIN_DOCS
    r = np.log((p / p[kept].sum()) / (q / q[kept].sum()), where=kept, out=np.zeros(n))
    return r.astype(np.float32)


def _descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Weights on rows of r at unit length, and the bias, by dual coordinate descent on the hinge loss."""
    sign = np.where(y == 1, 1.0, -1.0)
    cost = np.where(y == 1, COST * len(y) / (2 * y.sum()), COST * len(y) / (2 * (len(y) - y.sum())))
    rows = [r[ratio[r] != 0] for r in rows]
    values = [ratio[r] / max(float(np.sqrt((ratio[r] ** 2).sum())), 1e-9) for r in rows]
    diagonal = np.array([float(v @ v) for v in values]) + 1.0  # the bias is a feature of value 1
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(y)).tolist():
            r, v = rows[i], values[i]
            gradient = sign[i] * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), cost[i])
            if step := (new - alpha[i]) * sign[i]:
                w[r] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    used = np.flatnonzero(w)
    if len(used):
        w[used] = (1 - BETA) * w[used] + BETA * np.sign(w[used]) * np.abs(w[used]).mean()
    return w, bias


def _curve(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and shift of the logistic curve through margins and labels, with smoothed targets, by Newton steps."""
    n1 = y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    a, b = 1.0, float(np.log((n1 + 1) / (len(y) - n1 + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        g = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
        k = p * (1 - p) + 1e-9
        h = np.array([[(k * z * z).sum() + 1e-3, (k * z).sum()], [(k * z).sum(), k.sum()]])
        step = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def fit(rows: list[np.ndarray], y: np.ndarray, seed: int = 11) -> Model:
    n1 = int(y.sum()) if len(y) else 0
    if not n1 or n1 == len(y):
        return Model(0.0, shift=40.0 if n1 else -40.0)

    def fitted(own: np.ndarray, **curve: float) -> Model:
        some = [rows[i] for i in own]
        ratio = _ratios(some, y[own])
        w, bias = _descend(some, y[own], ratio, seed)
        return Model(bias, (w * ratio).astype(np.float32), ratio, **curve)

    rng = np.random.default_rng(seed)
    out = np.concatenate([rng.permutation(np.flatnonzero(y == c))[: (y == c).sum() // 5] for c in (0, 1)])
    rest = np.setdiff1d(np.arange(len(y)), out)
    if len(np.unique(y[out])) < 2:  # too few labels to leave some out
        out = rest = np.arange(len(y))
    first = fitted(rest)
    left = [rows[i] for i in out]
    slope, shift = _curve(first.margins(np.cumsum([0, *map(len, left)]), np.concatenate(left)), y[out])
    return fitted(np.arange(len(y)), slope=slope, shift=shift)


def train(docs: DataFrame, labels: DataFrame, use: Column) -> Model:
    """A model fitted to the bounded sample of labelled documents where ``use`` holds."""
    found = fit(*labelled(docs, labels, "quality", use, Grams()))
    trimmed()
    return found


def with_scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1, higher: likelier good) and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB: two numbers per id
    return scored(docs, lambda texts: shared.value.scores(texts), threshold)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels, fold(F.col("doc_id"), 5) != 0)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = with_scores(own, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
