"""Toxicity scores by a factorization machine over hashed terms.

A document's terms are its distinct words, lower-cased, these words' beginnings (inflected forms of one
insult share them), and that a beginning is shared by two or by three of them, hashed to 2 ** BITS ids. The machine is

    bias + sum of w[i] + sum over pairs of <v[i], v[j]>

over the kept terms of a document, so that a pair, such as an insult and the mention of a group, can weigh what
its parts don't. Kept are the terms that the sample ties to either label by themselves (log-likelihood ratio over MIN_RATIO), and,
since a pair may tell what neither part does, words of pairs that the sample ties to a label together. A pair's
measure is the sum over documents of the products of three differences from the mean, the label's and both words', squared, over the sum of these products'
squares, with means of documents of about as many terms (LENGTHS groups), as long documents hold more words of any kind; it counts above MIN_PAIR and twice the logarithm of the number of pairs, which are all pairs of words that have as many documents (or are missing from as many): others
can't reach it. Of these count the pairs that tell more than their words do one by one (the interaction of their log odds, squared and over its variance, above MIN_ODDS): words
that only go together, as those of a language, don't. Other terms have
weight zero. The machine is fitted by AdaGrad on the logistic loss with L2 penalties; the score is its
logistic. Scoring is one pass without a shuffle; the kept terms (MAX_TERMS at most of either kind) go to the tasks.

Defined cases: a null or empty text has the score of a text without kept terms; very long texts are read whole; without labels, or
with one label only, each score is the share of label 1 (0 if there are none); of several labels of a document the greatest
counts, and of terms that tie for the last place the lesser id is kept; repeated rows each get their score; an empty table gives no rows;
columns named score and predicted are replaced, further ones kept.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import trimmed
from gleaner.llm.training import distinct, fold, grouped, labelled, scored, words_of

BITS = 22
BEGINNINGS = (4, 5, 6, 7)
#: A beginning shared by so many distinct words is a term of its own.
SHARED = (2, 3)
MIN_RATIO = 12.0
MIN_PAIR = 24.0
MIN_ODDS = 16.0
LENGTHS = 8
#: Words whose pairs with others are measured at once, and of these others.
PAIRS_AT_ONCE = 512, 2048
MAX_TERMS = 20_000
FACTORS = 8
EPOCHS = 20
THRESHOLD = 0.3
#: Words that a worker remembers.
CACHE = 200_000

_MASK = (1 << BITS) - 1
_GAP = r"[^\p{L}\p{N}_]+"


def _hash(word: str) -> int:
    """Words have even ids, other terms odd ones."""
    return zlib.crc32(word.encode()) << 1 & _MASK


def _terms(word: str) -> list[int]:
    return [_hash(word), *(_hash(f"{word[:n]}*") | 1 for n in BEGINNINGS if len(word) >= n)]


def _shared(term, times: int):
    return term * 0x9E3779B1 + times * 0x85EBCA6B & _MASK | 1


class Terms:
    """Term ids of texts, with a bounded memory of words; only: the ids wanted, if not all are."""

    def __init__(self, only: set[int] | None = None):
        self.only = only
        self.known: dict[str, list[int]] = {}

    def _word(self, word: str) -> list[int]:
        got = self.known.get(word)
        if got is None:
            got = _terms(word)
            if self.only is not None:
                got = [t for t in got if t in self.only or any(_shared(t, k) in self.only for k in SHARED)]
            if len(self.known) < CACHE:
                self.known[word] = got
        return got

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's ids begin (and the last's end), and its distinct ids, ascending."""
        doc, place, names = words_of(pc.split_pattern_regex(pc.utf8_lower(texts), _GAP))
        pair = distinct(doc * len(names) + place)
        doc, place = pair // max(1, len(names)), pair % max(1, len(names))
        own = [self._word(n) for n in names]
        size = np.array([len(o) for o in own], dtype=np.int64)
        flat = np.array([t for o in own for t in o], dtype=np.int64)
        many = size[place]
        ends = np.cumsum(many)
        begins = (np.cumsum(size) - size)[place]
        ids = flat[np.repeat(begins - (ends - many), many) + np.arange(many.sum())]
        key, times = np.unique(np.repeat(doc, many) << BITS | ids, return_counts=True)
        shared = [(key[times >= k] & ~_MASK) | _shared(key[times >= k] & _MASK, k) for k in SHARED]
        return grouped(distinct(np.concatenate([key, *shared])), len(texts), BITS)


def _documents_of(rows: list[np.ndarray]) -> np.ndarray:
    """How many rows have each id."""
    of = np.zeros(1 << BITS, np.int32)
    for r in rows:  # distinct ids; all rows' at once would be another copy of the sample
        of[r] += 1
    return of


def associated(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Ids whose documents' labels differ from the others', the most telling MAX_TERMS."""
    n, n1 = len(y), int(y.sum())
    of = _documents_of(rows)
    of1 = _documents_of([r for r, c in zip(rows, y, strict=True) if c])
    terms = np.flatnonzero(of)
    of, of1 = of[terms].astype(float), of1[terms].astype(float)

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    ratio = 2 * (
        part(of1, of * n1 / n) + part(of - of1, of * (n - n1) / n) + part(n1 - of1, (n - of) * n1 / n) + part(n - n1 - of + of1, (n - of) * (n - n1) / n)
    )
    best = np.argsort(-ratio, kind="stable")[:MAX_TERMS]
    return np.sort(terms[best[ratio[best] > MIN_RATIO]])


def interacting(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Words whose pairs tell the labels; the most telling MAX_TERMS."""
    n = len(y)
    of = _documents_of(rows)
    of = np.minimum(of, n - of)
    terms = np.flatnonzero((of >= MIN_PAIR) & (np.arange(len(of)) % 2 == 0))
    least = MIN_PAIR + 2 * np.log(max(1, len(terms) * (len(terms) - 1) / 2))
    terms = terms[of[terms] >= least]
    place = np.full(1 << BITS, -1, np.int32)
    place[terms] = np.arange(len(terms))
    size = np.array([len(r) for r in rows], dtype=np.int64)
    term = place[np.concatenate([np.empty(0, np.int64), *rows]).astype(np.int64)]
    doc = np.repeat(np.arange(n), size)[term >= 0]
    term = term[term >= 0]
    groups = []  # of documents of about one length: how many, where each word's begin, and these, and the labels
    for docs in np.array_split(np.argsort(size, kind="stable"), max(1, min(LENGTHS, n // 500))):
        if not len(docs):
            continue
        at = np.full(n, -1)
        at[docs] = np.arange(len(docs))
        own = np.flatnonzero(at[doc] >= 0)
        own = own[np.argsort(term[own], kind="stable")]
        groups.append((len(docs), np.searchsorted(term[own], np.arange(len(terms) + 1)), at[doc[own]], y[docs].astype(float)))
    best = np.zeros(len(terms))
    few, many = PAIRS_AT_ONCE
    for lo in range(0, len(terms), many):
        hi = min(lo + many, len(terms))
        for at in range(0, hi, few):  # pairs of words before hi: each once, but for those of this block
            end = min(at + few, hi)
            shape = end - at, hi - lo
            total, square = np.zeros(shape), np.zeros(shape)
            cells = [[np.zeros(shape), np.zeros((end - at, 1)), np.zeros(hi - lo), 0.0] for _ in (0, 1)]  # by label: documents with both, the one, the other, any
            for count, upto, held, label in groups:

                def has(a: int, z: int) -> np.ndarray:
                    out = np.zeros((count, z - a), np.float32)  # noqa: B023
                    out[held[upto[a] : upto[z]], np.repeat(np.arange(z - a), np.diff(upto[a : z + 1]))] = 1  # noqa: B023
                    return out

                these, those = has(at, end), has(lo, hi)
                p, q = these.mean(axis=0, dtype=float)[:, None], those.mean(axis=0, dtype=float)
                sums = []
                for k, w in enumerate((1 - label, label)):
                    w32 = w.astype(np.float32)
                    sums.append([((these * w32[:, None]).T @ those).astype(float), (w32 @ these).astype(float)[:, None], (w32 @ those).astype(float), float(w.sum())])
                    for sum_, own in zip(range(4), sums[-1], strict=True):
                        cells[k][sum_] = cells[k][sum_] + own
                rest = label.mean()  # a document's difference from it is 1 - rest or -rest
                for out, (w0, w1) in ((total, (-rest, 1 - rest)), (square, (rest**2, (1 - rest) ** 2))):
                    both, a, b, s = (w0 * x + w1 * y1 for x, y1 in zip(*sums, strict=True))
                    # A word's difference from its mean p is 1 - p or -p, and its square is (1 - 2 p) where the word is, and p * p.
                    r, t, u, v = (1, 1, -p, -q) if out is total else (1 - 2 * p, 1 - 2 * q, p * p, q * q)
                    out += r * t * both + r * v * a + u * t * b + u * v * s
            found = total * total / np.maximum(square, 1e-9)
            odds, spread = np.zeros(shape), np.zeros(shape)
            for k, sign in ((1, 1), (0, -1)):
                both, a, b, s = cells[k]
                for cell, turn in ((both, 1), (a - both, -1), (b - both, -1), (s - a - b + both, 1)):
                    odds += sign * turn * np.log(cell + 0.5)
                    spread += 1 / (cell + 0.5)
            found[odds * odds < MIN_ODDS * spread] = 0
            found[np.arange(at, end)[:, None] == np.arange(lo, hi)] = 0
            best[at:end] = np.maximum(best[at:end], found.max(axis=1))
            best[lo:hi] = np.maximum(best[lo:hi], found.max(axis=0))
    order = np.argsort(-best, kind="stable")[:MAX_TERMS]
    return np.sort(terms[order[best[order] > least]])


class Machine:
    """bias, w (a weight per term) and v (a vector per term) over the kept terms; the last row of each is padding, zero."""

    def __init__(self, terms: np.ndarray, bias: float):
        self.terms = terms
        self.bias = bias
        self.w = np.zeros(len(terms) + 1)
        self.v = np.zeros((len(terms) + 1, FACTORS))
        self.find: Terms | None = None

    def margin(self, ids: np.ndarray) -> np.ndarray:
        """Of documents given as rows of places, padded."""
        v = self.v[ids]
        s = v.sum(axis=1)
        return self.bias + self.w[ids].sum(axis=1) + 0.5 * ((s * s).sum(axis=1) - (v * v).sum(axis=(1, 2)))

    def _padded(self, rows: list) -> np.ndarray:
        out = np.full((len(rows), max(1, *map(len, rows))), len(self.terms))
        for i, r in enumerate(rows):
            out[i, : len(r)] = r
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        self.find = self.find or Terms(set(self.terms.tolist()))
        upto, ids = self.find(texts)
        place = np.searchsorted(self.terms, ids)
        kept = np.append(self.terms, -1)[place] == ids
        doc = np.repeat(np.arange(len(texts)), np.diff(upto))[kept]
        place = place[kept]
        sums = lambda x: np.bincount(doc, weights=x, minlength=len(texts))
        out = self.bias + sums(self.w[place])
        for k in range(FACTORS):
            own = self.v[place, k]
            out += 0.5 * (sums(own) ** 2 - sums(own * own))
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def fit(rows: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Machine:
    """A machine fitted to documents given as arrays of term ids."""
    n1 = int(y.sum()) if len(y) else 0
    if not n1 or n1 == len(y):
        return Machine(np.empty(0, np.int64), 40.0 if n1 else -40.0)
    m = Machine(np.union1d(associated(rows, y), interacting(rows, y)), float(np.log(n1 / (len(y) - n1))))
    if not len(m.terms):
        return m
    kept = np.zeros(1 << BITS, bool)
    kept[m.terms] = True
    places = [np.searchsorted(m.terms, r[kept[r]]) for r in rows]
    rng = np.random.default_rng(seed)
    m.v[:-1] = rng.normal(0, 0.05, (len(m.terms), FACTORS))
    gw, gv, gb = np.full(len(m.w), 1e-6), np.full(m.v.shape, 1e-6), 1e-6
    rate, pull_w, pull_v = 0.3, 1e-5, 1e-4
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 256):
            own = order[at : at + 256]
            ids = m._padded([places[i] for i in own])
            v = m.v[ids]
            s = v.sum(axis=1)
            z = m.bias + m.w[ids].sum(axis=1) + 0.5 * ((s * s).sum(axis=1) - (v * v).sum(axis=(1, 2)))
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[own]) / len(own)
            gb += g.sum() ** 2
            m.bias -= rate * g.sum() / np.sqrt(gb)
            flat = ids.ravel()
            dw = pull_w * m.w + np.bincount(flat, weights=np.repeat(g, ids.shape[1]), minlength=len(m.w))
            step = (g[:, None, None] * (s[:, None, :] - v)).reshape(-1, FACTORS)
            dv = pull_v * m.v
            for k in range(FACTORS):
                dv[:, k] += np.bincount(flat, weights=step[:, k], minlength=len(m.w))
            dw[-1], dv[-1] = 0, 0
            gw += dw * dw
            gv += dv * dv
            m.w -= rate * dw / np.sqrt(gw)
            m.v -= rate * dv / np.sqrt(gv)
    return m


def train(docs: DataFrame, labels: DataFrame, use: Column) -> Machine:
    """A machine fitted to the bounded sample of labelled documents where ``use`` holds."""
    found = fit(*labelled(docs, labels, "toxic", use, Terms()))
    trimmed()
    return found


def with_scores(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1, higher: likelier toxic) and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # 2 * MAX_TERMS rows at most
    return scored(docs, lambda texts: shared.value.scores(texts), threshold)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    machine = train(docs, labels, fold(F.col("doc_id"), 4) != 2)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = with_scores(own, machine)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
