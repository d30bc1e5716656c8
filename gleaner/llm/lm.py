"""Language-model scores of texts: a subword lattice's marginal likelihood, beside a word unigram base.

The model. A public vocabulary (pieces.Vocabulary) gives the pieces and their scores; a text's probability is the sum
over all its segmentations into pieces of the product of their probabilities, and of the end's. A unigram file's scores are
logarithms of probabilities, and the model's weights as they stand. A merge file's are ranks, which stand for probabilities by Zipf's law: with these all
segmentations of the training documents are weighed, and the pieces' expected counts in them, smoothed by one, are
the model's weights. The end's weight is the count of documents among these counts, for either file. Both sums, over one text's segmentations and over a piece's places in them, are
recursions, forward and backward, over the pieces that an Aho-Corasick automaton finds, in log space where a product could leave the
range of a double; a character without a piece is spelled by its bytes' pieces.

How it scales. No piece crosses the cuts of pieces.Vocabulary, so a text's likelihood is the product of its
cuts', and so is the base's but for the end. Each distinct cut of the corpus is therefore counted, weighed
and summed once, in a lexicon that is a distributed table: nothing of the vocabulary's size is collected. Its
most frequent cuts, DICTIONARY short ones and LONG_BYTES of longer ones, are sent to the tasks that read the documents; only a document's other
cuts travel, to join the lexicon by cut. Words are counted by an aggregation and joined to the cuts that hold them, by the cuts' numbers, so a cut of
many words isn't sent with each of them, and a word of very many cuts is no task's alone.

Defined cases: a null text is empty and has the end alone; very long texts, and those without any space (one cut), are read whole; a
document without an id is trained on; without training documents all counts are zero; of cuts that tie in frequency all or none are
sent; repeated rows come out as often as they came in; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import pieces
from gleaner.llm.common import dropped, landed, pieces_of
from gleaner.llm.training import fold

#: Cuts of up to SHORT bytes that every task holds at most, and bytes of longer ones.
DICTIONARY, SHORT = 1 << 17, 64
LONG_BYTES = 4_000_000
#: Cuts, and characters of them, that a task counts before it hands them on.
COUNTED = 200_000
COUNTED_CHARS = 8_000_000
#: A summand smaller by this (in logarithms) than the sum doesn't change a double.
NOTHING = 40.0

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAK = "\1"


@cache
def _vocabulary(path: str) -> pieces.Vocabulary:
    return pieces.Vocabulary(path)


def cut_lists(texts: pa.Array, vocabulary: pieces.Vocabulary) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Where each text's cuts begin (and the last's end), the cuts as places in a list, and that list of distinct cuts."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    plain = vocabulary.prefix and vocabulary.cutter.pattern == r" *[^ \n]+| +|\n"
    odd = pc.match_substring_regex(texts, "  |\x01|^ ") if plain else pa.array([True] * len(texts))
    slow = odd.to_numpy(zero_copy_only=False).nonzero()[0]
    marked = pc.replace_substring(pc.replace_substring(texts, " ", _BREAK + " "), "\n", f"{_BREAK}\n{_BREAK}")
    lists = pc.split_pattern(pc.binary_join_element_wise(" ", marked, ""), _BREAK)
    starts = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values
    if len(slow):
        own = pa.array([vocabulary.cuts(texts[i].as_py()) for i in slow.tolist()], pa.list_(pa.string()))
        sizes = np.diff(starts)
        sizes[slow] = np.diff(own.offsets.to_numpy())
        source = starts[:-1].copy()
        source[slow] = own.offsets.to_numpy()[:-1] + len(values)
        values = pa.concat_arrays([values, own.values])
        upto = np.r_[0, np.cumsum(sizes)]
        values = values.take(pa.array(np.repeat(source - upto[:-1], sizes) + np.arange(upto[-1])))
        starts = upto
    coded = values.dictionary_encode()
    at, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    # A text that ends with or doubles a line feed leaves empty cuts; an empty text's only cut is the space before it.
    empty = np.zeros(len(texts), bool)
    if plain:
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    blank = np.array([n == "" for n in names], bool)
    drop = blank[at] | np.repeat(empty, np.diff(starts)) if len(at) else np.zeros(0, bool)
    if drop.any():
        kept = np.r_[0, np.cumsum(~drop)]
        starts, at = kept[starts], at[~drop]
    return starts, at, names


def _counted(path: str):
    """(text, train) -> cuts and how often training documents have them (0: only others do)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        counts: dict[str, int] = {}
        chars = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["cut", "n"])

        for b in pieces_of(batches, 0):
            starts, at, names = cut_lists(b.column(0), vocabulary)
            train = np.repeat(b.column(1).to_numpy(zero_copy_only=False), np.diff(starts))
            n = np.bincount(at, weights=train, minlength=len(names)).astype(np.int64)
            seen = np.zeros(len(names), bool)
            seen[at] = True
            for i in np.flatnonzero(seen).tolist():
                counts[names[i]] = counts.get(names[i], 0) + int(n[i])
                chars += len(names[i])
            if len(counts) >= COUNTED or chars >= COUNTED_CHARS:
                yield out()
                counts.clear()
                chars = 0
        yield out()

    return run


class Lattice:
    """All segmentations of cuts under piece weights (natural logarithms, by piece id)."""

    def __init__(self, vocabulary: pieces.Vocabulary, weights: np.ndarray):
        w = weights.tolist()
        self.vocabulary = vocabulary
        self.matches = vocabulary.automaton(lambda i: (w[i], math.exp(w[i]))).iter
        self.weights = w
        self.single = {vocabulary.texts[i] for i in vocabulary.usable if len(vocabulary.texts[i]) == 1}
        #: Characters whose product stays in a double's range.
        self.room = int(600 / max(1.0, -min(w)))

    def _edges(self, cut: str) -> list[tuple[int, int, tuple[int, ...], float]]:
        """Start, end, pieces and weight of each step through a cut in the model's form, by end."""
        ends: list[list[tuple[int, int, tuple[int, ...], float]]] = [[] for _ in cut]
        for end, (size, piece, (weight, _)) in self.matches(cut):
            ends[end].append((end + 1 - size, end + 1, (piece,), weight))
        for end, found in enumerate(ends):
            if cut[end] not in self.single:
                spelled = tuple(self.vocabulary.spelled(cut[end]))
                found.append((end, end + 1, spelled, sum(self.weights[i] for i in spelled)))
        return [e for found in ends for e in found]

    def log_probability(self, cut: str) -> float:
        """Of a cut with spaces as spaces: over all its segmentations, by a forward recursion."""
        cut = cut.replace(" ", pieces.SPACE)
        n = len(cut)
        plain = self.single.issuperset(cut)
        if plain and n <= self.room:
            alpha = [1.0] + [0.0] * n
            for end, (size, _, (_, p)) in self.matches(cut):
                end += 1
                alpha[end] += alpha[end - size] * p
            return math.log(alpha[n])
        none = -math.inf
        alpha = [0.0] + [none] * n
        log1p, exp = math.log1p, math.exp
        steps = ((end + 1 - size, end + 1, w) for end, (size, _, (w, _)) in self.matches(cut)) if plain else ((a, z, w) for a, z, _, w in self._edges(cut))
        for start, end, weight in steps:
            own, old = alpha[start] + weight, alpha[end]
            if own > old:
                alpha[end] = own + log1p(exp(old - own)) if old > own - NOTHING else own
            elif own > old - NOTHING:
                alpha[end] = old + log1p(exp(own - old))
        return alpha[n]

    def expect(self, cut: str, times: int, counts: list[float]) -> None:
        """Adds to counts, by piece id, how often the segmentations of ``times`` such cuts have each piece, by their shares of the whole."""
        cut = cut.replace(" ", pieces.SPACE)
        n = len(cut)
        if n <= self.room and self.single.issuperset(cut):
            alpha, beta = [1.0] + [0.0] * n, [0.0] * n + [1.0]
            steps = []
            for end, (size, piece, (_, p)) in self.matches(cut):
                end += 1
                start = end - size
                own = alpha[start] * p
                alpha[end] += own
                steps.append((start, end, piece, p, own))
            each = times / alpha[n]
            for start, end, piece, p, own in reversed(steps):
                after = beta[end]
                if after:
                    beta[start] += p * after
                    counts[piece] += own * after * each
            return
        edges = self._edges(cut)
        add = np.logaddexp
        alpha, beta = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        for start, end, _, weight in edges:
            alpha[end] = add(alpha[end], alpha[start] + weight)
        for start, end, own, weight in reversed(edges):
            beta[start] = add(beta[start], weight + beta[end])
            share = times * math.exp(alpha[start] + weight + beta[end] - alpha[n])
            for piece in own:
                counts[piece] += share


def first_weights(vocabulary: pieces.Vocabulary) -> np.ndarray:
    """The file's scores as logarithms of probabilities; a byte's piece is rarer than all others."""
    if vocabulary.unigram:
        out = np.array(vocabulary.scores)
        out[list(vocabulary.bytes.values())] = vocabulary.least - pieces.UNKNOWN_PENALTY
        return out
    share = 1 / (1 - np.array(vocabulary.scores))
    share[list(vocabulary.bytes.values())] = 1 / (1 + len(share))
    return np.log(share / share.sum())


def _piece_counts(path: str):
    """(cut, n) -> piece ids and how often the segmentations of the training documents' cuts have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        lattice = Lattice(vocabulary, first_weights(vocabulary))
        counts = [0.0] * len(vocabulary.texts)
        for b in batches:
            for cut, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lattice.expect(cut, n, counts)
        total = np.array(counts)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "n"])

    return run


def weights_of(counts: dict[int, float], ends: int, vocabulary: pieces.Vocabulary) -> tuple[np.ndarray, float]:
    """Add-one smoothed log shares of the pieces, by id, and of the end."""
    used = sorted({*vocabulary.usable, *vocabulary.bytes.values(), vocabulary.unknown})
    n = np.zeros(len(vocabulary.texts))
    for i, k in counts.items():
        n[i] = k
    total = n[used].sum() + ends + len(used) + 1
    return np.log((n + 1) / total), math.log((ends + 1) / total)


def _with_lattice(path: str, weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(_vocabulary(path), weights.value)
        for b in batches:
            own = [lattice.log_probability(c) for c in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.float64())], names=[*b.schema.names, "lattice"])

    return run


def _worded(cuts: DataFrame) -> DataFrame:
    lowered = F.translate("cut", _UPPER, _UPPER.lower())
    return cuts.select("number", "cut", "n", F.array_remove(F.split(lowered, r"[\x09-\x0D\x20]+"), "").alias("words"))


def _lexicon(cuts: DataFrame, words: DataFrame) -> DataFrame:
    """(number, cut, n) and (word, c: how often training documents have it) -> cut, n, n_words, n_known, base (sum of log10(c + 1))."""
    facts = (F.col("c") > 0).cast("long"), F.log10(F.col("c") + 1)
    named = ("n_known", "base")
    one = _worded(cuts).filter(F.size("words") == 1).select("cut", "n", F.col("words")[0].alias("word"))  # a cut that is hardly more than its word
    single = one.join(words, "word").select("cut", "n", F.lit(1).cast("long").alias("n_words"), *(f.alias(a) for f, a in zip(facts, named, strict=True)))
    each = _worded(cuts).filter(F.size("words") > 1).select("number", F.explode("words").alias("word"))
    sums = each.join(words, "word").groupBy("number").agg(F.count("*").alias("n_words"), *(F.sum(f).alias(a) for f, a in zip(facts, named, strict=True)))
    several = cuts.join(sums, "number").select("cut", "n", "n_words", *named)
    none = _worded(cuts).filter(F.size("words") == 0).select("cut", "n", *(F.lit(0).cast(t).alias(a) for a, t in (("n_words", "long"), ("n_known", "long"), ("base", "double"))))
    return reduce(DataFrame.unionByName, (single, several, none))


def _frequent(lexicon: DataFrame, size: Column, room: int) -> DataFrame:
    """The cuts whose count is the least or greater that leaves a total size of ``room`` at most."""
    least = None
    for r in lexicon.groupBy("n").agg(F.sum(size).alias("size")).orderBy(F.desc("n")).limit(DICTIONARY + 1).collect():  # a row per distinct count
        room -= r.size
        if room < 0:
            break
        least = r.n
    return lexicon.limit(0) if least is None else lexicon.filter(F.col("n") >= least)


_FACTS = ("n_words", "n_known", "base", "lattice")
_ROW = "row long, doc_id long, held_out boolean, n_words long, n_known long, base double, lattice double, cuts array<string>, times array<int>"


def _read(path: str, dictionary):
    """(doc_id, held_out, text) -> _ROW: sums over the cuts in the dictionary, and the other cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        known, facts = dictionary.value
        facts = np.vstack([facts, np.zeros(len(_FACTS))])
        row = TaskContext.get().partitionId() << 36
        for b in pieces_of(batches, 2):
            starts, at, names = cut_lists(b.column(2), vocabulary)
            place = np.array([known.get(n, -1) for n in names], dtype=np.int64)
            doc = np.repeat(np.arange(len(b)), np.diff(starts))
            own = place[at] if len(at) else at
            sums = [np.bincount(doc, weights=facts[own, k], minlength=len(b)).astype(float) for k in range(len(_FACTS))]  # whole numbers if no text has a cut
            pair, times = np.unique(doc[own < 0] * (len(names) + 1) + at[own < 0], return_counts=True)
            upto = np.searchsorted(pair, np.arange(len(b) + 1) * (len(names) + 1)).astype(np.int32)
            rare = pa.array(names, pa.string()).take(pa.array(pair % (len(names) + 1)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + len(b))), b.column(0), b.column(1), pa.array(sums[0].round().astype(np.int64)), pa.array(sums[1].round().astype(np.int64)),
                    pa.array(sums[2]), pa.array(sums[3]), pa.ListArray.from_arrays(pa.array(upto), rare), pa.ListArray.from_arrays(pa.array(upto), pa.array(times.astype(np.int32))),
                ],
                names=["row", "doc_id", "held_out", *_FACTS, "cuts", "times"],
            )
            row += len(b)

    return run


def scores(docs: DataFrame, held_out: Column, model: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of each row of docs (doc_id, text), learned where not held out."""
    path = model or pieces.model_path()
    sc = docs.sparkSession.sparkContext
    vocabulary = _vocabulary(path)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    ends = docs.filter(~F.col("held_out")).count()
    counted = docs.select("text", (~F.col("held_out")).alias("train")).mapInArrow(_counted(path), "cut string, n long")
    counted = counted.groupBy("cut").agg(F.sum("n").alias("n")).withColumn("number", F.monotonically_increasing_id())
    cuts = landed(counted, "cuts", compression="zstd")  # so that the numbers stay

    shares = cuts.filter("n > 0").mapInArrow(_piece_counts(path), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    weights, end_weight = weights_of({r.piece: r.n for r in shares.collect()}, ends, vocabulary)  # a row per piece
    shared = sc.broadcast(first_weights(vocabulary) if vocabulary.unigram else weights)
    words = landed(_worded(cuts).select("n", F.explode("words").alias("word")).groupBy("word").agg(F.sum("n").alias("c")), "words", compression="zstd")
    schema = "cut string, n long, n_words long, n_known long, base double, lattice double"
    lexicon = landed(_lexicon(cuts, words).mapInArrow(_with_lattice(path, shared), schema), "lexicon", compression="zstd")

    total = lexicon.agg(F.sum(F.col("n") * F.col("n_words")).alias("n")).first()
    tokens, kinds = (total.n or 0) + ends, words.filter("c > 0").count() + (ends > 0)
    dropped(cuts)
    dropped(words)
    size = F.octet_length("cut")
    often = _frequent(lexicon.filter(size <= SHORT), F.lit(1), DICTIONARY).unionByName(_frequent(lexicon.filter(size > SHORT), size, LONG_BYTES))
    often = often.select("cut", *_FACTS).toArrow()
    facts = np.column_stack([often.column(c).to_numpy().astype(float) for c in _FACTS])
    dictionary = sc.broadcast(({c: i for i, c in enumerate(often.column("cut").to_pylist())}, facts))

    rows = landed(docs.mapInArrow(_read(path, dictionary), _ROW), "rows", compression="zstd")
    other = rows.select("row", F.explode(F.arrays_zip("cuts", "times")).alias("x")).select("row", F.col("x.cuts").alias("cut"), F.col("x.times").alias("times"))
    found = other.join(lexicon.select("cut", *_FACTS), "cut").groupBy("row").agg(*(F.sum(F.col(c) * F.col("times")).alias(f"o_{c}") for c in _FACTS))
    n, known, base, lattice = (F.col(c) + F.coalesce(F.col(f"o_{c}"), F.lit(0)) for c in _FACTS)
    n = n + 1
    base = base + F.lit(math.log10(ends + 1)) - n * F.lit(math.log10(tokens + kinds + 1))
    return rows.drop("cuts", "times").join(found, "row", "left").select(
        "doc_id", "held_out", n.cast("long").alias("n_tokens"), (known + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), ((lattice + F.lit(end_weight)) / F.lit(math.log(10))).alias("score"),
    )


def report(docs: DataFrame) -> DataFrame:
    return scores(docs, fold(F.col("doc_id"), 7) == 2)
