"""Cross-tokenizer alignment: where two tokenizers' tokens end at the same byte, and which of their tokens overlap.

Tokenizer A is a byte-level BPE read by the tokenizers library, B a SentencePiece model read by its own. A run of texts is laid
end to end, and the documents' byte offsets are kept. The places where A's tokens end are counted by byte once, as are B's. Where both end
is a cut between groups; each stretch between neighbouring ends of either kind lies in one token of A and
one of B, so these stretches are the pairs of tokens that overlap. Running sums of these marks give each token's group and each stretch's two tokens,
and their differences at the documents' offsets give each document's counts.

Neither tokenizer's tokens cross from a character that is no white space into a following space or line feed: A's pattern splits there and
no piece of B holds a space's mark, or a line feed, after another character. The same holds before a comma and some other marks after a letter. So texts are cut there, in parts of PART characters that
are aligned one after another, and a cut's ids, looked up by its text, come from a bounded cache or else the libraries.
Other tokenizers' texts, if their files have another pattern or pieces, are encoded whole.

How often documents hold a pair of ids linked is counted once over the corpus. A document's distinct pairs are
written with its counts; tasks add up pairs before they hand them on. The most frequent pairs, at most FREQUENT, are broadcast; other
pairs of a document travel, by a row for each, to their counts. So neither the table of pairs nor a document's pairs are collected.

Defined cases: a text that is null, empty, or that A's or B's tokens don't spell (as one with U+2581, which B reads as a space) has no tokens, and zeros; strings
of special tokens are plain text; very long texts are aligned whole; rows without a doc_id, with equal ones and repeated rows come out as
often as they came in and count as documents; of pairs that tie in frequency at the limit none is broadcast; an empty table gives no rows; further columns are
kept by ``with_groups``, which replaces columns named as its own.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm import pieces
from gleaner.llm.common import dropped, landed, pieces_of
from gleaner.llm.token_file import tokenizer_path

#: Cuts, and characters of them, that a worker remembers.
CACHE, CACHE_CHARS = 400_000, 8_000_000
#: Cuts that the libraries get at once.
LEARNT = 4096
#: Characters of a text that are aligned at once, and of a run of texts.
PART = 1_000_000
#: Pairs of ids that every task holds at most.
FREQUENT = 1 << 19
#: Pairs of documents that a task holds before it adds them up.
HELD = 4_000_000
#: Marks before which a word may be cut off too, if none of B's pieces has them after a letter or digit.
_MARKS = ",.;:!?)]}%&#$*\"…»"
_PLAIN = re.compile(r" ?\S+").fullmatch


def _byte_of() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, others for the characters from U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


class Aligned(NamedTuple):
    """Of a batch of texts: counts by text, the hash of its groups, distinct linked pairs and how often, ids and the bytes where groups end."""

    counts: np.ndarray  # n_a, n_b, n_groups, n_links by column
    hashes: list[str]
    pairs: tuple[np.ndarray, np.ndarray, np.ndarray]  # where each text's begin (and the last's end), the pairs, their occurrences
    parts: list[tuple]  # (text, A's ids, B's ids, A's groups, B's groups, groups' ends) of each part, numbered and counted within it


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # its threads would compete with Spark's tasks
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        if hasattr(self.a.model, "_resize_cache"):
            self.a.model._resize_cache(0)  # it is never asked for a cut twice in a row
        self.batch = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = _byte_of()
        special = set(self.a.get_added_tokens_decoder())
        a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            a_bytes[i] = token.encode() if i in special else bytes(byte[c] for c in token)
        b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(pieces.SPACE, " ").encode())
        self.spelled = a_bytes, b_bytes
        self.size = tuple(np.array([len(x) for x in s], np.int64) for s in self.spelled)
        self.n_b = len(b_bytes)
        #: Decimal digits of A's and then B's ids.
        decimal = [str(i).encode() for i in (*range(len(a_bytes)), *range(self.n_b))]
        self.n_digits = np.array([len(x) for x in decimal])
        self.digits = np.array(decimal).view(np.uint8).reshape(len(decimal), -1)
        with open(a_path, encoding="utf-8") as f:
            form = json.load(f)
        pattern = form.get("pre_tokenizer") or {}
        plain = pattern.get("type") == "ByteLevel" and pattern.get("use_regex", True) and not pattern.get("add_prefix_space") and not form.get("normalizer")
        vocabulary = pieces.Vocabulary(b_path)
        self.cut = plain and vocabulary.prefix and vocabulary.cutter.pattern == r" *[^ \n]+| +|\n"
        feed = self.b.encode("\n")
        self.lead, self.feed, self.line = len(feed), feed[-1], self.a.encode("\n", add_special_tokens=False).ids
        marks = [m for m in _MARKS if not any(re.search(rf"[^\W_]{re.escape(m)}", t) for t in vocabulary.texts)]
        self.border = re.compile(r"(?<=\S)(?=[ \n])" + (rf"|(?<=[^\W_])(?=[{re.escape(''.join(marks))}])" if marks else ""))
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = [np.empty(0, np.int32), np.empty(0, np.int32)]
        self.upto = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.right = np.empty(0, bool)
        self.chars = 0

    def _learn(self, new: list[str]) -> None:
        """Remembers cuts' ids."""
        plain = [c for c in new if _PLAIN(c)] if self.cut and len(self.line) == 1 else []
        other = [c for c in new if not _PLAIN(c)] if plain else new
        for cuts, known in ((plain, self._lines), (other, self._each)):
            for lo in range(0, len(cuts), LEARNT):
                self._keep(cuts[lo : lo + LEARNT], known(cuts[lo : lo + LEARNT]))

    def _lines(self, cuts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of cuts without inner or closing white space, and how many each has, by A and B: as lines of one text, whose line feeds are tokens of their own."""
        text = "\n".join(cuts)
        a = np.array(self.batch([text], add_special_tokens=False)[0].ids, np.int32)
        b = np.array(self.b.encode("\n" + text)[self.lead :], np.int32)
        out = []
        for ids, line in ((a, self.line[0]), (b, self.feed)):
            ends = np.flatnonzero(ids == line)
            out.append((ids[ids != line], np.diff(np.r_[-1, ends, len(ids)]) - 1))
        return out

    def _each(self, cuts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same of any cuts."""
        found = [e.ids for e in self.batch(cuts, add_special_tokens=False)]
        if self.cut:  # after a line feed nothing is put before a text
            other = [x[self.lead :] for x in self.b.encode(["\n" + c for c in cuts], num_threads=1)]
        else:
            other = self.b.encode([c[1:] for c in cuts], num_threads=1)
        return [(np.fromiter(chain.from_iterable(own), np.int32), np.fromiter(map(len, own), np.int64, len(own))) for own in (found, other)]

    def _keep(self, cuts: list[str], found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.place.update(zip(cuts, range(len(self.place), len(self.place) + len(cuts)), strict=True))
        self.chars += sum(map(len, cuts))
        data = [c.encode() for c in cuts]
        bounds = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
        whole = b"".join(data)
        right = np.ones(len(cuts), bool)
        for k, (ids, many) in enumerate(found):
            upto = np.cumsum(many)
            spelled = list(map(self.spelled[k].__getitem__, ids.tolist()))
            ends = np.r_[0, np.cumsum(self.size[k][ids])][upto]
            if not np.array_equal(ends, bounds) or b"".join(spelled) != whole:
                right &= [x == b"".join(spelled[y:z]) for x, y, z in zip(data, (upto - many).tolist(), upto.tolist(), strict=True)]
            self.ids[k] = np.concatenate([self.ids[k], ids])
            self.upto[k] = np.concatenate([self.upto[k], self.upto[k][-1] + upto])
        self.right = np.r_[self.right, right]

    def _gathered(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of tokenizer k of cuts, and how many each has."""
        many = self.upto[k][at + 1] - self.upto[k][at]
        upto = np.cumsum(many)
        return self.ids[k][np.repeat(self.upto[k][at] - upto + many, many) + np.arange(upto[-1] if len(at) else 0)], many

    def _runs(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
        """Numbers of texts and their parts, some PART characters at once."""
        rows: list[int] = []
        parts: list[str] = []
        size = 0
        for row, text in enumerate(texts):
            if not text:
                continue
            text, at = " " + text, 0
            while at < len(text):
                end = len(text)
                if self.cut and end - at > PART and (m := self.border.search(text, at + PART)):
                    end = m.start()
                rows.append(row)
                parts.append(text[at:end])
                size, at = size + end - at, end
                if size >= PART:
                    yield rows, parts
                    rows, parts, size = [], [], 0
        if rows:
            yield rows, parts

    def align(self, texts: list[str | None], ids: bool = False) -> Aligned:
        """ids: whether to return the tokens and groups themselves."""
        counts = np.zeros((len(texts), 4), np.int64)
        wrong = np.zeros(len(texts), bool)
        hashes: dict[int, object] = {}
        bits = (len(self.spelled[0]) * self.n_b).bit_length()
        linked, times, kept = [], [], []
        for rows, parts in self._runs(texts):
            if len(self.place) > CACHE or self.chars > CACHE_CHARS:
                self._forget()
            cuts = [self.border.split(p) if self.cut else [p] for p in parts]
            if new := list({c: None for own in cuts for c in own if c not in self.place}):
                self._learn(new)
            at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(cuts)), np.int64)
            row, part = np.array(rows), np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
            wrong[row[part[~self.right[at]]]] = True
            use = ~wrong[row[part]]
            at, part = at[use], part[use]
            if not len(at):
                continue
            a, in_a = self._gathered(0, at)
            b, in_b = self._gathered(1, at)
            end_a, end_b = np.cumsum(self.size[0][a]), np.cumsum(self.size[1][b])
            total = int(end_a[-1])
            bounds = np.searchsorted(part, np.arange(len(cuts) + 1))  # cuts before each part
            tokens = [np.r_[0, np.cumsum(n)][bounds] for n in (in_a, in_b)]
            offset = np.r_[0, end_a][tokens[0]]  # each part's first byte, and the end
            ends_a, ends_b = np.bincount(end_a, minlength=total + 1), np.bincount(end_b, minlength=total + 1)
            cut, stretch = (ends_a > 0) & (ends_b > 0), (ends_a > 0) | (ends_b > 0)
            upto_a, upto_b, upto_cut, upto_stretch = (np.cumsum(x) for x in (ends_a, ends_b, cut, stretch))
            found = np.column_stack([np.diff(tokens[0]), np.diff(tokens[1]), np.diff(upto_cut[offset]), np.diff(upto_stretch[offset])])
            np.add.at(counts, row, found)

            where = np.flatnonzero(stretch)
            pair = a[upto_a[where - 1]].astype(np.int64) * self.n_b + b[upto_b[where - 1]]
            key, many = np.unique(np.repeat(row, found[:, 3]) << bits | pair, return_counts=True)
            linked.append(key)
            times.append(many)

            group_a, group_b = upto_cut[end_a - 1], upto_cut[end_b - 1]
            for i, data in enumerate(self._written(a, b, group_a, group_b, tokens)):
                if not data:
                    continue
                if row[i] in hashes:
                    hashes[row[i]].update(b";")
                else:
                    hashes[row[i]] = hashlib.sha256()
                hashes[row[i]].update(data)
            if ids:
                for i in range(len(cuts)):
                    (x, y), (u, v) = tokens[0][i : i + 2], tokens[1][i : i + 2]
                    first = upto_cut[offset[i]]
                    kept.append((int(row[i]), a[x:y], b[u:v], group_a[x:y] - first, group_b[u:v] - first, np.flatnonzero(cut[offset[i] + 1 : offset[i + 1] + 1]) + 1))
        counts[wrong] = 0
        key, many = (np.concatenate([np.empty(0, np.int64), *x]) for x in (linked, times))
        use = ~wrong[key >> bits] if len(key) else np.zeros(0, bool)
        key, place = np.unique(key[use], return_inverse=True)  # a text's parts may share pairs
        many = np.bincount(place, weights=many[use], minlength=len(key)).astype(np.int64)
        upto = np.searchsorted(key, np.arange(len(texts) + 1) << bits)
        return Aligned(counts, [hashes[i].hexdigest() if i in hashes and not wrong[i] else "" for i in range(len(texts))], (upto, key & (1 << bits) - 1, many), [k for k in kept if not wrong[k[0]]])

    def _written(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, tokens: list[np.ndarray]) -> Iterator[memoryview]:
        """Each part's groups as text: a1,a2|b1;a3|b2."""
        groups = int(group_a[-1]) + 1
        before_b = np.r_[0, np.cumsum(np.bincount(group_b, minlength=groups))]
        upto_a = np.cumsum(np.bincount(group_a, minlength=groups))
        n = len(a) + len(b)
        at_a, at_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + upto_a[group_b]
        number, sign = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        number[at_a], number[at_b] = a, b.astype(np.int64) + len(self.spelled[0])
        sign[at_a[np.r_[group_a[1:] != group_a[:-1], True]]] = ord("|")
        sign[at_b[np.r_[group_b[1:] != group_b[:-1], True]]] = ord(";")
        many = self.n_digits[number]
        end = np.cumsum(many + 1)
        out = np.empty(int(end[-1]), np.uint8)
        out[end - 1] = sign
        start = end - 1 - many
        for k in range(self.digits.shape[1]):
            have = many > k
            out[start[have] + k] = self.digits[number[have], k]
        upto = np.r_[0, end][tokens[0] + tokens[1]]
        for x, y in zip(upto.tolist(), upto[1:].tolist(), strict=False):
            yield memoryview(out)[x : max(x, y - 1)]


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _paths(a: str | None, b: str | None) -> tuple[str, str]:
    return a or tokenizer_path(), b or pieces.model_path()


def with_groups(docs: DataFrame, text: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """docs and groups: of each text the ids of A and of B and the byte (of the space and the text) where each group ends."""
    paths = _paths(a, b)
    kind = T.ArrayType(T.StructType().add("a", T.ArrayType(T.IntegerType())).add("b", T.ArrayType(T.IntegerType())).add("end", "long"))
    schema = T.StructType([f for f in docs.schema.fields if f.name != "groups"])
    names = list(schema.names)
    schema = schema.add("groups", kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*paths)
        for batch in pieces_of(batches, text):
            out: list[list[dict]] = [[] for _ in range(len(batch))]
            for row, x, y, in_x, in_y, ends in own.align(batch.column(text).to_pylist(), True).parts:
                first = out[row][-1]["end"] if out[row] else 0
                split = [np.split(v, np.flatnonzero(np.diff(g)) + 1) for v, g in ((x, in_x), (y, in_y))]
                out[row] += [{"a": p, "b": q, "end": first + e} for p, q, e in zip(*split, ends.tolist(), strict=True)]
            kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, kind)], names=schema.names)

    return docs.select(names).mapInArrow(run, schema)


def _added(keys: list[np.ndarray]) -> pa.RecordBatch:
    pair, n = np.unique(np.concatenate([np.empty(0, np.int64), *keys]), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "docs"])


def _pair_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pairs of each document -> pair, docs: how many documents of the task have it, in a few rows or one."""
    held: list[np.ndarray] = []
    size = 0
    for b in batches:
        held.append(b.column(0).flatten().to_numpy())
        size += len(held[-1])
        if size >= HELD:
            yield _added(held)
            held, size = [], 0
    yield _added(held)


def counts(held: DataFrame, n_b: int) -> DataFrame:
    """held (pairs): pair, docs (how many rows hold it) and best (whether no pair of the same A id has more)."""
    pairs = landed(held.select("pairs").mapInArrow(_pair_docs, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs")), "pairs", compression="zstd")
    a = F.expr(f"pair div {n_b}")
    most = pairs.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))
    out = landed(pairs.withColumn("a", a).join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "counts", compression="zstd")
    dropped(pairs)
    return out


def _frequent(table: DataFrame) -> DataFrame:
    """The pairs of the greatest counts, by steps of a sixteenth of a doubling, FREQUENT at most."""
    step = F.floor(F.log2(F.col("docs")) * 16)
    room, least = FREQUENT, None
    for r in table.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # some hundreds
        room -= r["count"]
        if room < 0:
            break
        least = r.step
    return table.limit(0) if least is None else table.filter(step >= least)


def report(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row."""
    paths = _paths(a, b)
    n_b = pieces_size(paths[1])
    facts = ["n_a", "n_b", "n_groups", "n_links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*paths)
        for batch in pieces_of(batches, 2):
            got = own.align(batch.column(2).to_pylist())
            upto = pa.array(got.pairs[0].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), *(pa.array(got.counts[:, k]) for k in range(4)), pa.array(got.hashes, pa.string()),
                    pa.ListArray.from_arrays(upto, pa.array(got.pairs[1])), pa.ListArray.from_arrays(upto, pa.array(got.pairs[2].astype(np.int32))),
                ],
                names=["row", "doc_id", *facts, "groups_sha256", "pairs", "times"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    held = landed(rows.mapInArrow(run, schema), "aligned", compression="zstd")
    table = counts(held, n_b)
    often = _frequent(table).toArrow().sort_by("pair")
    shared = docs.sparkSession.sparkContext.broadcast(tuple(often.column(c).to_numpy() for c in ("pair", "docs", "best")))

    def looked_up(batch: pa.RecordBatch):
        """The document of each pair, pairs, occurrences, places among the frequent pairs and whether they are there."""
        pair, docs_of, _ = shared.value
        own = batch.column("pairs").combine_chunks() if isinstance(batch.column("pairs"), pa.ChunkedArray) else batch.column("pairs")
        doc = np.repeat(np.arange(len(batch)), np.diff(own.offsets.to_numpy()))
        key, times = own.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
        at = np.minimum(np.searchsorted(pair, key), max(len(pair) - 1, 0))
        return doc, key, times, at, pair[at] == key if len(pair) else np.zeros(len(key), bool)

    def often_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, docs_of, best = shared.value
        for batch in batches:
            doc, _, times, at, there = looked_up(batch)
            doc, times, at = doc[there], times[there], at[there]
            total, good = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            np.add.at(total, doc, times * docs_of[at] if len(at) else times)
            np.add.at(good, doc, times * best[at] if len(at) else times)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(good), pa.array(total)], names=["row", "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key, times, _, there = looked_up(batch)
            rest = ~there
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(doc[rest])), pa.array(key[rest]), pa.array(times[rest])], names=["row", "pair", "times"])

    lists = held.select("row", "pairs", "times")
    rare = lists.mapInArrow(others, "row long, pair long, times long").join(table, "pair")
    rare = rare.select("row", (F.col("times") * F.col("best").cast("long")).alias("n_best"), (F.col("times") * F.col("docs")).alias("count_sum"))
    sums = lists.mapInArrow(often_sums, "row long, n_best long, count_sum long").unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return held.drop("pairs", "times").join(sums, "row").select("doc_id", *facts, "n_best", "count_sum", "groups_sha256")


@cache
def pieces_size(path: str) -> int:
    return len(pieces.Vocabulary(path).texts)
