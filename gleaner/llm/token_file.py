"""Token ids in ORC files: stripes of run-length-encoded ids, row indexes and Bloom filters on document ids.

Documents are dealt by ranges of (doc_id, place in the input) to parts, sorted, encoded with a public byte-level BPE through the
tokenizers library, each ended by END_ID, and written as one ORC file per part, in stripes of some STRIPE_BYTES: ids as integers (ORC's
run-length encoding, version 2), a row index every INDEX_ROWS rows and a Bloom filter on doc_id, so that a
reader skips files by their footers, and stripes and row groups by their statistics and filters. Each row
holds its own offset in its part, so that any stripe can be read alone; the parts' totals, read from one
integer column, give each part's start. Nothing is ordered by one task: Spark samples the ranges'
bounds (of an input that a shuffle makes, once it is kept, so that a lost task finds each row in its place again), rows of one doc_id may go to several parts, and a part is sorted where it lands and written as a stream, so its size
is no task's memory.

The library's pre-tokeniser never lets a token cross from a character into a single space or line feed
before another word, so a text is cut before each of these and the cuts' ids are joined; cuts met before
come from a bounded cache, others go to the library in batches. A text with any other white space goes
to the library whole.

Defined cases: a null or empty text has the end id alone; very long texts are encoded whole; rows with equal doc_id stand next to each
other, in the order of the input's partitions, and come out as often as they came in; rows without a doc_id come first; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import folder, pieces_of, repeatable

END_ID = 2
INDEX_ROWS = 1000
#: Rows of a part, about, and the most parts: beyond, parts grow. A part is a file.
PART_ROWS = 8192
MAX_PARTS = 20_000
STRIPE_BYTES = 4 << 20
#: Cuts that a worker remembers: some 50 MB; beyond, those met once only are forgotten.
CACHE = 500_000

SCHEMA = "part int, doc_id long, offset long, n_tokens int, ids array<int>"
#: White space beside the space and the line feed, and all of it; marks that may end a word; an apostrophe may join the next letter instead.
_OTHER = "\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANK = " \n" + _OTHER
_MARKS = ".,!?;:|$#%&*)"
_WORD = re.compile(rf"([A-Za-zÀ-ÖØ-öø-ɏ]+)([{re.escape(_MARKS)}]*)").fullmatch
#: How often a worker's own process splits: the library's threads would compete with Spark's tasks.
_ENV = {"TOKENIZERS_PARALLELISM": "false"}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Table:
    """Open addressing from keys of 16 bytes, as two words each, to entries; many at a time."""

    def __init__(self, bits: int):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.low, self.high = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.entry = np.full(1 << bits, -1, np.int32)
        self.held = 0

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (low ^ (high * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> self.shift).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The keys' entries, -1 for unknown ones."""
        slot = self._slots(low, high)
        out = self.entry[slot]
        left = np.flatnonzero((out >= 0) & ((self.low[slot] != low) | (self.high[slot] != high)))
        while len(left):
            slot[left] = slot[left] + 1 & self.mask
            at = slot[left]
            out[left] = self.entry[at]
            left = left[(out[left] >= 0) & ((self.low[at] != low[left]) | (self.high[at] != high[left]))]
        return out

    def insert(self, low: np.ndarray, high: np.ndarray, entry: np.ndarray) -> None:
        """Adds keys that are new and distinct."""
        slot, left = self._slots(low, high), np.arange(len(low))
        self.held += len(low)
        while len(left):
            at = slot[left]
            free = self.entry[at] < 0
            self.entry[at[free]] = entry[left[free]]
            won = free & (self.entry[at] == entry[left])
            self.low[at[won]], self.high[at[won]] = low[left[won]], high[left[won]]
            left = left[~won]
            slot[left] = slot[left] + 1 & self.mask


def _keys(names: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first 16 bytes of each name as two words, and which names have no more."""
    upto = np.frombuffer(names.buffers()[1], np.int32, len(names) + 1, names.offset * 4)
    data = np.frombuffer(names.buffers()[2] or b"", np.uint8)[upto[0] : upto[-1]]
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(16, np.uint8)]), 16)[upto[:-1] - upto[0]]
    size = np.diff(upto)
    words = rows.view("<u8") & _CUT[np.minimum(size, 16)]
    return np.ascontiguousarray(words[:, 0]), np.ascontiguousarray(words[:, 1]), size <= 16


#: By length, which bits of the two words are of the name.
_CUT = np.array([np.frombuffer(b"\xff" * n + b"\0" * (16 - n), "<u8") for n in range(17)])


class Encoder:
    """Ids of texts through the library.

    A text whose white space is single spaces and line feeds between words is cut before each. A cut is named
    by its word: "w" stands for " w", "\\nw" for itself, "\\1w" for w at the text's start, "\\2" for the end.
    Names of up to 16 bytes are looked up in a flat table for a batch of texts at once, longer ones in a dictionary.
    """

    def __init__(self, path: str, end_id: int = END_ID, remembered: int = CACHE):
        import os

        os.environ.update(_ENV)
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        #: Texts of special tokens are cut by the library before anything else.
        special = "".join("|" + re.escape(t.content) for t in self.library.get_added_tokens_decoder().values())
        self.uneven = rf"[{_BLANK}][{_BLANK}]|^[{_BLANK}]|[{_BLANK}]$|[{_OTHER}\x00-\x03]{special}"
        self.batch = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        one = Tokenizer.from_file(path)
        one.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        one.model._resize_cache(0)  # it is never asked for a word twice in a row
        self.single = getattr(one, "encode_batch_fast", one.encode_batch)
        self.remembered = remembered
        self.bits = max(8, (2 * remembered).bit_length())
        self.end_id = end_id
        self._begin()

    def by_library(self, texts: list[str], single: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has. single: each is one word for the pre-tokeniser, which needn't look for its parts."""
        flat, size = array("I"), []
        for e in (self.single if single else self.batch)(texts, add_special_tokens=False):
            ids = e.ids
            flat.extend(ids)
            size.append(len(ids))
        return np.array(flat, dtype="<u4"), np.array(size, dtype=np.int32)

    def _begin(self) -> None:
        self.table, self.long = _Table(self.bits), {}
        self.low, self.high = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.ids, self.size, self.first = np.empty(0, "<u4"), np.empty(0, np.int32), np.empty(0, np.int32)
        self.hits, self.short = np.empty(0, np.int32), np.empty(0, bool)
        self._add(["\2"], np.array([self.end_id], "<u4"), np.array([1], np.int32))

    def _forget(self) -> None:
        """Leaves what has been met more than once."""
        names = {i: n for n, i in self.long.items()}
        kept = np.flatnonzero(self.hits > 1)
        kept = kept[kept > 0]
        if len(kept) > self.remembered // 2:
            kept = kept[:0]
        low, high, ids, size = self.low[kept], self.high[kept], self._gathered(kept), self.size[kept]
        long = [names.get(i) for i in kept.tolist()]
        self._begin()
        self._take(low, high, np.array([n is None for n in long], bool), long, ids, size)

    def _gathered(self, entries: np.ndarray) -> np.ndarray:
        """The entries' ids, one after the other."""
        size = self.size[entries]
        upto = np.cumsum(size, dtype=np.int32)
        place = np.repeat(self.first[entries] - (upto - size), size)
        place += np.arange(len(place), dtype=np.int32)
        return self.ids[place]

    def _take(self, low: np.ndarray, high: np.ndarray, short: np.ndarray, names: list, ids: np.ndarray, size: np.ndarray) -> None:
        entry = np.arange(len(self.size), len(self.size) + len(size), dtype=np.int32)
        if (need := 2 * (self.table.held + int(short.sum()))) > len(self.table.entry):  # half empty, so that a search is short
            own = np.flatnonzero(self.short)
            self.table = _Table(need.bit_length())
            self.table.insert(self.low[own], self.high[own], own.astype(np.int32))
        self.short = np.concatenate([self.short, short])
        self.table.insert(low[short], high[short], entry[short])
        self.long.update((names[i], int(entry[i])) for i in np.flatnonzero(~short).tolist())
        self.low, self.high = np.concatenate([self.low, low]), np.concatenate([self.high, high])
        self.first = np.concatenate([self.first, np.cumsum(size, dtype=np.int32) - size + np.int32(len(self.ids))])
        self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size.astype(np.int32)])
        self.hits = np.concatenate([self.hits, np.zeros(len(size), np.int32)])

    def _add(self, names: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        if names:
            low, high, short = _keys(pa.array(names, pa.string()))
            self._take(low, high, short, names, ids, size)

    def _find(self, names: pa.StringArray) -> np.ndarray:
        if not len(names):
            return np.empty(0, np.int32)
        low, high, short = _keys(names)
        out = self.table.find(low, high)
        if len(more := np.flatnonzero(~short)):
            own = names.take(pa.array(more)).to_pylist()
            out[more] = np.fromiter(map(self.long.get, own, repeat(-1)), dtype=np.int32, count=len(own))
        return out

    def _learn(self, names: Iterable[str]) -> None:
        """Adds the ids of distinct names that aren't known; a word's and its closing marks' are joined: no token has both."""
        words, others, ended, parts = [], [], [], {}
        for name in names:
            m = _WORD(name)
            if m is None:
                others.append(name)
            elif m.end(1) == len(name):
                words.append(name)
            else:
                word, marks = m[1], "\1" + m[2]
                ended.append((name, word, marks))
                parts[word], parts[marks] = True, False
        if parts:
            own = list(parts)
            met = set(words)
            met.update(others)
            for part, found in zip(own, self._find(pa.array(own, pa.string())).tolist(), strict=True):
                if found < 0 and part not in met:
                    (words if parts[part] else others).append(part)
        for own, single in ((words, True), (others, False)):
            self._add(own, *self.by_library([x[1:] if x[0] == "\1" else x if x[0] == "\n" else " " + x for x in own], single))
        if ended:
            pairs = self._find(pa.array([x for e in ended for x in e[1:]], pa.string()))
            self._add([e[0] for e in ended], self._gathered(pairs), self.size[pairs].reshape(-1, 2).sum(axis=1))

    def _even(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """As encode, of texts that may be cut."""
        marked = pc.binary_join_element_wise("\1", pc.replace_substring(texts, "\n", " \n"), " \2", "")
        lists = pc.split_pattern(marked, " ")
        names = lists.values
        entry = self._find(names)
        if len(unmet := np.flatnonzero(entry < 0)):
            unknown = names.take(pa.array(unmet))
            self._learn(dict.fromkeys(unknown.to_pylist()))
            entry[unmet] = self._find(unknown)
        self.hits += np.bincount(entry, minlength=len(self.hits)).astype(np.int32)
        upto = np.r_[0, np.cumsum(self.size[entry], dtype=np.int32)]
        return self._gathered(entry), upto[lists.offsets.to_numpy()].astype(np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, each followed by the end's, and where each text's ids begin (and the last end)."""
        if len(self.size) > self.remembered:
            self._forget()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        uneven = pc.match_substring_regex(texts, self.uneven)
        whole = texts.filter(uneven).to_pylist()
        if not whole:
            return self._even(texts)
        ids, upto = self._even(texts.filter(pc.invert(uneven)))
        flat, size = self.by_library(whole)
        ends = np.cumsum(size)
        even = iter([ids[a:z] for a, z in zip(upto, upto[1:], strict=False)])
        odd = iter([np.r_[flat[z - n : z], np.uint32(self.end_id)] for n, z in zip(size, ends, strict=True)])
        rows = [next(odd if u else even) for u in uneven.to_pylist()]
        return np.concatenate(rows).astype("<u4"), np.cumsum([0, *map(len, rows)]).astype(np.int32)


@cache
def encoder(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id)


def _encoded(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, end_id)
        part, offset = None, 0  # a part's rows come together and in order
        for b in pieces_of(batches, 2):
            flat, upto = own.encode(b.column(2))
            n = np.diff(upto)
            offsets = []
            for p, k in zip(b.column(0).to_pylist(), n.tolist(), strict=True):
                if p != part:
                    part, offset = p, 0
                offsets.append(offset)
                offset += k
            ids = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(flat.view("<i4")))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(offsets, pa.int64()), pa.array(n.astype(np.int32)), ids],
                names=["part", "doc_id", "offset", "n_tokens", "ids"],
            )

    return run


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, part_rows: int = PART_ROWS, stripe_bytes: int = STRIPE_BYTES
) -> None:
    """Writes docs (doc_id, text) as ORC files under path, in ascending order of doc_id from part to part."""
    docs = repeatable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumn("place", F.monotonically_increasing_id())
    n_parts = min(MAX_PARTS, -(-docs.count() // part_rows)) or 1
    placed = docs.repartitionByRange(n_parts, "doc_id", "place").sortWithinPartitions("doc_id", "place").select(F.spark_partition_id().alias("part"), "doc_id", "text")
    (
        placed.mapInArrow(_encoded(tokenizer or tokenizer_path(), end_id), SCHEMA)
        .write.option("orc.compress", "SNAPPY")
        .option("orc.row.index.stride", str(INDEX_ROWS))
        .option("orc.create.index", "true")
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.rows.between.memory.checks", str(INDEX_ROWS))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of each document under path; filters on doc_id reach the files' statistics and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    total = rows.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("n"))
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over MAX_PARTS rows at most
    starts = total.select("part", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(3)
        flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        ends = lists.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:z]) for a, z in zip(ends, ends[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files written."""
    spark = docs.sparkSession
    path = folder(spark, "tokens")
    write_tokens(docs, path)
    return read_tokens(spark, path).mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
