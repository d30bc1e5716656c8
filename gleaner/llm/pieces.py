"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The vocabulary (pieces, scores, kinds) is read from a public model file, whose path is a parameter. A text
becomes the model's form (a space before it if the model asks for one, U+2581 for each space), and
the best segmentation is the one whose pieces' scores have the greatest sum. At each position the
automaton's state gives, along its output links, all pieces that end there; each relaxes the best score
of that position from the best one where it starts. A character that no piece covers costs the
unknown score and is written as its UTF-8 bytes' pieces.

No piece holds U+2581 after another character, and none of this model holds a line feed, so every
segmentation has a border before each run of spaces and around each line feed. So the texts are cut there
and the automaton runs over the cuts; those met before come from a bounded cache. Both give the
segmentation of the whole text. A vocabulary with such pieces isn't cut there.

The file's own kind is BPE, whose scores are negative ranks; this operator takes them as they stand,
as a unigram model's, so its pieces are those of the same file with its kind set to unigram.

Defined cases: a null or empty text has no pieces and decodes to the empty text; very long texts are encoded whole; of segmentations
that tie, the one whose last piece is longest is taken; a text's own U+2581 decodes to a space, as in the library; repeated rows come
out as often as they came in; an empty table gives no rows; further columns are kept by ``with_pieces``, which replaces columns named as its own.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gleaner.llm.common import pieces_of

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Below the least score of a normal piece by this: a character without a piece.
UNKNOWN_PENALTY = 10.0
#: Cuts of a generation, two of which a worker remembers: some 60 MB each. Rare ones are segmented again when they come back.
CACHE = 250_000


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol buffer message, as number and raw value."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + n]
            at += n


class Vocabulary:
    """Pieces of a model file: texts, scores and kinds by id, and the normaliser's switches."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.texts, self.scores, self.kinds = [], [], []
        self.prefix, self.squeeze = True, True
        self.unigram = True  # the model's kind: if it isn't, scores are merge ranks
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.texts.append(own.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                self.unigram = dict(_fields(value)).get(3, 1) == 1
            elif number == 3:
                own = dict(_fields(value))
                self.prefix, self.squeeze = bool(own.get(3, 1)), bool(own.get(4, 1))
                if own.get(2):
                    raise ValueError("models with a character map aren't supported")
        if self.squeeze:
            raise ValueError("models that remove white space aren't supported")
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER)]
        self.least = min((self.scores[i] for i in usable), default=0.0)
        self.usable = usable
        inner = any(SPACE in self.texts[i].lstrip(SPACE) for i in usable)
        lines = any("\n" in self.texts[i] for i in usable)
        #: Cuts of a text in the model's form with spaces still as spaces.
        self.cutter = re.compile(r"(?s).+" if inner else r" *[^ ]+| +" if lines else r" *[^ \n]+| +|\n")

    def automaton(self, weight) -> ahocorasick.Automaton:
        """Aho-Corasick over the usable pieces; each match gives the piece's length, id and weight(id)."""
        a = ahocorasick.Automaton()
        for i in self.usable:
            a.add_word(self.texts[i], (len(self.texts[i]), i, weight(i)))
        a.make_automaton()
        return a

    def cuts(self, text: str) -> list[str]:
        """The text's cuts, whose segmentations join to that of the whole."""
        if not text:
            return []
        return self.cutter.findall(" " + text if self.prefix else text)

    def spelled(self, char: str) -> list[int]:
        """Ids of a character that no piece covers."""
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in char.encode()]


class Codec:
    def __init__(self, path: str, remembered: int = CACHE):
        self.vocabulary = v = Vocabulary(path)
        self.unknown_score = v.least - UNKNOWN_PENALTY
        self.matches = v.automaton(lambda i: v.scores[i]).iter
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.chars = 0
        self.remembered = remembered

    def segment(self, cut: str) -> list[int]:
        """Ids of the best segmentation of a text in the model's form; of equal ones, that whose last piece is longest."""
        n = len(cut)
        best = [0.0] + [-math.inf] * n
        start = [0] * (n + 1)
        piece_to = [-1] * (n + 1)
        at, covered = 0, True  # the position being relaxed, and whether a one-character piece ends there

        def unknown(p: int) -> None:
            if (value := best[p - 1] + self.unknown_score) > best[p]:
                best[p], start[p], piece_to[p] = value, p - 1, -1

        for end, (size, piece, score) in self.matches(cut):
            end += 1
            while at < end:
                if not covered:
                    unknown(at)
                at, covered = at + 1, False
            if (value := best[end - size] + score) > best[end]:
                best[end], start[end], piece_to[end] = value, end - size, piece
            covered = covered or size == 1
        while at <= n:
            if not covered:
                unknown(at)
            at, covered = at + 1, False
        out: list[int] = []
        at = n
        while at:
            out += [piece_to[at]] if piece_to[at] >= 0 else self.vocabulary.spelled(cut[start[at] : at])[::-1]
            at = start[at]
        return out[::-1]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        if len(self.known) > self.remembered or self.chars > 16 * self.remembered:  # what's met again comes back from the last generation
            self.known, self.older, self.chars = {}, self.known, 0
        known, older = self.known, self.older
        cuts = [self.vocabulary.cuts(t or "") for t in texts]
        for cut in {c for own in cuts for c in own if c not in known}:
            got = older.get(cut)
            if got is None:
                got = np.array(self.segment(cut.replace(" ", SPACE)), dtype="<i4").tobytes()
            known[cut] = got
            self.chars += len(cut)
        get = known.__getitem__
        return [b"".join(map(get, own)) for own in cuts]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        v = self.vocabulary
        if not hasattr(self, "spell"):
            value = {i: bytes([b]) for b, i in v.bytes.items()}
            self.spell = [
                value.get(i, b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else t.replace(SPACE, " ").encode())
                for i, (t, k) in enumerate(zip(v.texts, v.kinds, strict=True))
            ]
        text = b"".join(map(self.spell.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if v.prefix and text.startswith(" ") else text


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def with_pieces(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """docs and piece_ids (array of int), n_pieces (long), decoded (string): the ids' text, equal to the input's but for U+2581."""
    path = model or model_path()
    schema = T.StructType([f for f in docs.schema.fields if f.name not in ("piece_ids", "n_pieces", "decoded")])
    names = list(schema.names)
    schema = schema.add("piece_ids", T.ArrayType(T.IntegerType())).add("n_pieces", "long").add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in pieces_of(batches, text):
            packed = own.encode_all(b.column(text).to_pylist())
            offsets = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
            flat = np.frombuffer(b"".join(packed), dtype="<i4")
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            n = pa.array(np.diff(offsets).astype(np.int64))
            decoded = pa.array([own.decode(flat[a:z].tolist()) for a, z in zip(offsets, offsets[1:], strict=False)], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), ids, n, decoded], names=schema.names)

    return docs.select(names).mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the ids themselves, their number, their CRC-32 as little-endian integers, and whether they decode to the text."""
    path = model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in pieces_of(batches, 1):
            texts = b.column(1).to_pylist()
            packed = own.encode_all(texts)
            offsets = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
            flat = np.frombuffer(b"".join(packed), dtype="<i4")
            back = [own.decode(flat[a:z].tolist()) for a, z in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    pa.array(np.diff(offsets).astype(np.int64)),
                    pa.array([zlib.crc32(p) for p in packed], pa.int64()),
                    pa.array([x == (t or "").replace(SPACE, " ") for x, t in zip(back, texts, strict=True)]),
                ],
                names=["doc_id", "piece_ids", "n_pieces", "ids_crc32", "decodes"],
            )

    chosen = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(run, "doc_id long, piece_ids array<int>, n_pieces long, ids_crc32 long, decodes boolean")
