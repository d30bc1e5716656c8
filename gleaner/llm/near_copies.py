"""SimHash near-duplicates by similarity: texts whose sets of SHINGLE-word shingles have a Jaccard similarity of 4/5 at least.

The Gray-order index of ``simhash`` finds the candidates. A text's fingerprint has WORDS * 64 bits, over its different
shingles; two texts this similar differ in some 15 % of them, unrelated ones in half, and RADIUS lies between: a
pair at the threshold is beyond it once in some ten million times. Bits of so wide a ball route nothing, so the index's upper nodes
are shingles: the shingles of all texts have one order, and two sets this similar share one of the first
n - ceil(4n/5) + 1 of each, so a text lies under these shingles' nodes alone. Any order gives the same pairs; here shingles
that are frequent in a bounded sample come last, so that common phrases bring few texts together. Nodes with the same texts are
one node; a node of more than NODE_ROWS texts is searched as pairs of blocks. Below, texts are sorted
by Gray rank and parents with shared bits are left as soon as the differences exceed RADIUS (``simhash.search``), which gives a
forest and not pairs.

Candidates that hang together make a cluster, whose texts' whole sets are then compared: exactly, in blocks of CHECKED
shingles, and only with texts that aren't joined yet. Of a cluster of several blocks each block is compared in itself
first; then what isn't joined to the cluster's largest group by that is compared with all its blocks. Each block gives a
forest of links; groups are the links' connected components. Texts of equal words are one text in all this.

Defined cases: words are split at ASCII white space, A-Z lowered; a text of fewer than SHINGLE words is one shingle; texts
that are null or have no words are equal; very long texts are read whole; rows without a doc_id and rows that repeat one are
grouped by their texts like others; of rows that tie (equal doc_id and text) one stays; an empty table gives no rows; further columns
are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import checkpointed, dropped, landed, pieces_of
from gleaner.llm.simhash import components, gray_order, search

SHINGLE = 5
#: The least similarity of linked texts, as a fraction of whole numbers.
LIKE, OF = 4, 5
#: 64-bit words of a fingerprint, and the bits in which candidates may differ.
WORDS, RADIUS = 4, 80
#: Texts that the order of shingles is taken from, about, and the most shingles it puts last.
SAMPLE_ROWS = 20_000
HOT_SHINGLES = 200_000
#: Texts of a node that is searched as it is, and rows of whole nodes that a task searches at once.
NODE_ROWS = 8_192
BATCH_ROWS = 40_000
#: Shingles of a block of texts that are compared as they are.
CHECKED = 500_000

_PRINT = [f"p{k}" for k in range(WORDS)]


def shingles(text: str | None) -> tuple[int, np.ndarray]:
    """A hash of the text's words, and the sorted hashes of its different shingles."""
    words = (text or "").encode().lower().split()  # on bytes, these two know A-Z and ASCII white space only
    flat = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    node = digest(flat)
    if len(words) <= SHINGLE:
        return node, np.array([digest(flat, 42)] if words else [], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - SHINGLE].tolist()]
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    return node, np.unique(np.array([digest(flat[a:b], 42) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64))


def fingerprint(found: np.ndarray) -> np.ndarray:
    """WORDS words of bits, each 1 if it's set in over half the shingles' hashes; a shingle's further words are mixed from its first."""
    count = np.zeros(64 * WORDS, dtype=np.int64)
    for i in range(0, len(found), 1 << 13):
        part = found[i : i + (1 << 13), None] + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        part = (part ^ part >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        part = (part ^ part >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        part ^= part >> np.uint64(31)
        count += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8 * WORDS), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(count * 2 > len(found), bitorder="little").view("<u8")


def _row_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def _hot(docs: DataFrame) -> np.ndarray:
    """Shingles that occur in several texts of a sample, the rarer ones first."""
    part = max(1, docs.count() // SAMPLE_ROWS)
    sample = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(part)) == 0).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches, "text"):
            for t in b.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py())[1].view(np.int64))], names=["key"])

    counts = sample.mapInArrow(run, "key long").groupBy("key").count().filter("count > 2")
    got = counts.orderBy(F.desc("count"), "key").limit(HOT_SHINGLES).select("key").toArrow()
    return got.column("key").to_numpy()[::-1].astype(np.int64).view(np.uint64)


def _prints(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, node, n (different shingles), the fingerprint's words and keys (the first shingles in the order) of each row."""
    hot = _hot(docs)
    order = np.argsort(hot)
    places, hot = (order + 1).astype(np.int64), hot[order]

    def prefix(found: np.ndarray) -> np.ndarray:
        n = len(found)
        first = n - (n * LIKE + OF - 1) // OF + 1 if n else 0
        if len(hot):
            at = np.minimum(np.searchsorted(hot, found), len(hot) - 1)
            found = found[np.argsort(np.where(hot[at] == found, places[at], 0), kind="stable")]
        return found[:first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches, "text"):
            found = [shingles(t.as_py()) for t in b.column("text")]
            keys = [prefix(s) for _, s in found]
            bits = np.stack([fingerprint(s) for _, s in found]).view(np.int64)
            own = [
                pa.array(np.array([node for node, _ in found], dtype=np.uint64).view(np.int64)),
                pa.array([len(s) for _, s in found], pa.int64()),
                *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(WORDS)),
                pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys).view(np.int64))),
            ]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), *own], names=["doc_id", "row_key", "node", "n", *_PRINT, "keys"])

    chosen = docs.select("doc_id", _row_key(F.col("text")).alias("row_key"), "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_key long, node long, n long, {''.join(f'{p} long, ' for p in _PRINT)}keys array<long>"
    return chosen.mapInArrow(run, schema)


def _whole(batches: Iterator[pa.RecordBatch], by: int, full: Callable[[pa.Table], bool]) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by the first ``by`` columns, each handed on as soon as it's full."""
    held: pa.Table | None = None
    for b in batches:
        if not len(b):
            continue
        held = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b])
        if not full(held):
            continue
        begins = np.flatnonzero(_borders(held, by))
        if begins[-1]:  # the last group may go on in the next batch
            yield held.slice(0, begins[-1])
            held = held.slice(begins[-1])
    if held is not None and len(held):
        yield held


def _borders(rows: pa.Table, by: int) -> np.ndarray:
    """Where groups begin."""
    out = np.zeros(len(rows), bool)
    out[:1] = True
    for c in rows.columns[:by]:
        x = c.to_numpy()
        out[1:] |= x[1:] != x[:-1]
    return out


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sig, i, j, node, n and fingerprint, sorted by the first three -> a forest over the nodes within RADIUS whose sizes allow the similarity."""
    for rows in _whole(batches, 3, lambda held: len(held) >= BATCH_ROWS):
        group = np.cumsum(_borders(rows, 3))
        fps = np.column_stack([rows.column(p).to_numpy() for p in _PRINT]).view(np.uint64)
        order = gray_order(group, fps)
        node, n = rows.column("node").to_numpy()[order], rows.column("n").to_numpy()[order]
        label = search(group[order], fps[order], RADIUS, lambda q, c: (n[q] * LIKE <= n[c] * OF) & (n[c] * LIKE <= n[q] * OF))
        linked = np.flatnonzero(label != np.arange(len(label)))
        yield _edges(node[linked], node[label[linked]])


def _forest(node: np.ndarray, root: np.ndarray, ask: np.ndarray, fps: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join those of the texts that are similar enough and have different roots, of which one asks."""
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    node, ask, fps, n = node[order], ask[order], fps[order], n[order]
    label = np.unique(root[order], return_inverse=True)[1]
    if label.max() == 0:
        return []
    upto = np.r_[0, np.cumsum(n)]
    codes = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    mark = np.zeros(int(codes.max()) + 1, bool)
    out = []
    for a in np.flatnonzero(ask).tolist():
        low, high = np.searchsorted(n, [-(-n[a] * LIKE // OF), n[a] * OF // LIKE + 1])
        other = np.arange(low, high)
        other = other[(label[low:high] != label[a]) & ((other > a) | ~ask[low:high])]
        if not len(other):
            continue
        other = other[np.bitwise_count(fps[other] ^ fps[a]).sum(axis=1, dtype=np.int64) <= RADIUS]
        if not len(other):
            continue
        size = n[other]
        ends = np.cumsum(size)
        mark[codes[upto[a] : upto[a + 1]]] = True
        both = np.add.reduceat(mark[codes[np.repeat(upto[other] - (ends - size), size) + np.arange(ends[-1])]], ends - size, dtype=np.int64)
        mark[codes[upto[a] : upto[a + 1]]] = False
        found, first = np.unique(label[other[OF * both >= LIKE * (n[a] + size - both)]], return_index=True)
        if len(found):
            out += [(int(node[a]), int(node[b])) for b in other[OF * both >= LIKE * (n[a] + size - both)][first]]
            label[np.isin(label, found)] = label[a]
    return out


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cluster, i, j, node, root, ask, fingerprint and found (the set's bytes), sorted by the first three -> links of texts that are similar enough."""
    for rows in _whole(batches, 3, lambda held: held.nbytes >= 8 * CHECKED):
        begins = np.flatnonzero(_borders(rows, 3))
        node, root = rows.column("node").to_numpy(), rows.column("root").to_numpy()
        ask = rows.column("ask").to_numpy()
        fps = np.column_stack([rows.column(p).to_numpy() for p in _PRINT]).view(np.uint64)
        found = rows.column("found")
        links: list[tuple[int, int]] = []
        for a, z in zip(begins, [*begins[1:], len(rows)], strict=True):
            if z - a > 1:
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in found.slice(a, z - a)]
                links += _forest(node[a:z], root[a:z], ask[a:z], fps[a:z], sets)
        both = np.array(links, dtype=np.int64).reshape(-1, 2)
        yield _edges(np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1]))


_PAIR = "a long, b long"
_CHECKED = ["cluster", "i", "j", "node", "root", "ask", *_PRINT, "found"]


def _compared(rows: DataFrame) -> DataFrame:
    placed = rows.select(_CHECKED).repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return placed.mapInArrow(_alike, _PAIR)


def _candidate_links(prints: DataFrame, facts: DataFrame) -> DataFrame:
    """Edges (a, b) of nodes: a forest of each node of the index."""
    keys = prints.select("node", "keys").dropDuplicates(["node"]).select(F.explode("keys").alias("key"), "node")
    size = keys.groupBy("key").agg(F.count("*").alias("many"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    size = size.filter("many > 1").select("key", "many", F.xxhash64("many", "x", "y").alias("sig"))  # equal for shingles of the same texts
    met = keys.join(size, "key").select("sig", "many", "node").distinct()
    blocks = F.ceil(F.col("many") / NODE_ROWS)
    block = F.pmod(F.xxhash64("node", "sig"), blocks)
    # A block's own pairs are looked at wherever it meets another.
    other = F.when(blocks == 1, F.array(block)).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda x: x != block))
    dealt = met.select("sig", "node", block.alias("own"), F.explode(other).alias("other"))
    dealt = dealt.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node").join(facts, "node")
    dealt = dealt.select("sig", "i", "j", "node", "n", *_PRINT).repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return dealt.mapInArrow(_candidates, _PAIR).distinct()


def _sets(docs: DataFrame, prints: DataFrame, clusters: DataFrame) -> DataFrame:
    """clusters (node, cluster) with n, the fingerprint and found, the bytes of the node's whole set."""
    rows = prints.join(clusters, "node").groupBy("node", "cluster", "n", *_PRINT).agg(F.min(F.struct("doc_id", "row_key")).alias("row"))
    rows = rows.select("node", "cluster", "n", *_PRINT, F.col("row.doc_id").alias("at_id"), F.col("row.row_key").alias("at_key"))
    names = ["node", "cluster", "n", *_PRINT]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches, "text"):
            found = [shingles(t.as_py())[1].tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(found, pa.binary())], names=[*names, "found"])

    texts = docs.select("doc_id", "text")
    same = texts["doc_id"].eqNullSafe(rows["at_id"]) & (_row_key(texts["text"]) == rows["at_key"])
    one = texts.join(rows, same).select(*names, "text").dropDuplicates(["node"])
    return one.mapInArrow(sets, ", ".join(f"{c} long" for c in names) + ", found binary")


def _links(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Edges (a, b) of nodes that join just the nodes whose sets are similar enough."""
    facts = prints.groupBy("node").agg(*(F.max(c).alias(c) for c in ("n", *_PRINT)))
    joined = components(_candidate_links(prints, facts)).select(F.col("a").alias("node"), F.col("b").alias("cluster"))
    clusters = joined.unionByName(joined.select(F.col("cluster").alias("node"), "cluster").distinct())
    held = landed(_sets(docs, prints, clusters), "shingle-sets")
    parts = held.groupBy("cluster").agg(F.ceil(F.sum("n") / CHECKED).alias("parts"))
    placed = held.join(parts, "cluster").withColumn("j", F.pmod(F.xxhash64("node"), "parts"))
    first = checkpointed(_compared(placed.select("*", F.col("j").alias("i"), F.col("node").alias("root"), F.lit(True).alias("ask"))))
    large = checkpointed(parts.filter("parts > 1"))
    if large.isEmpty():
        dropped(held)
        return first
    rooted = components(first).select(F.col("a").alias("node"), F.col("b").alias("root"))
    slim = held.select("cluster", "node", "n").join(large, "cluster").join(rooted, "node", "left").select("cluster", "node", "n", "parts", F.coalesce("root", "node").alias("root"))
    slim = checkpointed(slim)
    main = slim.groupBy("cluster", "root").agg(F.count("*").alias("many")).groupBy("cluster").agg(F.max(F.struct("many", "root")).alias("main"))
    slim = slim.join(main.select("cluster", F.col("main.root").alias("main")), "cluster")
    asking = slim.filter("root <> main").groupBy("cluster").agg(F.ceil(F.sum("n") / CHECKED).alias("askers"))
    slim = slim.join(asking, "cluster").select("node", "root", (F.col("root") != F.col("main")).alias("asks"), "askers", "parts")
    i, j = F.pmod(F.xxhash64("node", F.lit(1)), "askers"), F.pmod(F.xxhash64("node"), "parts")
    up_to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    as_other = F.transform(up_to("askers"), lambda x: F.struct(x.alias("i"), j.alias("j"), F.lit(False).alias("ask")))
    as_asker = F.transform(up_to("parts"), lambda x: F.struct(i.alias("i"), x.alias("j"), F.lit(True).alias("ask")))
    at = F.concat(as_other, F.when(F.col("asks"), as_asker).otherwise(F.array().cast("array<struct<i:bigint,j:bigint,ask:boolean>>")))
    second = held.join(slim, "node").select("*", F.explode(at).alias("at")).select("cluster", "at.*", "node", "root", *_PRINT, "found")
    out = checkpointed(first.unionByName(_compared(second)))
    dropped(held)
    return out


def roots(docs: DataFrame) -> DataFrame:
    """doc_id, row_key (a hash of the text) and root of each row of docs: rows of one root are near copies, by links."""
    prints = landed(_prints(docs), "shingles")
    joined = components(_links(docs, prints)).select(F.col("a").alias("node"), F.col("b").alias("root"))
    return prints.join(joined, "node", "left").select("doc_id", "row_key", F.coalesce("root", "node").alias("root"))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that stand for their groups, one of each: the least by (doc_id, nulls last; hash of the text)."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    heads = roots(docs).groupBy("root").agg(F.min(order).alias("head"))
    heads = heads.select(F.col("head.doc_id").alias("head_id"), F.col("head.row_key").alias("head_key"))
    key = "_" * (1 + max(map(len, docs.columns)))  # a name that docs doesn't have
    keyed = docs.withColumn(key, _row_key(F.col("text")))
    kept = keyed.join(heads, keyed["doc_id"].eqNullSafe(heads["head_id"]) & (keyed[key] == heads["head_key"]), "left_semi")
    return kept.dropDuplicates(["doc_id", key]).select(docs.columns)
