"""SimHash near-duplicates: fingerprints, a Gray-order hierarchical index over them, and linked groups.

Two fingerprints of 64 bits that differ in at most RADIUS = 3 bits agree on one of four blocks of 16
bits. So the index's upper nodes are (mask, pattern) pairs: one node for each value of each block, and a
fingerprint lies under four of them. Nodes are dealt to tasks by their key, so no task or broadcast
holds all fingerprints. A node with more than NODE_ROWS fingerprints is replaced by finer nodes: the
bits outside its mask are cut into four blocks again, by the same argument, until it is small enough
or has so few free bits that it must be. Equal fingerprints count once before any of this, so a group of
copies of any size is one row.

Inside a node the fingerprints are sorted by Gray rank, so that neighbours share most bits. Each run of
FANOUT neighbours makes a parent that holds the bits all of them share (mask and pattern); parents are
grouped in turn up to the node. Each fingerprint descends this tree: a child adds the differences in the
bits it shares beyond its parent's, and a whole group is left as soon as the sum exceeds RADIUS.

Links found are united within the task, so a dense node yields a row per fingerprint and not per pair.
The forests of all nodes meet in connected components, found by alternating large-star and
small-star steps.

Defined cases: a text that is null or has no words has fingerprint zero, which is linked like any other;
very long texts are read whole; a row with a null doc_id keeps its fingerprint and gets its group's least doc_id (null if there's
none), as do rows that tie for it; repeated rows come out as often as they came in; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import checkpointed, landed

RADIUS = 3
SHINGLE = 3
#: Fingerprints in a node that is searched as it is; larger nodes are refined.
NODE_ROWS = 20_000
#: A node with this many free bits holds 2 ** FREE_BITS fingerprints at most and isn't refined.
FREE_BITS = 14
FANOUT = 8
#: Rows of whole nodes that a task searches at once, and pairs of fingerprint and group it looks at in a step.
BATCH_ROWS = 40_000
STEP_PAIRS = 2_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it's set in over half the shingles' hashes."""
    words = (text or "").encode().lower().split()  # on bytes, these two know A-Z and ASCII white space only
    if not words:
        return 0
    flat = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(flat, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(flat[a:b], 42) for a, b in zip(starts, stops, strict=True)], dtype="<u8")
    count = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), dtype=np.uint64, count=len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each fingerprint, a 64-bit word or a row of them, in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    for k in range(1, x.shape[1] if x.ndim == 2 else 1):  # a word's parity goes on in the next
        x[:, k] ^= -(x[:, k - 1] & np.uint64(1))
    return x


def gray_order(node: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """The order of rows by node and then Gray rank."""
    rank = gray_rank(fps)
    return np.lexsort((*(rank[:, k] for k in range(rank.shape[1] - 1, -1, -1)), node) if rank.ndim == 2 else (rank, node))


def _roots(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites a[i] with b[i] in label, where each element's label is its set's least element."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        if not len(a):
            return
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _tree(node: np.ndarray, fps: np.ndarray) -> list[tuple]:
    """Levels from the leaves up, as (mask, pattern, first child, end child); the last has one group per node."""
    n = len(fps)
    full = np.full(fps.shape, ~np.uint64(0))
    levels = [(full, fps, np.arange(n), np.arange(n) + 1)]
    every, none = fps, fps  # the AND and the OR of each group's members
    owner = node
    while True:
        first_of_owner = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        if len(first_of_owner) == len(owner) and len(levels) > 1:
            return levels
        size = np.diff(np.r_[first_of_owner, len(owner)])
        place = np.arange(len(owner)) - np.repeat(first_of_owner, size)
        starts = np.flatnonzero(place % FANOUT == 0)
        every = np.bitwise_and.reduceat(every, starts, axis=0)
        none = np.bitwise_or.reduceat(none, starts, axis=0)
        mask = ~(every ^ none)
        levels.append((mask, every & mask, starts, np.r_[starts[1:], len(owner)]))
        owner = owner[starts]


def search(node: np.ndarray, fps: np.ndarray, radius: int = RADIUS, fits: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """For fingerprints in gray_order, words or rows of words: each one's label, the least position it's linked to in its node.

    fits: which pairs of positions may be linked at all.
    """
    fps = fps.reshape(len(fps), -1)
    levels = _tree(node, fps)
    label = np.arange(len(fps))
    top = levels[-1]
    root = np.repeat(np.arange(len(top[0])), np.diff(np.r_[np.flatnonzero(np.r_[True, node[1:] != node[:-1]]), len(node)]))
    last = [levels[0][3]]  # end of the leaves below each group
    for _, _, _, end in levels[1:]:
        last.append(last[-1][end - 1])

    def differences(q, group, level, above, seen):
        mask, pattern, _, _ = levels[level]
        beyond = mask[group] if above is None else mask[group] & ~levels[level + 1][0][above]
        return seen + np.bitwise_count((fps[q] ^ pattern[group]) & beyond).sum(axis=1, dtype=np.uint16)

    stack = []
    for lo in range(0, len(fps), STEP_PAIRS // FANOUT):
        q = np.arange(lo, min(len(fps), lo + STEP_PAIRS // FANOUT))
        seen = differences(q, root[q], len(levels) - 1, None, np.zeros(len(q), np.uint16))
        stack.append((len(levels) - 1, q, root[q], seen))
    while stack:
        level, q, group, seen = stack.pop()
        if len(q) > STEP_PAIRS // FANOUT:
            half = len(q) // 2
            stack += [(level, q[half:], group[half:], seen[half:]), (level, q[:half], group[:half], seen[:half])]
            continue
        _, _, first, end = levels[level]
        many = end[group] - first[group]
        at = np.repeat(np.arange(len(q)), many)
        child = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + first[group][at]
        seen = differences(q[at], child, level - 1, group[at], seen[at])
        keep = (seen <= radius) & (last[level - 1][child] - 1 > q[at])  # each pair once, the later one as the leaf
        q, child, seen = q[at][keep], child[keep], seen[keep]
        if level == 1:
            if fits:
                keep = fits(q, child)
                q, child = q[keep], child[keep]
            _roots(label, q, child)
        elif len(q):
            stack.append((level - 1, q, child, seen))
    return label


def _links_in_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mask, pattern, fp, sorted by mask and pattern -> the edges of a forest that joins what each node links."""

    def found(mask, pattern, fps):
        fps = fps.view(np.uint64)
        node = np.cumsum(np.r_[False, (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])])  # rows come sorted
        order = gray_order(node, fps)
        node, fps = node[order], fps[order]
        label = search(node, fps)
        linked = label != np.arange(len(label))
        a, b = fps[linked].view(np.int64), fps[label[linked]].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held = [np.empty(0, np.int64)] * 3
    for batch in batches:
        held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
        if len(held[0]) >= BATCH_ROWS:
            begins = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1
            if len(begins):  # the last node may go on in the next batch
                yield found(*(h[: begins[-1]] for h in held))
                held = [h[begins[-1] :] for h in held]
    if len(held[0]):
        yield found(*held)


def _blocks(mask: int) -> list[int]:
    """The masks of the four finer nodes below one: its bits and one of four blocks of the others."""
    free = [i for i in range(64) if not mask >> i & 1]
    cut = [round(len(free) * k / (RADIUS + 1)) for k in range(RADIUS + 2)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame) -> DataFrame:
    """fps: distinct values in column fp. Edges (a, b) that join exactly the fingerprints within RADIUS of each other."""

    def under(df: DataFrame, masks: list[int]) -> DataFrame:
        nodes = F.array(*(F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("pattern")) for m in masks))
        return df.select("fp", F.explode(nodes).alias("node")).select("node.mask", "node.pattern", "fp")

    rows, masks, parts = under(fps, _blocks(0)), _blocks(0), []
    while True:
        size = rows.groupBy("mask", "pattern").count().filter("count > 1")
        finer = {m: _blocks(m) for m in masks if 64 - m.bit_count() > FREE_BITS}
        fits = F.col("count") <= NODE_ROWS
        large = size.filter(~fits & F.col("mask").isin([_signed(m) for m in finer])).select("mask", "pattern")
        refined = bool(finer) and not large.isEmpty()
        if refined:
            large = checkpointed(large)
            small = rows.join(large, ["mask", "pattern"], "left_anti")
        parts.append((small if refined else rows).join(size.select("mask", "pattern"), ["mask", "pattern"], "left_semi"))
        if not refined:
            break
        below = None
        for mask, masks_below in finer.items():
            some = rows.filter(F.col("mask") == _signed(mask)).join(large, ["mask", "pattern"], "left_semi")
            some = under(some.select("fp"), masks_below)
            below = some if below is None else below.unionByName(some)
        rows, masks = checkpointed(below), [m for x in finer.values() for m in x]
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.unionByName(p)
    placed = nodes.select("mask", "pattern", "fp").repartition("mask", "pattern").sortWithinPartitions("mask", "pattern")
    return placed.mapInArrow(_links_in_nodes, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (a, b) with b the least element that a is connected to, for each a that isn't it itself."""
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = None
    while True:
        # Large star: what is above u moves to u's least neighbour.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")))  # as a table, so that a join may split a hub's edges
        star = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        star = checkpointed(star.distinct())
        # Small star: u and what is below it move to the least of these.
        low = checkpointed(star.groupBy("a").agg(F.min("b").alias("m")))
        down = star.join(low, "a")
        edges = down.select("a", F.col("m").alias("b")).unionByName(down.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = checkpointed(edges.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges
        mark = now


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id per row of docs: the least doc_id reachable over links of at most RADIUS bits."""
    prints = landed(fingerprints(docs), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    member = components(links(nodes.select("fp")))
    rooted = nodes.join(member.withColumnRenamed("a", "fp"), "fp", "left").select("fp", "least", F.coalesce("b", "fp").alias("root"))
    lowest = checkpointed(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = rooted.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
