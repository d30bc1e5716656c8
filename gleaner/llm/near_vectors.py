"""Near-duplicate embeddings: binary codes of a random rotation, with correction factors, decide which pairs are computed.

A vector's direction is turned by a random rotation (drawn from a fixed seed, padded to a multiple of 64). Its code
holds the signs of the turned entries, and its factor is the inner product of the direction with the unit vector that the code stands for. The
inner product of any direction with that unit vector, over the factor, is an unbiased estimate of the cosine; its
error is the component of a random unit vector times a known size, so BOUND standard deviations of it bound the cosine. Pairs
whose upper bound reaches the threshold are computed from the vectors in double precision, others aren't, and none is
linked without that.

Who meets. A vector's greatest turned entry, by size, with its sign, is its home: one of twice the dimension's cells
of its label. Its code is dealt to the PROBES cells of its greatest entries, its vector to its home alone. Two vectors meet where one's home is
among the other's cells. A label of over NODE vectors a cell gets cells of two or more rotations' entries, and more probes. At a
cosine of just 0.93, the least favourable, 0.9998 of pairs meet in 64 dimensions (0.9987 with cells of two rotations), 0.998 (0.992) in 256; at 0.95 1.0 and
0.999 (0.9975) do. A cell's vectors are estimated against its codes; whom an estimate keeps is
fetched, once for each cell, and the pairs kept are computed there, each in one cell. So what travels is the vectors once, the codes PROBES times, and
the vectors of kept pairs once for each cell they are needed in. A cell of any size is cut in blocks of vectors by blocks of codes. Equal vectors
of a label count once before all this. A task gives one row a vector (its links, and its place in a forest of them), not one a pair.

Defined cases: vectors that are null, zero, empty or hold null or non-finite entries, and rows without a label, link with nothing;
vectors of different lengths don't link; equal vectors link; a row without vec_id counts as a vector and gets its group's least vec_id (null, and kept, if there's none);
repeated rows come out as often as they came in, and each is another vector to the others; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import checkpointed, dropped, landed
from gleaner.llm.simhash import _roots, components
from gleaner.llm.vectors import by_length, finite

COSINE = 0.93
#: Cells that a code is dealt to where a cell is an entry of one rotation, and times as many for each further rotation.
PROBES, MORE = 16, 8
#: Vectors that a cell of a label has on average at most.
NODE = 4096
#: Vectors and codes that a block of a cell has, about, and codes of it that are looked at in a step.
LEFT, RIGHT, STEP = 4096, 16_384, 2048
#: Vectors whose cells are found at once.
DEALT = 512
#: Standard deviations of the estimate's error.
BOUND = 5.0
#: Rows of a table that is broadcast; a longer one is joined by a shuffle.
SMALL = 50_000
#: Pairs computed at once.
PAIRS = 50_000
_SEED = 20_240


@cache
def rotation(width: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng([_SEED, width, number]).normal(size=(width, width)))
    return q * np.sign(np.diag(r))


def width_of(d: int) -> int:
    return max(64, -(-d // 64) * 64)


def directions(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def turned(unit: np.ndarray, number: int = 0) -> np.ndarray:
    w = width_of(unit.shape[1])
    return unit @ rotation(w, number)[: unit.shape[1]]


def codes(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Turned directions -> the signs as bytes of bits, and the factors."""
    return np.packbits(r >= 0, axis=1), np.abs(r).sum(axis=1) / math.sqrt(r.shape[1])


def signs(code: np.ndarray) -> np.ndarray:
    """The unit vectors that codes stand for."""
    bits = np.unpackbits(code, axis=1).astype(np.float32)
    return (bits * 2 - 1) / np.float32(math.sqrt(bits.shape[1]))


def kept(r: np.ndarray, code: np.ndarray, factor: np.ndarray, cosine: float = COSINE) -> np.ndarray:
    """Turned directions against codes: which pairs' upper bound reaches the cosine."""
    estimate = (r.astype(np.float32) @ signs(code).T) / factor.astype(np.float32)
    room = BOUND * np.sqrt(np.maximum(0, 1 - factor**2)) / factor * math.sqrt(max(0.0, 1 - cosine * cosine) / (r.shape[1] - 1))
    return estimate >= (cosine - room - 1e-5).astype(np.float32)


def cells(unit: np.ndarray, levels: int, first: np.ndarray) -> np.ndarray:
    """Of each direction (first: turned by rotation 0), its cells from the home on: those whose entries have the greatest sum."""
    n, w = first.shape
    if n > DEALT:
        return np.concatenate([cells(unit[lo : lo + DEALT], levels, first[lo : lo + DEALT]) for lo in range(0, n, DEALT)])
    key, total = np.zeros((n, 1), np.int64), np.zeros((n, 1))
    for k in range(levels):
        probes = min(PROBES * MORE**k, (2 * w) ** (k + 1))
        r = first if k == 0 else turned(unit, k)
        both = np.concatenate([r, -r], axis=1)
        most = min(PROBES * MORE**k, 2 * w)
        top = np.argpartition(-both, most - 1, axis=1)[:, :most]
        total = (total[:, :, None] + np.take_along_axis(both, top, 1)[:, None, :]).reshape(n, -1)
        key = (key[:, :, None] * (2 * w) + top[:, None, :]).reshape(n, -1)
        best = np.argsort(-total, axis=1, kind="stable")[:, :probes]
        key, total = np.take_along_axis(key, best, 1), np.take_along_axis(total, best, 1)
    return key


def _joined(df: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """df with small's columns: broadcast up to SMALL rows, by a shuffle beyond."""
    small = checkpointed(small)
    return df.join(F.broadcast(small) if small.count() <= SMALL else small, on, how)


def _blocked(rows: Callable[[bool], DataFrame], run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Applies run to each cell of rows (label, d, cell, left, right, ...), a large one's left rows in blocks against its right rows in blocks.

    rows(False) has the first five columns alone, to be counted. run gets further columns and ``side``: 0 left, 1 right.
    """
    where = ["label", "d", "cell"]
    n = rows(False).groupBy(where).agg(F.ceil(F.sum(F.col("left").cast("int")) / LEFT).alias("lefts"), F.ceil(F.sum(F.col("right").cast("int")) / RIGHT).alias("rights"))
    large = n.filter("lefts > 1 or rights > 1")
    placed = _joined(rows(True), large, where)
    at = lambda n: F.pmod(F.xxhash64("uid"), F.coalesce(n, F.lit(1))).cast("int")
    each = lambda n: F.sequence(F.lit(0), (F.coalesce(n, F.lit(1)) - 1).cast("int"))
    own = lambda side, f, n: F.transform(each(F.col(n)), lambda i: F.struct(F.lit(side).alias("side"), *(x.cast("int").alias(a) for x, a in zip(f(i), ("i", "j"), strict=True))))
    none = F.filter(own(0, lambda i: (i, i), "rights"), lambda _: F.lit(False))
    left = F.when(F.col("left"), own(0, lambda i: (at(F.col("lefts")), i), "rights")).otherwise(none)
    right = F.when(F.col("right"), own(1, lambda i: (i, at(F.col("rights"))), "lefts")).otherwise(none)
    dealt = placed.withColumn("at", F.explode(F.concat(left, right))).select(*(c for c in placed.columns if c not in ("left", "right", "lefts", "rights")), "at.*")
    return dealt.groupBy(*where, "i", "j").applyInArrow(run, schema)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    (_, x), *_ = by_length(column.combine_chunks())
    return x


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    joined = column.combine_chunks()
    return np.frombuffer(b"".join(joined.to_pylist()), np.uint8).reshape(len(joined), -1)


def _met(distinct: DataFrame, cosine: float) -> DataFrame:
    """distinct (uid, label, d, levels, v): uid and a cell in which a pair of it is to be computed, for each such cell."""
    kind = distinct.schema["label"].dataType.simpleString()

    def deal(full: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (batch.slice(lo, 2 * DEALT) for batch in batches for lo in range(0, len(batch), 2 * DEALT)):
                levels = b.column("levels").to_numpy()
                for rows, x in by_length(b.column("v")):
                    for level in np.unique(levels[rows]).tolist():
                        own = levels[rows] == level
                        at, unit = rows[own], directions(x[own])
                        r = turned(unit)
                        cell = cells(unit, level, r)
                        many = np.arange(len(at)).repeat(cell.shape[1])
                        home = np.arange(len(many)) % cell.shape[1] == 0
                        take = pa.array(at[many])
                        out = [b.column("label").take(take), b.column("d").take(take), pa.array(cell.ravel()), pa.array(home), pa.array(np.full(len(many), True))]
                        if full:
                            code, factor = codes(r)
                            packed = pa.array([c.tobytes() for c in code], pa.binary())
                            vectors = b.column("v").take(pa.array(np.where(home, at[many], 0), mask=~home))
                            out += [b.column("uid").take(take), packed.take(pa.array(many)), pa.array(factor[many]), vectors]
                        yield pa.RecordBatch.from_arrays(out, names=["label", "d", "cell", "left", "right", "uid", "code", "factor", "v"][: len(out)])

        schema = f"label {kind}, d int, cell long, left boolean, right boolean"
        return distinct.mapInArrow(run, schema + ", uid long, code binary, factor double, v array<double>" * full)

    def found(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        left, right = t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1))
        a, b = left.column("uid").to_numpy(), right.column("uid").to_numpy()
        out = np.empty(0, np.int64)
        if len(a) and len(b):
            r, code, factor = turned(directions(_matrix(left.column("v")))), _bytes(right.column("code")), right.column("factor").to_numpy()
            some = np.zeros(len(a), bool)
            parts = []
            for lo in range(0, len(b), STEP):
                own = slice(lo, lo + STEP)
                keep = kept(r, code[own], factor[own], cosine) & (a[:, None] != b[None, own])
                some |= keep.any(axis=1)
                parts.append(b[own][keep.any(axis=0)])
            out = np.unique(np.concatenate([a[some], *parts]))
        return pa.table({"uid": out, "cell": np.full(len(out), t.column("cell")[0].as_py() if len(t) else 0, np.int64)})

    return _blocked(deal, found, "uid long, cell long")


def _computed(distinct: DataFrame, met: DataFrame, cosine: float) -> DataFrame:
    """uid, links (vectors linked to it in a cell) and to: an element it's connected to there, in a forest."""
    sent = met.groupBy("uid").agg(F.sort_array(F.collect_set("cell")).alias("visits"))
    kind = distinct.schema["label"].dataType.simpleString()

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home, levels = np.zeros(len(b), np.int64), b.column("levels").to_numpy()
            for rows, x in by_length(b.column("v")):
                for level in np.unique(levels[rows]).tolist():
                    own = levels[rows] == level
                    unit = directions(x[own])
                    home[rows[own]] = cells(unit, level, turned(unit))[:, 0]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(home)], names=[*names, "home"])

    names = ["label", "d", "uid", "n", "visits", "v", "levels"]
    found = distinct.join(sent, "uid").select(names).mapInArrow(homes, f"label {kind}, d int, uid long, n long, visits array<long>, v array<double>, levels int, home long")
    rows = found.withColumn("cell", F.explode("visits")).withColumn("left", F.col("cell") == F.col("home")).withColumn("right", F.lit(True))
    five = ["label", "d", "cell", "left", "right"]

    def links(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        left, right = t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1))
        uid = np.unique(t.column("uid").to_numpy())
        count, label = np.zeros(len(uid), np.int64), np.arange(len(uid))
        if len(left) and len(right):
            cell = t.column("cell")[0].as_py()
            a, b = left.column("uid").to_numpy(), right.column("uid").to_numpy()
            home = right.column("home").to_numpy()
            x, y = directions(_matrix(left.column("v"))), directions(_matrix(right.column("v")))
            code, factor = codes(turned(y))
            r = turned(x)
            # Where both are at home, or each is in the other's home too, the pair counts for the lower uid's vector.
            visits = left.column("visits").combine_chunks()
            owner = np.repeat(np.arange(len(a)), np.diff(visits.offsets.to_numpy()))
            spots, slot = np.unique(np.r_[home, cell], return_inverse=True)
            both = np.zeros((len(a), len(spots)), bool)
            values = visits.values.to_numpy()
            place = np.minimum(np.searchsorted(spots, values), len(spots) - 1)
            there = spots[place] == values
            both[owner[there], place[there]] = True
            na, nb = left.column("n").to_numpy(), right.column("n").to_numpy()
            at_a, at_b = np.searchsorted(uid, a), np.searchsorted(uid, b)
            for first in range(0, len(b), STEP):
                own = slice(first, first + STEP)
                keep = kept(r, code[own], factor[own], cosine) & (a[:, None] != b[None, own])
                keep &= ~both[:, slot[:-1][own]] | (a[:, None] < b[None, own])
                i, j = np.nonzero(keep)
                j += first
                for lo in range(0, len(i), PAIRS):
                    p, q = i[lo : lo + PAIRS], j[lo : lo + PAIRS]
                    near = np.einsum("ij,ij->i", x[p], y[q]) >= cosine
                    p, q = p[near], q[near]
                    np.add.at(count, at_a[p], nb[q])
                    np.add.at(count, at_b[q], na[p])
                    _roots(label, at_a[p], at_b[q])
        linked = count > 0
        root = label[linked]
        return pa.table({"uid": uid[linked], "links": count[linked], "to": uid[root]})

    return _blocked(lambda full: rows if full else rows.select(five), links, "uid long, links long, to long")


def groups(vectors: DataFrame, cosine: float = COSINE, least: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id of each row: how many other vectors of the label it links with, and the least vec_id that links reach."""
    use = finite(vector) & F.exists(vector, lambda c: c != 0) & F.col(label).isNotNull()
    a, b = F.xxhash64(label, vector), F.xxhash64(F.lit(_SEED), vector, label)
    rows = vectors.select(F.col(least).cast("long").alias("vec_id"), F.when(use, a).alias("a"), F.when(use, b).alias("b"))
    # Not lazily: a vector's uid is where it stands in this table.
    own = vectors.filter(use).select(F.col(least).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"), a.alias("a"), b.alias("b"))
    equal = own.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.any_value("label").alias("label"), F.any_value("v").alias("v"))
    distinct = landed(equal.withColumn("uid", F.monotonically_increasing_id()).withColumn("d", F.size("v")), "vectors", compression="zstd")
    width = F.greatest(F.lit(64), F.ceil(F.col("d") / 64) * 64)
    level = F.greatest(F.lit(1), F.ceil(F.log(F.col("count") / NODE) / F.log(2 * width))).cast("int")
    levels = distinct.groupBy("label", "d").count().select("label", "d", level.alias("levels"))
    placed = _joined(distinct.select("uid", "label", "d", "n", "v"), levels, ["label", "d"], "inner")

    met = landed(_met(placed, cosine), "met", compression="zstd")
    linked = landed(_computed(placed, met, cosine), "linked", compression="zstd")
    dropped(met)
    root = components(linked.filter("uid <> to").select(F.col("uid").alias("a"), F.col("to").alias("b"))).select(F.col("a").alias("uid"), F.col("b").alias("root"))
    counts = linked.groupBy("uid").agg(F.sum("links").alias("links"))
    named = distinct.select("uid", "a", "b", "n", "least").join(counts, "uid", "left").join(root, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    named = checkpointed(named)
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = named.join(lowest, "root").select("a", "b", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    found = rows.filter("a is not null").join(facts, ["a", "b"]).select("vec_id", "n_links", "component_id")
    return found.unionByName(rows.filter("a is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def kept_row(vec_id: str = "vec_id", component_id: str = "component_id") -> Column:
    return F.col(vec_id).eqNullSafe(F.col(component_id))


def report(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    return groups(embeddings).select("*", kept_row().alias("kept"))
