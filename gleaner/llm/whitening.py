"""Whitening of embeddings: covariance, its eigenvectors by cyclic Jacobi rotations, and each vector's whitened components.

The vectors are whole numbers (``fixed_point`` makes them of embeddings), so sums are exact and don't depend on the
order of tasks. A first pass sums each dimension; a second sums the products of the vectors' differences from the rounded mean, in which
numbers are small, and what rounding the mean has left is taken off on the driver. Tasks hand on one matrix each, by
rows, and a matrix row is added up by one task. The driver gets a matrix of dimension x dimension, whatever the
number of vectors, and turns pairs of axes until no entry off the diagonal is more than EPS of the geometric mean of its two on
it: this relative test is what makes small eigenvalues as accurate as large ones. A sweep goes through all pairs in
rounds of disjoint ones, which are turned at once. Eigenvectors over the roots of their eigenvalues are broadcast (components x
dimension numbers), a third pass measures the whitened components' covariance, and a fourth gives them.

Defined cases: vectors that are null or hold null or non-finite entries are left out; vectors of each length are whitened by
themselves, an empty one has no components; a dimension has no more components than the vector; a component
without variance (an eigenvalue of NONE of the greatest or less, as with one row or equal rows) is null in ``whitened`` and isn't part of the
identity's error; entries that ``fixed_point`` would take beyond 2**40 stop there; a deviation beyond a long is null; rows
without vec_id count and come out, as do repeated rows; ties of eigenvalues may turn within their space; an empty table gives no rows; further columns
are kept by ``whitened``, which replaces columns named as its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.vectors import by_length, finite

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
EPS = 1e-15
SWEEPS = 60
#: Of the greatest eigenvalue: one as small is rounding.
NONE = 1e-13
#: Rows of a result's batch.
ROWS = 4096
_MOST = float(1 << 40)


class Model(NamedTuple):
    """Of the vectors of one length."""

    n: int
    sums: list[int]
    centre: np.ndarray  # the mean, rounded
    values: np.ndarray  # eigenvalues, falling
    axes: np.ndarray  # a unit eigenvector a row
    trace: float

    def whitening(self, components: int) -> np.ndarray:
        """Rows that whiten a difference from the mean; nan for a component without variance."""
        e = self.values[:components]
        root = np.sqrt(np.where(e > NONE * max(self.values[:1].max(initial=0), 0), e, np.nan))
        return self.axes[:components] / root[:, None]


def fixed_point(vector: str, scale: float = SCALE, shift: int = SHIFT) -> Column:
    """floor(scale * entry) + shift as longs."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), c.cast("double") * float(scale)))) + F.lit(shift).cast("long"))


def _rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs below n, in rounds of disjoint pairs: one stays, the others move on by one."""
    m = n + n % 2
    ring = list(range(1, m))
    out = []
    for _ in range(m - 1):
        line = [0, *ring]
        pairs = [(min(a, b), max(a, b)) for a, b in zip(line[: m // 2], line[: m // 2 - 1 : -1], strict=True) if max(a, b) < n]
        out.append((np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)))
        ring = ring[-1:] + ring[:-1]
    return out


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (rows) of a symmetric matrix."""
    a, n = np.array(matrix, dtype=np.float64), len(matrix)
    axes = np.eye(n)
    rounds = _rounds(n) if n > 1 else []
    for _ in range(SWEEPS):
        turned = False
        for p, q in rounds:
            off, dp, dq = a[p, q], a[p, p], a[q, q]
            large = np.abs(off) > EPS * np.sqrt(np.abs(dp)) * np.sqrt(np.abs(dq))
            if not large.any():
                continue
            turned = True
            p, q, off, dp, dq = p[large], q[large], off[large], dp[large], dq[large]
            with np.errstate(over="ignore"):
                theta = (dq - dp) / (2 * off)
                t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1))
            c = 1 / np.sqrt(1 + t * t)
            s = t * c
            for m in (a, a.T, axes):
                x, y = m[p], m[q]
                m[p], m[q] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y
            a[p, q] = a[q, p] = 0.0
            a[p, p], a[q, q] = dp - t * off, dq + t * off
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], axes[order]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """x -> d, i, n, s: the count and sum of each dimension i of vectors of length d."""
    totals: dict[int, list] = {}
    for b in batches:
        for at, x in by_length(b.column(0)):
            own = totals.setdefault(x.shape[1], [0, np.zeros(x.shape[1], object)])
            own[0] += len(at)
            own[1] += x.sum(axis=0).astype(object)
    for d, (n, s) in totals.items():
        text = pa.array([str(v) for v in s], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), text], names=["d", "i", "n", "s"])


def _products(matrices: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The rows of each length's matrix from the diagonal on."""
    for d, m in matrices.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), d, np.int32)), pa.array(np.arange(len(m), dtype=np.int32)), pa.array([r[i:] for i, r in enumerate(m)], pa.list_(pa.float64()))], names=["d", "i", "r"])


def _added(rows: pa.Table) -> pa.Table:
    """All tasks' share of one matrix row -> their sum."""
    total = np.sum([r.values.to_numpy() for r in rows.column("r")], axis=0)
    return pa.table({"d": rows.column("d")[:1], "i": rows.column("i")[:1], "r": pa.array([total], pa.list_(pa.float64()))})


def _matrices(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums of tasks' matrices, by length."""
    kind = "d int, i int, r array<double>"
    out: dict[int, np.ndarray] = {}
    for row in parts.groupBy("d", "i").applyInArrow(_added, kind).toLocalIterator():
        m = out.setdefault(row.d, np.zeros((row.i + len(row.r),) * 2))
        m[row.i, row.i :] = m[row.i :, row.i] = row.r
    return out


def fit(vectors: DataFrame, column: str = "x") -> dict[int, Model]:
    """vectors: arrays of longs without nulls. The model of each length of vectors."""
    own = vectors.select(F.col(column).alias("x")).filter(F.size("x") > 0)
    totals = own.mapInArrow(_sums, "d int, i int, n long, s string").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    counts: dict[int, int] = {}
    sums: dict[int, dict[int, int]] = {}
    for r in totals.toLocalIterator():  # a row per dimension
        counts[r.d] = r.n
        sums.setdefault(r.d, {})[r.i] = int(r.s)
    centres = {d: np.array([round(Fraction(s[i], counts[d])) for i in range(d)], np.int64) for d, s in sums.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in by_length(b.column(0)):
                d = x.shape[1]
                apart = (x - shared.value[d]).astype(np.float64)
                found[d] = found.get(d, 0) + apart.T @ apart
        yield from _products(found)

    models = {}
    for d, m in _matrices(own.mapInArrow(scatter, "d int, i int, r array<double>")).items():
        n, s = counts[d], [sums[d][i] for i in range(d)]
        left = np.array([float(Fraction(v, n) - int(c)) for v, c in zip(s, centres[d].tolist(), strict=True)])
        cov = m / n - np.outer(left, left)
        values, axes = jacobi(cov)
        models[d] = Model(n, s, centres[d], values, axes, float(np.trace(cov)))
    return models


def _apart(x: np.ndarray, model: Model) -> np.ndarray:
    """Differences from the mean."""
    left = np.array([float(Fraction(v, model.n) - int(c)) for v, c in zip(model.sums, model.centre.tolist(), strict=True)])
    return (x - model.centre) - left


def _deviation(x: np.ndarray, model: Model) -> list[int | None]:
    """Sums of (n * x - S)**2, exact; None beyond a long."""
    rest = [s - model.n * int(c) for s, c in zip(model.sums, model.centre.tolist(), strict=True)]
    apart = x - model.centre
    most = model.n * (int(np.abs(apart).max(initial=0)) + 1)
    if most * most * x.shape[1] < 1 << 63:
        y = model.n * apart - np.array(rest, np.int64)
        return (y * y).sum(axis=1).tolist()
    out = []
    for row in apart.tolist():
        total = sum((model.n * v - r) ** 2 for v, r in zip(row, rest, strict=True))
        out.append(total if total < 1 << 63 else None)
    return out


def identity_errors(vectors: DataFrame, models: dict[int, Model], column: str = "x", components: int = COMPONENTS) -> dict[int, float]:
    """By length, the largest entry of the whitened components' covariance less the identity."""
    shared = vectors.sparkSession.sparkContext.broadcast({d: (m, m.whitening(components)) for d, m in models.items()})

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in by_length(b.column(0)):
                model, turn = shared.value[x.shape[1]]
                w = np.column_stack([_apart(x, model) @ turn.T, np.ones(len(x))])  # the last row and column sum the components
                found[x.shape[1]] = found.get(x.shape[1], 0) + w.T @ w
        yield from _products(found)

    own = vectors.select(F.col(column).alias("x")).filter(F.size("x") > 0)
    out = {}
    for d, m in _matrices(own.mapInArrow(scatter, "d int, i int, r array<double>")).items():
        mean = m[:-1, -1] / m[-1, -1]
        error = np.abs(m[:-1, :-1] / m[-1, -1] - np.outer(mean, mean) - np.eye(len(mean)))
        out[d] = float(np.nanmax(error, initial=0.0))
    return out


def whitened(vectors: DataFrame, models: dict[int, Model], column: str = "x", components: int = COMPONENTS) -> DataFrame:
    """vectors and whitened (array of double, null where a component has no variance)."""
    schema = T.StructType([f for f in vectors.schema.fields if f.name != "whitened"])
    names = list(schema.names)
    schema = schema.add("whitened", T.ArrayType(T.DoubleType()))
    shared = vectors.sparkSession.sparkContext.broadcast({d: (m, m.whitening(components)) for d, m in models.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list = [[] for _ in range(len(b))]
            for at, x in by_length(b.column(column)):
                if x.shape[1]:
                    model, turn = shared.value[x.shape[1]]
                    for i, w in zip(at.tolist(), _apart(x, model) @ turn.T, strict=True):
                        out[i] = w
            own = pa.array(out, pa.list_(pa.float64()), from_pandas=True)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), own], names=schema.names)

    return vectors.select(names).mapInArrow(run, schema)


def report(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each vector and component."""
    vectors = embeddings.filter(finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), fixed_point("embedding").alias("x"))
    models = fit(vectors)
    errors = identity_errors(vectors, models, components=components)
    shared = vectors.sparkSession.sparkContext.broadcast((models, errors))
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), ROWS):
                part = b.slice(lo, ROWS)
                for at, x in by_length(part.column(1)):
                    if not x.shape[1]:
                        continue
                    model = shared.value[0][x.shape[1]]
                    turn = model.whitening(components)
                    k = len(turn)
                    share = model.values[:k] / model.trace if model.trace > 0 else np.zeros(k)
                    rows = len(at) * k
                    one_each = pa.array(np.repeat(np.arange(len(at)), k))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array(at)).take(one_each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(rows, model.n)),
                            pa.array(_deviation(x, model), pa.int64()).take(one_each), pa.array((_apart(x, model) @ turn.T).ravel(), from_pandas=True), pa.array(np.tile(share, len(at))),
                            pa.array(np.full(rows, shared.value[1][x.shape[1]])),
                        ],
                        names=names,
                    )

    return vectors.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
