"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Each step takes two passes over the distributed rows: one for X v, orthogonalised against all left vectors so far, and one for the
transposed product with it, orthogonalised on the driver against all right vectors so far. A left vector has one entry for each
row; it is never gathered nor stored, since it is the product of the rows with a vector of the embedding's dimension, and so
any pass can remake all of them block by block. What reaches the driver is sums whose length is the dimension or the number
of steps. The singular values and vectors of the small bidiagonal matrix give components and deviations.
"""

from __future__ import annotations

import dataclasses
import json
import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written
from .topk import usable

#: Bytes of a packed block of rows, about.
BLOCK_BYTES = 1 << 20
#: A component's residual, as a part of the greatest singular value, at which the steps end.
RESIDUAL = 1e-15
#: Directions with less than this part of the greatest variance are taken for rounding.
LEAST_VARIANCE = 1e-20
LOWEST, HIGHEST = -(2**63), 2**63 - 1


@dataclasses.dataclass(frozen=True)
class Whitening:
    """What was learned from n distinct rows: column i of ``directions`` is component i + 1, with variance ``variances[i]``."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    variances: np.ndarray
    total_variance: float
    identity_error: float
    steps: int

    @property
    def centre(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])


def whole_entries(vector: str = "vector") -> F.Column:
    """floor(256 * c) of each entry c as a long; what lies beyond a long is the end of its range."""
    return F.transform(F.col(vector), lambda c: F.floor(F.lit(256.0) * c).cast("long"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of longs as blocks of bytes."""
    for batch in batches:
        rows = batch.column(0)
        dim = len(rows[0]) if len(rows) else 1
        each = max(1, BLOCK_BYTES // (8 * dim))
        flat = np.asarray(rows.flatten(), np.int64)
        parts = [flat[a * dim : (a + each) * dim].tobytes() for a in range(0, len(rows), each)]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], ["block"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            own = np.frombuffer(raw)
            total = own.copy() if total is None else total + own
    yield pa.RecordBatch.from_arrays([pa.array([] if total is None else [total.tobytes()], pa.binary())], ["sums"])


class _Rows:
    """The fit list in packed blocks, and sums over it: of each task at first, then of some tasks, then of all."""

    def __init__(self, distinct: DataFrame, dim: int):
        self.blocks = written(distinct.mapInArrow(_packed, "block binary"), "vectors")
        self.dim = dim
        self.branches = max(1, math.isqrt(self.blocks.rdd.getNumPartitions()))
        self.passes = 0

    def total(self, of: Callable[[np.ndarray], np.ndarray], centre: np.ndarray) -> np.ndarray:
        """Sum over all blocks of what ``of`` gives for the centred rows of a block."""
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    own = of(np.frombuffer(raw, np.int64).reshape(-1, dim) - centre)
                    total = own if total is None else total + own
            yield pa.RecordBatch.from_arrays([pa.array([] if total is None else [total.tobytes()], pa.binary())], ["sums"])

        self.passes += 1
        sums = self.blocks.mapInArrow(run, "sums binary").repartition(self.branches).mapInArrow(_summed, "sums binary").collect()
        return np.sum([np.frombuffer(r.sums) for r in sorted(sums, key=lambda r: bytes(r.sums))], axis=0)


def _exact_sums(dim: int):
    """(n, sums of each entry) of a task's blocks, in decimal digits: such a sum may be beyond a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dim
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                x = np.frombuffer(raw, np.int64).reshape(-1, dim)
                n += len(x)
                safe = max(abs(int(x.min())), abs(int(x.max()))) * len(x) < 2**63
                sums = [a + int(b) for a, b in zip(sums, (x if safe else x.astype(object)).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps([n, *sums])])], ["sums"])

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [json.loads(x) for batch in batches for x in batch.column(0).to_pylist()]
    yield pa.RecordBatch.from_arrays([pa.array([json.dumps([sum(c) for c in zip(*parts, strict=True)])] if parts else [], pa.string())], ["sums"])


def bidiagonal(rows: _Rows, centre: np.ndarray, count: int, against: np.ndarray, done: Callable[[np.ndarray, np.ndarray], bool], seed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(singular values, right singular vectors as columns, steps) of the centred rows, within what is orthogonal to ``against``.

    Steps end when done(values, residuals of the first ``count``) says so or no direction is left. Where a step yields nothing new, as with
    repeated singular values, the next one starts from another direction.
    """
    dim = rows.dim
    draw = np.random.default_rng(seed)
    right, left, a_values, b_values = np.zeros((dim, 0)), np.zeros((dim, 0)), [], []

    def cleared(v: np.ndarray) -> np.ndarray:
        basis = np.hstack([against, right])
        for _ in range(2):
            v = v - basis @ (basis.T @ v)
        return v

    def another() -> np.ndarray:
        v = cleared(draw.standard_normal(dim))
        return v / np.linalg.norm(v)

    v, beta, values, vectors = another(), 0.0, np.zeros(0), np.zeros((dim, 0))
    for step in range(dim - against.shape[1]):
        right = np.hstack([right, v[:, None]])
        # X v less its part along the last left vector; then less what it shares with every left vector.
        w = v - beta * left[:, -1] if step else v
        for _ in range(2):
            basis = left

            def shared(x: np.ndarray, w=w, basis=basis) -> np.ndarray:
                u = x @ w
                return np.r_[u @ u, (x @ basis).T @ u]

            square, *along = rows.total(shared, centre)
            w = w - left @ np.array(along) if step else w
            # What is left after one removal is checked by another only where much was removed.
            if np.square(along).sum() <= 1e-20 * square:
                break
        alpha = math.sqrt(max(0.0, square - np.square(along).sum()))
        if alpha <= 1e-14 * max([0.0, *a_values]) or alpha == 0:
            alpha, w = 0.0, np.zeros(dim)
        else:
            w = w / alpha

        def back(x: np.ndarray, w=w) -> np.ndarray:
            u = x @ w
            return np.r_[u @ u, x.T @ u]

        if alpha:
            size, *product = rows.total(back, centre)
            w, alpha, product = w / math.sqrt(size), alpha * math.sqrt(size), np.array(product) / math.sqrt(size)
        else:
            product = np.zeros(dim)
        left = np.hstack([left, w[:, None]])
        a_values.append(alpha)
        b_values.append(beta)
        small = np.diag(a_values) + np.diag(b_values[1:], 1)
        p, values, q = np.linalg.svd(small)
        vectors = right @ q.T
        rest = cleared(product)
        beta = float(np.linalg.norm(rest))
        residuals = beta * np.abs(p[-1])
        if step + 1 >= min(count, dim - against.shape[1]) and done(values[:count], residuals[:count]):
            break
        if beta > 1e-13 * max(values[0], 1e-300):
            v = rest / beta
        elif step + 1 < dim - against.shape[1]:
            v, beta = another(), 0.0
    return values[:count], vectors[:, :count], len(a_values)


def fit(vectors: DataFrame, components: int = 4) -> Whitening | None:
    """Principal directions of the distinct rows of ``vectors`` (x array<long>, all of one length), centred, in falling order of variance.

    A first run of steps finds ``components`` directions; a second one, from another start and orthogonal to them, tells whether a
    direction of as much variance was missed, as can happen only where singular values repeat. None if no row varies.
    """
    distinct = vectors.select("x").distinct()
    dim = vectors.select(F.size("x").alias("n")).first()
    if not dim or not dim.n:
        return None
    rows = _Rows(distinct, dim.n)
    parts = rows.blocks.mapInArrow(_exact_sums(dim.n), "sums string").repartition(rows.branches).mapInArrow(_gathered, "sums string").collect()
    n, *sums = [sum(c) for c in zip(*[json.loads(r.sums) for r in parts], strict=True)]
    if n < 2:
        return None
    start = Whitening(n, tuple(sums), np.zeros((dim.n, 0)), np.zeros(0), 0.0, 0.0, 0)
    centre = start.centre
    trace = float(rows.total(lambda x: np.array([np.square(x).sum()]), centre)[0]) / n
    if trace <= 0:
        return None
    count = min(components, dim.n)
    values, found, steps = bidiagonal(rows, centre, count, np.zeros((dim.n, 0)), lambda v, r: bool((r <= RESIDUAL * v[0]).all()), 1)
    seed = 2
    while found.shape[1] < dim.n:
        least = values[-1]
        settled = lambda v, r, least=least: bool(v[0] + r[0] < least * (1 - 1e-6) or r[0] <= RESIDUAL * max(v[0], least))
        other, more, took = bidiagonal(rows, centre, 1, found, settled, seed)
        steps, seed = steps + took, seed + 1
        if other[0] <= least * (1 + 1e-9):
            break
        joined, basis = np.r_[values, other], np.hstack([found, more])
        order = np.argsort(-joined, kind="stable")[:count]
        values, found = joined[order], basis[:, order]
    variances = np.square(values) / n
    good = variances > LEAST_VARIANCE * variances[0]
    found, variances = np.linalg.qr(found)[0][:, good] * np.sign(np.diag(np.linalg.qr(found)[1]))[good], variances[good]
    scale = found / np.sqrt(variances)
    k = scale.shape[1]

    def moments(x: np.ndarray) -> np.ndarray:
        z = x @ scale
        return np.r_[z.sum(axis=0), (z.T @ z).ravel()]

    moved = rows.total(moments, centre) / n
    covariance = moved[k:].reshape(k, k) - np.outer(moved[:k], moved[:k])
    return Whitening(n, tuple(sums), found, variances, trace, float(np.abs(covariance - np.eye(k)).max()), steps)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - S) squared, exactly; beyond a long the end of its range."""
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums))
    if most * most * x.shape[1] < 2**63:
        return np.square(n * x - np.array(sums, np.int64)).sum(axis=1).tolist()
    return [min(HIGHEST, sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True))) for row in x.tolist()]


def _applied(model: Whitening):
    centre, scale, k = model.centre, model.directions / np.sqrt(model.variances), len(model.variances)
    explained = model.variances / model.total_variance

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.asarray(batch.column(1).flatten(), np.int64).reshape(len(batch), -1)
            n = len(x)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(n), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                pa.array(np.full(n * k, model.n)),
                pa.array(np.repeat(np.array(_deviations(x, model.n, list(model.sums)), np.int64), k)),
                pa.array(((x - centre) @ scale).ravel()),
                pa.array(np.tile(explained, n)),
                pa.array(np.full(n * k, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def usable_rows(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(_id, x): rows with a usable vector of the commonest length (ties: the longer), as whole entries."""
    rows = vectors.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    rows = rows.filter(usable(F.col("vector"))).withColumn("x", whole_entries()).select("_id", "x")
    common = rows.groupBy(F.size("x").alias("dim")).count().agg(F.max(F.struct("count", "dim")).alias("m")).first().m
    return rows.filter(F.size("x") == (common.dim if common else 0))


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): each usable row along each component.

    Vectors that are null or empty, or hold a null or non-finite entry, are left out, and so are those of another than the commonest
    length. Entries c become x = floor(256 * c). Directions are fitted on each distinct x once, n of them with sums S; deviation is
    the sum of (n * x - S) squared over all dimensions, whitened (x - S / n) along the component over its standard deviation,
    explained the component's part of the whole variance, identity_error how far the covariance of whitened is from the identity.
    Rows that repeat come out each; a null id stays null. Components of no variance are left out, so fewer than two distinct
    rows, or an empty table, give no rows. Components of equal variance are any basis of theirs. Other columns are ignored.
    """
    rows = usable_rows(vectors, id_col, vector)
    model = fit(rows, components)
    kind = vectors.schema[id_col].dataType.simpleString()
    shape = f"_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        out = vectors.sparkSession.createDataFrame([], shape)
    else:
        out = rows.mapInArrow(_applied(model), shape)
    return out.withColumnRenamed("_id", id_col)
