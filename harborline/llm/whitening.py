"""Embedding whitening: float32 eigenvectors of a distributed covariance, refined by matrix products."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from harborline.session import spool

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Scaled entries from here on are no whole numbers that a double holds exactly.
EXACT = 2.0**53
#: Rows multiplied at once in a task.
BLOCK = 4_096


# -- eigenvectors ---------------------------------------------------------------------

def _clusters(values: np.ndarray, near: float) -> list[np.ndarray]:
    """Runs of sorted values whose neighbours are no further apart than ``near``."""
    return np.split(np.arange(len(values)), np.flatnonzero(np.abs(np.diff(values)) > near) + 1)


def _slices(m: np.ndarray, bits: int, axis: int) -> list[np.ndarray]:
    """Parts of ``bits`` bits each, on one grid along ``axis``, as doubles that add up to ``m``."""
    out = []
    top = np.abs(m).max(axis=axis, keepdims=True)
    grid = np.ldexp(np.longdouble(1), np.frexp(top)[1] - bits)
    while len(out) * bits < 80:
        part = np.rint(m / grid) * grid
        out.append(part.astype(np.float64))
        m, grid = m - part, np.ldexp(grid, -bits)
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix product in extended precision, made of products of slices that are exact in double."""
    bits = (52 - int(np.ceil(np.log2(max(2, a.shape[1]))))) // 2
    left, right = _slices(a, bits, 1), _slices(b, bits, 0)
    out = np.zeros((a.shape[0], b.shape[1]), np.longdouble)
    for p in reversed(range(len(left))):
        for q in reversed(range(len(left) - p)):
            out += left[p] @ right[q]
    return out


def refine(a: np.ndarray, x: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors of symmetric ``a`` from approximate vectors ``x``.

    Ogita-Aishima iteration in extended precision: with R = I - X'X and S = X'AX, the
    correction is X + XE, E(i,j) = (S(i,j) + w(j) R(i,j)) / (w(j) - w(i)). It doubles the
    right digits each time while the eigenvalues i and j are further apart than the present
    error. Nearer ones form a cluster: there E takes only the part that restores
    orthogonality, and the block of A - mu I seen through the vectors of the cluster, mu its
    mean, is solved for itself; the shift leaves the small differences as leading digits.
    """
    a = np.asarray(a, np.longdouble)
    x = np.asarray(x, np.longdouble)
    one = np.eye(len(a), dtype=np.longdouble)
    tiny = np.finfo(np.longdouble).eps
    best, kept, stalled = np.inf, None, 0
    for _ in range(rounds):
        r = one - product(x.T, x)
        s = product(x.T, product(a, x))
        s = (s + s.T) / 2
        w = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-w, kind="stable")
        x, r, s, w = x[:, order], r[np.ix_(order, order)], s[np.ix_(order, order)], w[order]
        size = max(abs(w[0]), abs(w[-1]), np.finfo(np.float64).tiny)
        off = np.sqrt(((s - np.diag(w)) ** 2).sum())
        error = off + size * np.sqrt((r**2).sum())
        stalled = 0 if error < best / 2 else stalled + 1
        if error < best:
            best, kept = error, (w, x)
        # Splitting a cluster may take a round that gains nothing.
        if stalled == 3 or error <= tiny * size:
            break
        # Errors move an eigenvalue by less than this; nearer ones can't be told apart yet.
        near = 2 * error
        gap = w[None, :] - w[:, None]
        apart = np.abs(gap) > near
        e = np.where(apart, (s + w[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + product(x, e)
        for group in _clusters(w, near):
            if len(group) > 1:
                part = x[:, group]
                mean = w[group].mean()
                block = product(part.T, product(a, part)) - mean * product(part.T, part)
                scale = np.abs(block).max()
                if scale > 0:
                    # Solved in double; its own errors are small beside the cluster's width.
                    _, turn = np.linalg.eigh(np.asarray((block + block.T) / (2 * scale), np.float64))
                    x[:, group] = product(part, turn[:, ::-1].astype(np.longdouble))
    return kept


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and their unit vectors (columns) to double precision."""
    top = np.abs(a).max()
    if not top:
        return np.zeros(len(a)), np.eye(len(a))
    scaled = np.asarray(a, np.longdouble) / top
    _, start = np.linalg.eigh(scaled.astype(np.float32))
    values, vectors = refine(scaled, start[:, ::-1])
    return (values * top).astype(np.float64), vectors.astype(np.float64)


# -- distributed moments --------------------------------------------------------------

def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0), np.int64)


def _sums(df: DataFrame, width: int) -> list[int]:
    """Sums of each dimension of x; one row a dimension from each task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, object)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = _matrix(batch.column(0).slice(at, BLOCK))
                whole = np.abs(x).max() < 2**62 // BLOCK
                total += (x if whole else x.astype(object)).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_pydict({"i": range(width), "v": [str(v) for v in total]})

    parts = df.select("x").mapInArrow(run, "i bigint, v string")
    rows = parts.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    return [int(r["v"]) for r in sorted(rows)]


def _products(y: np.ndarray) -> np.ndarray:
    """y'y of whole numbers, exact: doubles where every sum fits, else Python's integers."""
    if float(np.abs(y).max(initial=0)) ** 2 * max(len(y), 1) < EXACT:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    o = y.astype(object)
    return o.T @ o


def _gram(df: DataFrame, centre: list[int]) -> list[list[int]]:
    """Sums of (x - centre)(x - centre)', exact; of each task the upper triangle is added up."""
    middle = np.array(centre, np.int64)
    upper = np.triu_indices(len(centre))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(middle), len(middle)), object)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                total = total + _products(_matrix(batch.column(0).slice(at, BLOCK)) - middle)
        yield pa.RecordBatch.from_pydict({"i": upper[0], "j": upper[1], "v": [str(v) for v in total[upper]]})

    parts = df.select("x").mapInArrow(run, "i bigint, j bigint, v string")
    out = np.zeros((len(centre), len(centre)), object)
    for r in parts.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = int(r["v"])
    return out


def _extended(whole: np.ndarray) -> np.ndarray:
    """Whole numbers of any size in extended precision, by leading part and rest."""
    lead = np.array([[float(v) for v in row] for row in whole])
    rest = np.array([[float(v - int(h)) for v, h in zip(row, leads, strict=True)] for row, leads in zip(whole, lead, strict=True)])
    return lead.astype(np.longdouble) + rest


@dataclass
class Whitening:
    """What a fit gives: count, whole-number centre, n times the rest of the mean, and the components."""

    n: int
    centre: list[int]
    rest: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([t / self.n for t in self.rest])
        return ((x - np.array(self.centre, np.int64)).astype(np.float64) - mean) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S) squared, exact; null beyond a long."""
        y, t = x - np.array(self.centre, np.int64), np.array(self.rest, object)
        most = self.n * float(np.abs(y).max(initial=0)) + float(max(map(abs, self.rest)))
        if most**2 * len(self.rest) < 2.0**62:
            d = self.n * y - t.astype(np.int64)
            return (d * d).sum(axis=1).tolist()
        d = self.n * y.astype(object) - t
        return [v if v < 2**63 else None for v in (d * d).sum(axis=1).tolist()]


def whole_entries(vector: str, scale: int = SCALE, offset: int = OFFSET) -> tuple[Column, Column]:
    """Whether a vector can take part, and its whole numbers floor(scale * c) + offset."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double") * scale) >= EXACT)
    fit = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad)
    return fit, F.transform(vector, lambda c: (F.floor(c.cast("double") * scale) + offset).cast("bigint"))


def fit(x: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """The fit list of distinct x (of the commonest length) and its whitening; None where x does not vary.

    The covariance is exact: sums around the rounded mean are whole numbers, and what
    rounding left out is taken off as whole numbers too, before the one division.
    Only sums reach the driver: one a dimension, then one a pair of dimensions.
    """
    listed = spool(x.select("x").distinct().select("x", F.size("x").alias("width")), "whitening-fit")
    widths = listed.groupBy("width").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    if not widths:
        return listed, None
    width, n = widths[0]
    listed = listed.where(F.col("width") == width).select("x")
    sums = _sums(listed, width)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    gram = _gram(listed, centre)
    away = n * gram - np.outer(np.array(rest, object), np.array(rest, object))
    covariance = _extended(away) / np.longdouble(n) / np.longdouble(n)
    values, vectors = eigen(covariance)
    trace = float(np.trace(covariance))
    # A value that rounding alone can make is no component.
    rank = min(components, int((values > 64 * width * np.finfo(np.float64).eps * max(trace, 0.0)).sum()))
    if not rank:
        return listed, None
    return listed, Whitening(n, centre, rest, values[:rank], vectors[:, :rank], trace)


def identity_error(listed: DataFrame, found: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity, measured."""
    rank = len(found.values)
    upper = np.triu_indices(rank)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rank, rank))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                z = found.project(_matrix(batch.column(0).slice(at, BLOCK)))
                total += z.T @ z
        yield pa.RecordBatch.from_pydict({"i": upper[0], "j": upper[1], "v": total[upper]})

    parts = listed.mapInArrow(run, "i bigint, j bigint, v double")
    mean = F.sum("v") / F.lit(float(found.n))
    off = F.abs(mean - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    return parts.groupBy("i", "j").agg(off.alias("off")).agg(F.max("off")).first()[0]


def whiten(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
    scale: int = SCALE, offset: int = OFFSET,
) -> DataFrame:
    """A row per usable vector and component: key, component, n, deviation, whitened, explained, identity_error.

    Entries become x = floor(scale * c) + offset. The fit list holds each distinct x
    once; the mean, the covariance (divisor n) and its unit eigenvectors are those of
    the list, numbered by falling eigenvalue. ``whitened`` is x less the mean,
    projected, over the root of the eigenvalue; ``deviation`` the sum of (n x - S)
    squared (null beyond a long); ``explained`` the eigenvalue's part of the trace.

    Null or empty vectors and vectors with a null or non-finite entry, or one whose
    scaled value a double can't hold as a whole number, give no rows; nor do vectors of
    another length than the commonest (ties: the longest). Null keys and repeated rows
    keep their rows. Directions without variance are no components, so equal vectors, a
    single vector and an empty table give no rows. Further columns are not looked at.
    """
    usable, x = whole_entries(vector, scale, offset)
    rows = vectors.where(usable).select(F.col(key).alias("key"), x.alias("x"))
    listed, found = fit(rows, components)
    schema = "key bigint, component int, deviation bigint, whitened double"
    if found is None:
        out = rows.select(F.col("key").cast("bigint").alias("key"), F.lit(0).alias("component"), F.lit(0).cast("bigint").alias("deviation"), F.lit(0.0).alias("whitened")).limit(0)
        n, explained, error = 0, [0.0], 0.0
    else:
        rank, error = len(found.values), identity_error(listed, found)
        n, explained = found.n, (found.values / found.trace).tolist()

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    x = _matrix(part.column(1))
                    each = np.repeat(np.arange(len(x)), rank)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array(each)),
                            pa.array(np.tile(np.arange(1, rank + 1, dtype=np.int32), len(x))),
                            pa.array(found.deviations(x), pa.int64()).take(pa.array(each)),
                            pa.array(found.project(x).ravel()),
                        ],
                        ["key", "component", "deviation", "whitened"],
                    )

        same = rows.where(F.size("x") == len(found.centre))
        out = same.select(F.col("key").cast("bigint"), "x").mapInArrow(run, schema)
    return out.select(
        F.col("key").alias(key), "component", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.element_at(F.array(*map(F.lit, explained)), F.col("component")).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
