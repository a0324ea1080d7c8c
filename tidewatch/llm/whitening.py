"""Embedding whitening by cyclic Jacobi.

Vectors become whole numbers, x = floor(1024 * c) + 100000.  One pass sums each dimension, a second the products of
differences from the rounded mean; both sums are exact integers, so the centred scatter is the same in every run,
however rows are dealt out.  The driver holds a matrix of dimensions by dimensions, nothing that grows with the rows,
and rotates it cyclically until every off-diagonal entry vanishes beside the geometric mean of its diagonal ones,
which keeps small eigenvalues accurate.  The whitening matrix goes to all tasks with their code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024.0, 100000
#: Components returned at most.
COMPONENTS = 8
#: Largest |1024 * c| that is a whole long beside the shift.
_REACH = float(2**62)
_LIMB = 1 << 60
_EXACT = 1 << 53


def usable(vector: Column) -> Column:
    """A vector that is not null or empty and holds neither nulls nor entries without a whole number."""
    # NaN is above every number in Spark's order, so the comparison refuses it too.
    fine = lambda c: c.isNotNull() & (F.abs(c.cast("double")) * F.lit(SCALE) < F.lit(_REACH))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(fine(c), F.lit(False))), F.lit(False))


def whole(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(SCALE)).cast("long") + F.lit(SHIFT).cast("long"))


def _block(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dims)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: longs where they suffice, else Python's numbers."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)) < 2**63:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def _deviation(d: np.ndarray) -> pa.Array:
    """Sum of squares of each row; null beyond a long."""
    top = int(np.abs(d).max(initial=0))
    square = (d * d if d.shape[1] * top * top < 2**63 else d.astype(object) ** 2).sum(axis=1)
    return pa.array([int(s) if s < 2**63 else None for s in square], pa.int64())


def _limbs(total: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """A whole number v as v = high * 2 ** 60 + low, as decimals."""
    kind = pa.decimal128(38, 0)
    parts = [divmod(int(v), _LIMB) for v in total]
    return pa.array([Decimal(h) for h, _ in parts], kind), pa.array([Decimal(low) for _, low in parts], kind)


def _sums(dims: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, dtype=object), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _block(batch.column(0), dims)
            n += len(x)
            total += x.sum(axis=0).astype(object) if len(x) * int(np.abs(x).max()) < 2**63 else x.astype(object).sum(axis=0)
        if n:
            high, low = _limbs(np.r_[np.array([n], dtype=object), total])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dims)), high, low], names=["cell", "high", "low"])

    return sums


def _products(middle: list[int]):
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = len(middle)
        total, any_row = np.zeros((dims, dims), dtype=object), False
        upper = np.triu_indices(dims)
        for batch in batches:
            if not batch.num_rows:
                continue
            any_row = True
            x = _block(batch.column(0), dims)
            z = _centred(x, 1, middle)
            if len(z) * int(np.abs(z).max()) ** 2 < _EXACT:
                d = z.astype(np.float64)
                total += (d.T @ d).astype(np.int64).astype(object)  # whole numbers below 2 ** 53: exact
            else:
                total += z.astype(object).T @ z.astype(object)
        if any_row:
            high, low = _limbs(total[upper])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]))), high, low], names=["cell", "high", "low"])

    return products


def _collected(parts: DataFrame) -> dict[int, int]:
    rows = parts.groupBy("cell").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    return {r["cell"]: int(r["high"]) * _LIMB + int(r["low"]) for r in rows}


def jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix by cyclic rotations.

    Every pair of a sweep is rotated unless its entry is below 2 ** -53 of the geometric mean of the two diagonal
    entries; a sweep without a rotation ends it.  The entry of largest size in each vector is made positive.
    """
    a = np.array(a, dtype=np.float64)
    n = len(a)
    v = np.eye(n)
    for _ in range(sweeps):
        turned = False
        for p in range(n - 1):
            for q in range(p + 1, n):
                off = a[p, q]
                if off == 0 or abs(off) <= 2.0**-53 * np.sqrt(abs(a[p, p] * a[q, q])):
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * off)
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(1.0, theta))
                c = 1 / np.hypot(1.0, t)
                s = t * c
                pp, qq = a[p, p] - t * off, a[q, q] + t * off
                for m in (a, v):  # columns p and q
                    left, right = m[:, p].copy(), m[:, q]
                    m[:, p], m[:, q] = c * left - s * right, s * left + c * right
                top = a[p].copy()
                a[p], a[q] = c * top - s * a[q], s * top + c * a[q]
                a[p, p], a[q, q], a[p, q], a[q, p] = pp, qq, 0.0, 0.0
        if not turned:
            break
    e = np.diag(a).copy()
    order = np.lexsort((np.arange(n), -e))
    e, v = e[order], v[:, order]
    sign = np.sign(v[np.abs(v).argmax(axis=0), np.arange(n)])
    return e, v * np.where(sign == 0, 1.0, sign)


@dataclass(frozen=True)
class Fit:
    """n rows; sums of each dimension; covariance; eigenvalues, falling, and their vectors (columns)."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


class Whitening:
    """Fitted on rows (vec_id, embedding); ``apply`` whitens any rows by it.

    Rows without a usable vector are dropped: null or empty, or with a null, NaN, infinite or too large entry
    (|1024 * c| of 2 ** 62 or more).  Of vectors of different lengths the commonest length stays (ties: the longer
    one).  A null vec_id is carried; repeated rows count and are returned as often as they are there; other columns
    are ignored.  Equal eigenvalues keep the order of the rotated diagonal.  A component without variance (its
    eigenvalue is at most 2 ** -40 of the largest) has ``whitened`` null and explains 0; fewer dimensions than
    ``components`` give fewer components.  ``deviation`` is null where it exceeds a long.  An empty table, or one
    without usable vectors, gives no rows.
    """

    def __init__(self, rows: DataFrame, components: int = COMPONENTS):
        self.components = components
        kept = self._kept(rows)
        lengths = kept.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
        self.dims = lengths["dims"] if lengths else 0
        if not self.dims:
            return
        vectors = self._vectors(rows).select("x")
        total = _collected(vectors.mapInArrow(_sums(self.dims), "cell long, high decimal(38,0), low decimal(38,0)"))
        n, sums = total.pop(-1), [total[k] for k in range(self.dims)]
        middle = [(2 * s + n) // (2 * n) for s in sums]  # the mean, rounded
        cells = _collected(vectors.mapInArrow(_products(middle), "cell long, high decimal(38,0), low decimal(38,0)"))
        rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
        v = np.zeros((self.dims, self.dims))
        for k, (i, j) in enumerate(zip(*np.triu_indices(self.dims), strict=True)):
            # Exactly n * (sum of products about the rounded mean) less what rounding moved.
            v[i, j] = v[j, i] = float(Fraction(n * cells[k] - rest[i] * rest[j], n * n))
        e, w = jacobi(v)
        self.fit = Fit(n, sums, v, e, w)

    @staticmethod
    def _kept(rows: DataFrame) -> DataFrame:
        vector = F.col("embedding")
        return rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding")).filter(usable(vector)).select("vec_id", whole(vector).alias("x"))

    def _vectors(self, rows: DataFrame) -> DataFrame:
        return self._kept(rows).filter(F.size("x") == self.dims)

    def _scaled(self) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of the components over the root of their eigenvalues, and which of them have variance."""
        k = min(self.components, self.dims)
        alive = self.fit.values[:k] > max(self.fit.values[0], 0.0) * 2.0**-40
        return np.where(alive, self.fit.vectors[:, :k] / np.sqrt(np.where(alive, self.fit.values[:k], 1.0)), 0.0), alive

    def whiten(self, rows: DataFrame) -> DataFrame:
        """(vec_id, component, n, deviation, whitened, explained) of every usable row and component."""
        if not self.dims:
            return rows.sparkSession.createDataFrame([], _OUT)
        scaled, alive = self._scaled()
        n, sums, k = self.fit.n, self.fit.sums, scaled.shape[1]
        trace = float(np.trace(self.fit.covariance))
        explained = np.where(alive, self.fit.values[:k] / (trace or 1.0), 0.0)

        def white(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.num_rows
                if not rows:
                    continue
                d = _centred(_block(batch.column(1), len(sums)), n, sums)
                each = pa.array(np.repeat(np.arange(rows), k))
                z = (d / n).astype(np.float64) @ scaled
                columns = [
                    batch.column(0).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n)),
                    _deviation(d).take(each),
                    pa.array(z.ravel(), mask=np.tile(~alive, rows)),
                    pa.array(np.tile(explained, rows)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _OUT.split(", ")])

        return self._vectors(rows).mapInArrow(white, _OUT)

    def identity_error(self, rows: DataFrame) -> float:
        """Largest absolute entry of the whitened rows' covariance less the identity, measured on these rows.

        Components without variance are left out.
        """
        if not self.dims:
            return 0.0
        scaled, alive = self._scaled()
        n, sums, k = self.fit.n, self.fit.sums, scaled.shape[1]

        def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + k + k * k)
            for batch in batches:
                z = (_centred(_block(batch.column(0), len(sums)), n, sums) / n).astype(np.float64) @ scaled
                total += np.r_[float(len(z)), z.sum(axis=0), (z.T @ z).ravel()]
            if total[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["cell", "value"])

        sums_of = self._vectors(rows).select("x").mapInArrow(moments, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
        found = {r["cell"]: r["value"] for r in sums_of.collect()}
        if not found:
            return 0.0
        m = np.array([found[i] for i in range(1 + k + k * k)])
        mean = m[1 : k + 1] / m[0]
        apart = np.abs(m[k + 1 :].reshape(k, k) / m[0] - np.outer(mean, mean) - np.eye(k))
        return float(apart[np.ix_(alive, alive)].max(initial=0.0))

    def apply(self, rows: DataFrame) -> DataFrame:
        """``whiten`` with the measured ``identity_error`` beside each row."""
        return self.whiten(rows).withColumn("identity_error", F.lit(self.identity_error(rows)))
