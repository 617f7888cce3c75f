"""Whitening of embeddings by an incremental eigendecomposition.

Each task keeps the spectrum of its rows' scatter matrix and applies every row
as a centred rank-one update: a secular equation gives the new eigenvalues, a
matrix of Cauchy form the new eigenvectors, after deflation of directions that
do not change. Spectra of tasks are combined in a tree by rank-one updates with
the scaled eigenvectors of one in the other, and one for the distance of means.
Last, distributed Rayleigh-Ritz passes over all rows bring the leading
components to double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import prepare
from meterloom.session import cut

EPS = np.finfo(float).eps
SCALE = 256
#: Spectra combined by one task of the tree.
FAN = 16
#: Vectors in the basis of a Rayleigh-Ritz pass; up to so many dimensions one pass spans the whole space.
BASIS = 512
PASSES = 60
RESIDUAL = 1e-13
WHOLE = "n long, total array<long>, eigenvalues array<double>, eigenvectors array<double>"


def _deflated(values: np.ndarray, basis: np.ndarray, z: np.ndarray, tol: float) -> np.ndarray:
    """Rotates equal eigenvalues' share of ``z`` into one of them, in place; which entries take part in the update."""
    live = np.abs(z) * np.linalg.norm(z) > tol
    at = np.flatnonzero(live)
    if len(at) > 1 and (np.diff(values[at]) * np.abs(z[at][1:] * z[at][:-1]) <= tol * (z[at][1:] ** 2 + z[at][:-1] ** 2)).any():
        last = at[0]
        for j in at[1:]:
            size = np.hypot(z[last], z[j])
            c, s = z[j] / size, z[last] / size
            if (values[j] - values[last]) * abs(c * s) <= tol:
                z[j], z[last] = size, 0.0
                left, right = basis[:, last].copy(), basis[:, j].copy()
                basis[:, last], basis[:, j] = c * left - s * right, s * left + c * right
                low, high = values[last], values[j]
                values[last], values[j] = c * c * low + s * s * high, s * s * low + c * c * high
                live[last] = False
            last = j
    return live


def _roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(z2 / (d - x))`` for ascending ``d``: the nearest pole of each and the distance from it.

    Rational interpolation with the two neighbouring poles, kept inside the
    bracket by bisection.
    """
    k = len(d)
    total = z2.sum()
    if k == 1:
        return np.zeros(1, dtype=int), z2
    width = np.append(np.diff(d), total)
    span = np.arange(k)
    middle = d + width / 2
    f = 1 + (z2 / (d - middle[:, None])).sum(axis=1)
    upper = (f < 0) & (span < k - 1)  # the root lies in the right half: measure from the right pole
    pole = span + upper
    delta = d - d[pole][:, None]  # poles as seen from the root's own
    low, high = np.where(upper, -width / 2, 0.0), np.where(upper, 0.0, np.where(f < 0, width, width / 2))
    low = np.where(~upper & (f < 0), width / 2, low)
    left = np.minimum(span, k - 2)
    right = left + 1
    below = (span[None, :] <= left[:, None]).astype(float)
    x = (low + high) / 2
    for step in range(80):
        gap = delta - x[:, None]
        share = z2 / gap
        slope = share / gap
        f = 1 + share.sum(axis=1)
        size = 1 + np.abs(share).sum(axis=1)
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        done = (np.abs(f) <= 16 * EPS * size) | (high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high)))
        if done.all():
            break
        if step >= 24:
            x = np.where(done, x, (low + high) / 2)
            continue
        a_gap, b_gap = gap[span, left], gap[span, right]
        psi = np.einsum("ij,ij->i", below, slope)
        phi = slope.sum(axis=1) - psi
        c = f - a_gap * psi - b_gap * phi
        a = (a_gap + b_gap) * f - a_gap * b_gap * (psi + phi)
        b = a_gap * b_gap * f
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
            by_less = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            by_more = np.where(a >= 0, (a + root) / (2 * c), 2 * b / (a - root))
            new = x + np.where(span < k - 1, by_less, by_more)
        inside = np.isfinite(new) & (new > low) & (new < high)
        x = np.where(done, x, np.where(inside, new, (low + high) / 2))
    return pole, x


def rank_one(values: np.ndarray, basis: np.ndarray, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of ``basis @ diag(values) @ basis.T + vector @ vector.T``; ``values`` ascending."""
    z = basis.T @ vector
    norm2 = float(z @ z)
    if norm2 == 0.0:
        return values, basis
    values, basis = values.copy(), basis.copy()
    live = np.flatnonzero(_deflated(values, basis, z, 8 * EPS * max(abs(values[-1]), norm2)))
    if len(live):
        order = live[np.argsort(values[live], kind="stable")]
        d, own = values[order], z[order]
        pole, x = _roots(d, own * own)
        gap = (d - d[pole][:, None]) - x[:, None]  # root i against pole j
        gap = np.where(gap == 0, -np.finfo(float).tiny, gap)
        # the vector for which the computed roots are exact keeps the new eigenvectors orthogonal
        between = d[None, :] - d[:, None]
        np.fill_diagonal(between, 1.0)
        exact = np.exp(0.5 * (np.log(np.abs(gap)) - np.log(np.abs(between))).sum(axis=0))  # logarithms: products overflow
        cauchy = np.copysign(exact, own) / gap
        cauchy /= np.linalg.norm(cauchy, axis=1)[:, None]
        values[order], basis[:, order] = d[pole] + x, basis[:, order] @ cauchy.T
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


@dataclass
class Spectrum:
    """Count, exact sums and the eigendecomposition of the scatter about the mean."""

    n: int
    total: np.ndarray
    values: np.ndarray
    basis: np.ndarray

    @classmethod
    def empty(cls, dims: int) -> Spectrum:
        return cls(0, np.zeros(dims, dtype=np.int64), np.zeros(dims), np.eye(dims))

    def add(self, row: np.ndarray) -> None:
        """One row: a rank-one update with its distance from the mean so far."""
        if self.n:
            away = row - self.total / self.n
            self.values, self.basis = rank_one(self.values, self.basis, away * np.sqrt(self.n / (self.n + 1)))
        self.n += 1
        self.total = self.total + row

    def merge(self, other: Spectrum) -> None:
        """The rows of another: its scaled eigenvectors one by one, then the distance of the means."""
        if self.n and other.n:
            away = (self.total / self.n - other.total / other.n) * np.sqrt(self.n * other.n / (self.n + other.n))
            for value, vector in zip(other.values, other.basis.T):
                if value > 0:
                    self.values, self.basis = rank_one(self.values, self.basis, vector * np.sqrt(value))
            self.values, self.basis = rank_one(self.values, self.basis, away)
        elif other.n:
            self.values, self.basis = other.values, other.basis
        self.n += other.n
        self.total = self.total + other.total

    def row(self) -> tuple:
        return self.n, self.total.tolist(), self.values.tolist(), self.basis.ravel().tolist()

    @classmethod
    def of(cls, n, total, values, basis) -> Spectrum:
        size = len(total)
        return cls(int(n), np.asarray(total, dtype=np.int64), np.asarray(values, dtype=float), np.asarray(basis, dtype=float).reshape(size, size))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _spectra(fit: DataFrame, dims: int) -> DataFrame:
    """``id, n, total, eigenvalues, eigenvectors``: the spectrum of each task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum.empty(dims)
        for batch in batches:
            for row in _matrix(batch.column(0), dims):
                own.add(row)
        if own.n:
            names = ["id", "n", "total", "eigenvalues", "eigenvectors"]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((TaskContext.get().partitionId(), *own.row()), kinds)], names)

    return fit.select("x").mapInArrow(run, "id long, " + WHOLE)


def _combined(spectra: DataFrame) -> Spectrum:
    """All tasks' spectra as one, in a tree of ``FAN`` per task."""

    def join(pdf):
        import pandas as pd

        pdf = pdf.sort_values("id")
        own = Spectrum.of(*pdf.iloc[0][["n", "total", "eigenvalues", "eigenvectors"]])
        for other in pdf.iloc[1:][["n", "total", "eigenvalues", "eigenvectors"]].itertuples(index=False):
            own.merge(Spectrum.of(*other))
        return pd.DataFrame([(int(pdf["id"].iloc[0]) // FAN, *own.row())], columns=["id", "n", "total", "eigenvalues", "eigenvectors"])

    most = spectra.agg(F.max("id").alias("id")).first()["id"]
    while most > 0:
        spectra = spectra.groupBy(F.floor(F.col("id") / FAN).alias("into")).applyInPandas(join, "id long, " + WHOLE)
        most //= FAN
    one = spectra.first()
    return Spectrum.of(one["n"], one["total"], one["eigenvalues"], one["eigenvectors"])


def _summed(fit: DataFrame, product, size: int) -> np.ndarray:
    """Sum over all rows of the ``size`` numbers that ``product`` returns for a matrix of rows, added up in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            part = product(batch.column(0))
            own = part if own is None else own + part
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(own)], ["place", "part"])

    sums = fit.select("x").mapInArrow(run, "place long, part double").groupBy("place").agg(F.sum("part").alias("part"))
    out = np.zeros(size)
    for place, part in sums.collect():  # ``size`` rows
        out[place] = part
    return out


def components(fit: DataFrame, count: int = 4) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, float]:
    """``n, total, eigenvalues, vectors, trace`` of the covariance of the integer rows ``x`` of a written table.

    ``vectors`` has a unit component per column, by falling eigenvalue, at most
    ``count``. Passes go on until every residual is below ``RESIDUAL`` times the
    largest eigenvalue or falls no further.
    """
    dims = len(fit.first()["x"])
    whole = _combined(cut(_spectra(fit, dims)))
    n, total = whole.n, whole.total
    mean = total / n
    basis = whole.basis[:, ::-1][:, : min(dims, max(BASIS, 4 * count))]
    k = min(count, dims)
    last = np.inf
    for turn in range(PASSES):
        p = basis.shape[1]

        def product(column, basis=basis):
            away = _matrix(column, dims) - mean
            return np.concatenate([(away.T @ (away @ basis)).ravel(), [np.einsum("ij,ij->", away, away)]])

        sums = _summed(fit, product, dims * p + 1)
        image, trace = sums[:-1].reshape(dims, p) / n, sums[-1] / n
        small = basis.T @ image
        e, turned = np.linalg.eigh((small + small.T) / 2)
        e, turned = e[::-1], turned[:, ::-1]
        ritz = basis @ turned
        residual = np.linalg.norm((image @ turned - ritz * e)[:, :k], axis=0).max()
        if turn and (residual <= RESIDUAL * max(e[0], 0.0) or residual >= last / 2):
            break
        last = residual
        basis = np.linalg.qr(ritz if p == dims else image @ turned)[0]
    return n, total, e[:k], ritz[:, :k], trace


def integers(vector: str) -> Column:
    """``floor(256 * c)`` of every entry as long; null for a vector that is null, empty or holds null or non-finite entries."""
    c = F.col(vector)
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size(c) > 0)
    return F.when(fine, F.transform(c, lambda v: F.floor(F.lit(float(SCALE)) * v.cast("double")).cast("long")))


def whiten(embeddings: DataFrame, count: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per usable row and component.

    Vectors that are null, empty, or hold null or non-finite entries take no
    part, nor do vectors of another length than the most frequent one (of equally
    frequent lengths the longest). The fit uses each distinct integer vector
    once; repeated rows and null ids are each returned. A component without
    variance has a null ``whitened`` and explains nothing; ``identity_error`` is
    then over the others, null if there are none. A ``deviation`` beyond 64 bits
    is null. An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    prepare(spark)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = cut(embeddings.select(F.col(id_col).cast("long").alias("vec_id"), integers(vector_col).alias("x")).where("x is not null"))
    longest = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if longest is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == longest["dims"])
    fit = cut(rows.select("x").distinct())
    n, total, e, vectors, trace = components(fit, count)
    dims, k = vectors.shape
    mean = total / n
    good = e > 64 * EPS * max(trace, 0.0)
    scaled = np.where(good, vectors / np.sqrt(np.where(good, e, 1.0)), 0.0)

    def product(column):
        white = (_matrix(column, dims) - mean) @ scaled
        return np.concatenate([(white.T @ white).ravel(), white.sum(axis=0)])

    sums = _summed(fit, product, k * k + k)
    centre = sums[k * k :] / n
    error = np.abs(sums[: k * k].reshape(k, k) / n - np.outer(centre, centre) - np.eye(k))[np.ix_(good, good)]
    shared = spark.sparkContext.broadcast((scaled, good, np.where(good, e / trace if trace else 0.0, 0.0), float(error.max()) if good.any() else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scaled, good, explained, error = shared.value
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            size = len(x)
            white = ((x - mean) @ scaled).ravel()
            fits = ((x * float(n) - total) ** 2).sum(axis=1) < 2.0**62
            deviation = pa.array(((x * n - total) ** 2).sum(axis=1), mask=~fits)
            if not fits.all():
                exact = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, total)) if not ok else None for row, ok in zip(x.tolist(), fits)]
                values = deviation.to_pylist()
                deviation = pa.array([v if ok else (w if w < 2**63 else None) for v, w, ok in zip(values, exact, fits)], pa.int64())
            each = pa.array(np.repeat(np.arange(size), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * k, n, dtype=np.int64)),
                    deviation.take(each),
                    pa.array(white, mask=np.tile(~good, size)),
                    pa.array(np.tile(explained, size)),
                    pa.array([error] * (size * k), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select("vec_id", "x").mapInArrow(run, schema)
