"""Whitening of embeddings by spectrum slicing.

1. **Fit list.**  Components become integers ``x = floor(scale * c) + shift``; every
   distinct x vector counts once, so a vector on a third of all rows weighs as
   much as any other and its rows are combined before the shuffle.
2. **Covariance, exactly.**  One pass gives n and the sums S.  A second one gives the
   Gram matrix of ``y = x - floor(S/n)``, in integers; with ``s = S - n floor(S/n)``
   the covariance ``(n Gram - s s') / n^2`` is a quotient of integers, rounded once.
   Only d x d numbers (d: vector length) reach the driver, whatever the row count.
3. **Spectrum slicing.**  The inertia of ``V - sigma I`` from an LDL' factorisation
   (symmetric pivoting, blocks of one and two rows) counts the eigenvalues above
   sigma.  Bisection on these counts isolates each of the leading eigenvalues, Rayleigh
   quotient iteration then converges cubically, and two further counts on both
   sides of the quotient certify its number.  Eigenvalues closer than rounding are
   taken together: their number is certified, their vectors are made orthogonal.
4. **Projection.**  Every row is projected on the components.  A last pass over the
   fit list measures the covariance of the whitened vectors against the identity.

Defined results: null vectors and vectors with a null or non-finite entry are left out.
Vectors of one table share a length; if they do not, the most frequent length (the
larger one on ties) is the table's and the others are left out.  Repeated rows are
returned as often as they occur and count once.  Directions without variance (e within
rounding of zero) have no whitened form and are no component: a table with one distinct
vector, like an empty one, gives no rows.  Columns other than ``id_col`` and
``vector_col`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written
from .vectors import batches_of, fixed_point, matrix, vector_rows

EPS = float(np.finfo(float).eps)
EXACT = 1 << 53        # integers up to here are exact in doubles
PIVOT = (1 + 17 ** 0.5) / 8      # Bunch and Kaufman's bound on the growth of pivots


# --------------------------------------------------------------------------
# integer vectors and their moments
# --------------------------------------------------------------------------

def integers(vectors: DataFrame, dim: int, scale: int, shift: int) -> DataFrame:
    """(id, x): the usable vectors of length ``dim`` as integers."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            rows, values = matrix(batch.column(1), dim)
            x = fixed_point(values, scale) + shift
            at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.ListArray.from_arrays(at, pa.array(x.ravel()))],
                                             ["id", "x"])

    return vectors.mapInArrow(task, "id long, x array<long>")


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def common_length(vectors: DataFrame) -> int:
    """The most frequent length of the usable vectors; 0 if there is none."""
    usable = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    sizes = vectors.where(F.size("vector") > 0).where(usable).groupBy(F.size("vector").alias("dim")).count()
    top = sizes.orderBy(F.desc("count"), F.desc("dim")).first()
    return top["dim"] if top else 0


def summed(parts: DataFrame) -> dict[tuple[int, int], int]:
    """Totals of (i, j, v) rows; as many as the matrix has entries."""
    return {(r["i"], r["j"]): r["v"] for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}


def sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """(n, S) of the fit list."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for batch in batches_of(batches):
            x = rows_of(batch.column(0), dim)
            top = max(abs(int(x.max())), abs(int(x.min()))) * len(x)
            part = x.sum(axis=0) if top < 1 << 62 else x.astype(object).sum(axis=0)
            n, total = n + len(x), [a + int(b) for a, b in zip(total, part)]
        if n:
            yield entries([(-1, -1)] + [(j, j) for j in range(dim)], [n, *total])

    found = summed(fit.mapInArrow(task, "i int, j int, v decimal(38,0)"))
    return int(found.get((-1, -1), 0)), [int(found.get((j, j), 0)) for j in range(dim)]


def entries(at: list[tuple[int, int]], values) -> pa.RecordBatch:
    """Matrix entries as (i, j, v) rows, v an integer of any size."""
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in at], pa.int32()), pa.array([b for _, b in at], pa.int32()),
                                       pa.array([int(v) for v in values], pa.decimal128(38, 0))], ["i", "j", "v"])


def gram(y: np.ndarray) -> np.ndarray:
    """y'y in exact integers."""
    top = max(abs(int(y.max())), abs(int(y.min())))
    if top * top * len(y) < EXACT:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    z = y if top * top * len(y) < 1 << 62 else y.astype(object)
    return z.T @ z


def covariance(fit: DataFrame, dim: int, n: int, total: list[int]) -> np.ndarray:
    """Covariance of the fit list with divisor n, each entry rounded once."""
    centre = np.array([s // n for s in total], np.int64)
    at = [(i, j) for i in range(dim) for j in range(i, dim)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((dim, dim), object)
        for batch in batches_of(batches):
            g = g + gram(rows_of(batch.column(0), dim) - centre)
        if g.any():
            yield entries(at, [g[i, j] for i, j in at])

    g = summed(fit.mapInArrow(task, "i int, j int, v decimal(38,0)"))
    s = [a - n * int(c) for a, c in zip(total, centre)]
    v = np.zeros((dim, dim))
    for i, j in at:
        v[i, j] = v[j, i] = (n * int(g.get((i, j), 0)) - s[i] * s[j]) / (n * n)
    return v


# --------------------------------------------------------------------------
# spectrum slicing
# --------------------------------------------------------------------------

def count_above(v: np.ndarray, sigma: float) -> int:
    """Eigenvalues of the symmetric ``v`` above ``sigma``: positive pivots of L D L' = P (v - sigma I) P'."""
    a = v - sigma * np.eye(len(v))
    n, k, above = len(a), 0, 0
    while k < n:
        below = np.abs(a[k + 1:, k])
        big = below.max() if len(below) else 0.0
        pair = False
        if big > 0 and abs(a[k, k]) < PIVOT * big:
            r = k + 1 + int(below.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0
            other = row.max()
            if abs(a[k, k]) * other < PIVOT * big * big:
                pair = abs(a[r, r]) < PIVOT * other
                swap = k + 1 if pair else k
                a[[swap, r]] = a[[r, swap]]
                a[:, [swap, r]] = a[:, [r, swap]]
        if pair:                                         # a pivot block of two rows has one eigenvalue of either sign
            block, rest = a[k:k + 2, k:k + 2], a[k + 2:, k:k + 2]
            a[k + 2:, k + 2:] -= rest @ np.linalg.inv(block) @ rest.T
            above += 1
            k += 2
        else:
            if a[k, k] > 0:
                above += 1
            if a[k, k] != 0:
                rest = a[k + 1:, k].copy()
                a[k + 1:, k + 1:] -= np.outer(rest / a[k, k], rest)
            k += 1
    return above


class Slicer:
    """Counts of one matrix by shift; shifts that were tried narrow every later search."""

    def __init__(self, v: np.ndarray):
        self.v = v
        self.norm = float(np.abs(v).sum(axis=1).max())
        self.counts = {self.norm * (1 + 4 * EPS): 0, -self.norm * (1 + 4 * EPS): len(v)}

    def count(self, sigma: float) -> int:
        if sigma not in self.counts:
            self.counts[sigma] = count_above(self.v, sigma)
        return self.counts[sigma]

    def bracket(self, k: int) -> tuple[float, float]:
        """The closest shifts with at least k and with fewer than k eigenvalues above."""
        low = max(s for s, c in self.counts.items() if c >= k)
        return low, min(s for s, c in self.counts.items() if c < k and s > low)

    def isolate(self, k: int, narrow: float) -> tuple[float, float]:
        """A bracket of eigenvalue k alone, or one of width ``narrow`` if others are as close."""
        low, high = self.bracket(k)
        while (self.count(low), self.count(high)) != (k, k - 1) and high - low > narrow:
            self.count((low + high) / 2)
            low, high = self.bracket(k)
        return low, high


def _solve(v: np.ndarray, sigma: float, b: np.ndarray) -> np.ndarray:
    """(v - sigma I) z = b, moved off an eigenvalue that the shift hits exactly."""
    size = max(abs(sigma), float(np.abs(v).max()), 1e-300)
    for step in (0, 1, 4, 16):
        try:
            z = np.linalg.solve(v - (sigma + step * EPS * size) * np.eye(len(v)), b)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(z).all():
            return z / np.linalg.norm(z)
    raise ArithmeticError("no shift near the eigenvalue can be solved")


def _apart(z: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """``z`` made orthogonal to the found vectors (twice, for rounding) and of length one."""
    for _ in range(2):
        for q in found:
            z = z - (q @ z) * q
        z = z / np.linalg.norm(z)
    return z


def leading_eigenpairs(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values falling, unit vectors as rows) of at most ``k`` positive eigenvalues of the
    positive semidefinite ``v``, every one numbered by certified counts."""
    d, trace = len(v), float(np.trace(v)) if len(v) else 0.0
    if trace <= 0:
        return np.empty(0), np.empty((0, d))
    a = v / trace
    slicer, rng = Slicer(a), np.random.default_rng(1)
    noise = 8 * d * EPS * slicer.norm
    k = min(k, slicer.count(noise))
    values, vectors = [], []
    while len(values) < k:
        number = len(values) + 1
        low, high = slicer.isolate(number, noise)
        while True:
            z = _apart(rng.standard_normal(d), vectors)
            for _ in range(3):                           # inverse iteration: into the bracket
                z = _apart(_solve(a, (low + high) / 2, z), vectors)
            rho = float(z @ a @ z)
            for _ in range(20):                          # Rayleigh quotient iteration
                if np.linalg.norm(a @ z - rho * z) <= 2 * EPS * slicer.norm:
                    break
                z = _apart(_solve(a, rho, z), vectors)
                rho = float(z @ a @ z)
            slack = max(noise, 4 * float(np.linalg.norm(a @ z - rho * z)))
            if slicer.count(rho - slack) >= number > slicer.count(rho + slack):
                break                                    # the counts certify the number
            if high - low <= noise:
                raise ArithmeticError(f"the number of eigenvalue {number} could not be certified")
            slicer.count((low + high) / 2)               # it went to a neighbour: start closer
            low, high = slicer.bracket(number)
        values.append(rho)
        vectors.append(_apart(z, vectors))
    order = np.argsort(values)[::-1]                     # equal within rounding only
    return np.array(values)[order] * trace, np.array(vectors).reshape(-1, d)[order]


# --------------------------------------------------------------------------
# the operator
# --------------------------------------------------------------------------

@dataclass(frozen=True)
class Whitening:
    """A fitted transform.  ``values`` and ``vectors`` are the eigenpairs of the components kept."""
    dim: int
    scale: int
    shift: int
    n: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def _centred(x: np.ndarray, n: int, total: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(n x - S as integers, x - S/n as doubles)."""
    centre = np.array([s // n for s in total], np.int64)
    rest = [s - n * int(c) for s, c in zip(total, centre)]
    y = x - centre
    top = max(abs(int(y.max())), abs(int(y.min()))) + 1 if y.size else 1
    if top * n < 1 << 62:
        exact = y * n - np.array(rest, np.int64)
    else:
        exact = y.astype(object) * n - np.array(rest, object)
    return exact, (exact / n).astype(np.float64)


def _squares(exact: np.ndarray) -> list[int]:
    """Sum of squares of every row of integers."""
    if exact.dtype != object and exact.size and (int(np.abs(exact).max()) ** 2) * exact.shape[1] < 1 << 62:
        return (exact * exact).sum(axis=1).tolist()
    return (exact.astype(object) ** 2).sum(axis=1).tolist() if exact.size else []


def _identity_error(fit: DataFrame, dim: int, n: int, total: list[int], project: np.ndarray) -> float:
    """Largest entry of |covariance of the whitened fit list - identity|."""
    k = project.shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second, first = np.zeros((k, k)), np.zeros(k)
        for batch in batches_of(batches):
            w = _centred(rows_of(batch.column(0), dim), n, total)[1] @ project
            second, first = second + w.T @ w, first + w.sum(axis=0)
        at = np.arange(k)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.r_[np.repeat(at, k), np.full(k, -1)].astype(np.int32)), pa.array(np.r_[np.tile(at, k), at].astype(np.int32)),
            pa.array(np.r_[second.ravel(), first])], ["i", "j", "v"])

    m = summed(fit.mapInArrow(task, "i int, j int, v double"))
    mean = np.array([m[-1, j] for j in range(k)]) / n
    cov = np.array([[m[i, j] for j in range(k)] for i in range(k)]) / n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k)).max())


def fit_whitening(vectors: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000) -> Whitening:
    """Fit on the distinct usable vectors of (id, vector) rows."""
    dim = common_length(vectors)
    none = Whitening(dim, scale, shift, 0, [0] * dim, np.empty(0), np.empty((0, dim)), 0.0, 0.0)
    if not dim:
        return none
    fit = written(integers(vectors, dim, scale, shift).select("x").distinct(), "fit-list")
    n, total = sums(fit, dim)
    v = covariance(fit, dim, n, total)
    values, found = leading_eigenpairs(v, components)
    error = _identity_error(fit, dim, n, total, (found / np.sqrt(values)[:, None]).T) if len(values) else 0.0
    return Whitening(dim, scale, shift, n, total, values, found, float(np.trace(v)), error)


def whiten(vectors: DataFrame, fitted: Whitening) -> DataFrame:
    """(id, deviation, whitened): every usable vector in the fitted components.  ``deviation``: sum of (n x - S)^2."""
    dim, n, total = fitted.dim, fitted.n, fitted.total
    if not len(fitted.values):
        return vectors.sparkSession.createDataFrame([], "id long, deviation decimal(38,0), whitened array<double>")
    project = (fitted.vectors / np.sqrt(fitted.values)[:, None]).T

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            x = rows_of(batch.column(1), dim)
            exact, centred = _centred(x, n, total)
            at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * project.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_squares(exact), pa.decimal128(38, 0)),
                                              pa.ListArray.from_arrays(at, pa.array((centred @ project).ravel()))],
                                             ["id", "deviation", "whitened"])

    x = integers(vectors, dim, fitted.scale, fitted.shift)
    return x.mapInArrow(task, "id long, deviation decimal(38,0), whitened array<double>")


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """Contract columns: 16 components of vectors in 64ths."""
    vectors = vector_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    w = fit_whitening(vectors, components=16)
    explained = F.array(*[F.lit(float(e / w.trace)) for e in w.values]).cast("array<double>")
    rows = whiten(vectors, w).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(F.col("id").alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"),
                       F.col("deviation").cast("long").alias("deviation"), "whitened", F.get(explained, F.col("at")).alias("explained"),
                       F.lit(w.identity_error).alias("identity_error"))
