"""Whitening of embeddings along their first principal components.

Entries c become integers x = floor(256 c). The fit list holds each distinct x once;
V is its covariance, divisor n, centred before multiplying. The first eigenpairs of
V come from contour integration (FEAST):

* Inertia counts (signs of the pivots of V - s I) say how many eigenvalues lie above
  a point; bisection over them cuts the top of the spectrum into intervals of one
  eigenvalue (or of several that are almost equal) whose ends lie in gaps.
* For each interval the quadrature of complex shifted solves (z I - V) Q = Y around it
  projects a block of vectors on its eigenvectors; Rayleigh-Ritz on the projected
  block gives eigenpairs, and this is repeated until their residuals are at rounding level.
* The pairs found in an interval must be as many as its inertia count says; otherwise
  the block is enlarged, so no component is missed.

Rows are read by Spark tasks only: distinct vectors by a shuffle, exact integer sums,
centred products and projections by Arrow batches. To the driver come the sums (d
numbers) and V (d x d), whose sizes don't depend on the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, tidy

SCALE = 256
#: Quadrature points on a half circle, most rounds for one interval.
POINTS, ROUNDS = 8, 40
#: Bisection steps towards either end of a gap.
CENTRING = 8


# --- eigenpairs by contour integration -------------------------------------------

def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``v`` are greater than ``shift``: the positive
    pivots of v - shift I (Sylvester), by elimination with 1 x 1 and 2 x 2 pivots
    of the largest size."""
    a = v - shift * np.eye(len(v))
    count = 0
    while len(a):
        diagonal = np.abs(a.diagonal())
        k = int(diagonal.argmax())
        off = np.abs(a - np.diag(a.diagonal()))
        i, j = np.unravel_index(int(off.argmax()), off.shape)
        if diagonal[k] == 0 and off[i, j] == 0:
            break
        if diagonal[k] >= 0.64 * off[i, j]:
            count += int(a[k, k] > 0)
            rest = np.delete(np.arange(len(a)), k)
            a = a[np.ix_(rest, rest)] - np.outer(a[rest, k], a[k, rest] / a[k, k])
        else:  # a 2 x 2 pivot with a negative determinant: one eigenvalue of either sign
            count += 1
            rest = np.delete(np.arange(len(a)), [i, j])
            pair = a[np.ix_([i, j], [i, j])]
            a = a[np.ix_(rest, rest)] - a[np.ix_(rest, [i, j])] @ np.linalg.solve(pair, a[np.ix_([i, j], rest)])
        a = (a + a.T) / 2
    return count


def gap(v: np.ndarray, wanted: int, low: float, high: float, least: float) -> float:
    """A point in (low, high) with ``wanted`` eigenvalues above it, near the middle of the
    gap there. Where eigenvalues nearer than ``least`` make that impossible, the point is
    below all of these; ``low`` if no other is left."""
    lo, hi = low, high
    while hi - lo > least:
        at = (lo + hi) / 2
        n = above(v, at)
        if n == wanted:
            break
        lo, hi = (at, hi) if n > wanted else (lo, at)
    else:
        at, n = lo, above(v, lo)
    if at == low:
        return low
    ends = []
    for inner, outer in ((at, hi), (at, low)):  # how far the gap reaches to either side
        for _ in range(CENTRING):
            mid = (inner + outer) / 2
            inner, outer = (mid, outer) if above(v, mid) == n else (inner, mid)
        ends.append(inner)
    return sum(ends) / 2


def reach(v: np.ndarray, n: int, low: float, high: float) -> float:
    """A point above eigenvalue number ``n`` from the top, at about twice its distance from ``low``."""
    lo, hi = low, high
    while hi - lo > (lo - low) / 8 and hi - lo > 1e-3 * (high - low) * np.finfo(float).eps:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if above(v, mid) >= n else (lo, mid)
    return min(high, hi + (hi - low))


def feast(v: np.ndarray, low: float, high: float, count: int, seed: int = 0) -> np.ndarray:
    """Unit eigenvectors of the ``count`` eigenvalues of ``v`` in (low, high]."""
    d, size = len(v), float(np.abs(v).max())
    block = min(d, max(count + 2, count * 2))
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    angle = np.pi / 2 * (nodes + 1)
    random = np.random.default_rng(seed)
    y = random.standard_normal((d, block))
    for _ in range(ROUNDS):
        q = np.zeros((d, block))
        for t, w in zip(angle, weights, strict=True):  # the lower half circle is the conjugate
            turn = radius * np.exp(1j * t)
            q += np.real(w / 2 * turn * np.linalg.solve((centre + turn) * np.eye(d) - v, y.astype(complex)))
        q, _ = np.linalg.qr(q)
        small = q.T @ v @ q
        values, turns = _symmetric(small)
        vectors = q @ turns
        inside = (values > low) & (values <= high)
        residual = np.abs(v @ vectors - vectors * values).max(axis=0)
        if inside.sum() == count and residual[inside].max(initial=0) <= 64 * np.finfo(float).eps * size:
            break
        if inside.sum() > count or block < d and inside.sum() == block:
            block = min(d, block * 2)
            vectors = np.hstack([vectors, random.standard_normal((d, block - vectors.shape[1]))])
        y = vectors
    if inside.sum() != count:
        raise ArithmeticError(f"{int(inside.sum())} eigenvalues found in ({low}, {high}], inertia says {count}")
    if residual[inside].max(initial=0) > 1e-11 * size:
        raise ArithmeticError(f"no convergence in ({low}, {high}] after {ROUNDS} rounds")
    return vectors[:, inside]


def _symmetric(small: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of the small projected matrix."""
    return np.linalg.eigh((small + small.T) / 2)


def leading(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the ``wanted`` greatest positive eigenvalues of ``v``, falling; fewer
    where its rank is smaller. Intervals are cut from the top; the ends lie in gaps."""
    d = len(v)
    top = float(np.abs(v).sum(axis=1).max(initial=0))  # Gershgorin
    if not d or top <= 0:
        return np.zeros(0), np.zeros((d, 0))
    high, least = top * (1 + 1e-9), top * 1e-10
    floor = top * d * 8 * np.finfo(float).eps
    wanted = min(wanted, above(v, floor))
    basis, found = [], 0
    while found < wanted:
        low = gap(v, found + 1, floor, high, least)
        count = above(v, low) - found
        basis.append(feast(v, low, reach(v, found + 1, low, high), count))
        found, high = found + count, low
    if not basis:
        return np.zeros(0), np.zeros((d, 0))
    q, _ = np.linalg.qr(np.hstack(basis))
    values, turns = _symmetric(q.T @ v @ q)
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], (q @ turns)[:, order]


# --- statistics by Spark tasks ---------------------------------------------------

def usable(vec: Column) -> Column:
    """Whether a vector is there and all its entries are finite and, times 256, within long."""
    bad = F.exists(vec, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double") * SCALE) >= float(1 << 63)))
    return vec.isNotNull() & (F.size(vec) > 0) & ~F.coalesce(bad, F.lit(True))


def scaled(vec: Column) -> Column:
    """floor(256 c) of every entry as long."""
    return F.transform(vec, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def matrix(column, d: int) -> np.ndarray:
    """A list column as a matrix of long."""
    return np.asarray(column.flatten()).reshape(-1, d) if len(column) else np.zeros((0, d), np.int64)


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums that can't overflow."""
    if len(x) and int(np.abs(x.astype(np.float64)).max()) < (1 << 62) // len(x):
        return x.sum(axis=0).tolist()
    return [sum(int(c) for c in column) for column in x.T]


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    def run(batches):
        n, total = 0, [0] * d
        for batch in batches:
            x = matrix(batch.column(0), d)
            n, total = n + len(x), [a + b for a, b in zip(total, exact_sums(x), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([str(s) for s in [n, *total]])], ["j", "s"])

    parts = fit.select("x").mapInArrow(tidy(run), "j int, s string")
    found = {r["j"]: int(r["s"]) for r in parts.groupBy("j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    return found.get(-1, 0), [found.get(j, 0) for j in range(d)]


def _products(fit: DataFrame, d: int, project) -> np.ndarray:
    """Sum over the fit list of y y^T, y the (rows, k) values that ``project`` gives for a batch."""
    def run(batches):
        total = None
        for batch in batches:
            y = project(matrix(batch.column(0), d))
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()),
                                              pa.array(total.ravel())], ["i", "j", "v"])

    parts = fit.select("x").mapInArrow(tidy(run), "i int, j int, v double")
    found = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j = np.asarray(found["i"]), np.asarray(found["j"])
    out = np.zeros((int(i.max(initial=-1)) + 1, int(j.max(initial=-1)) + 1))
    out[i, j] = np.asarray(found["v"])
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n in doubles; the whole part of S / n is taken off exactly."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x.astype(np.float64) - whole if len(x) and np.abs(x).max(initial=0) > (1 << 61) else (x - whole).astype(np.float64)) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 of every row, exact; null beyond long."""
    if not len(x):
        return []
    most = float(np.abs(x.astype(np.float64)).max()) * n + max(abs(s) for s in sums)
    if most * most * x.shape[1] < 1 << 62:
        away = n * x - np.array(sums, np.int64)
        return (away * away).sum(axis=1).tolist()
    out = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return [v if v < 1 << 63 else None for v in out]


@dataclass
class Whitening:
    """A fit: its list's length, sums, total variance, components and how well it whitens."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ (self.vectors / np.sqrt(self.values))


def rows_to_fit(embeddings: DataFrame, vec_col: str) -> tuple[DataFrame, int]:
    """(rows with their x, its length). Vectors whose length isn't the commonest one
    (of equally common ones the greatest) can't be compared and are left out."""
    vec = F.col(f"`{vec_col}`")
    rows = embeddings.filter(usable(vec))
    common = rows.groupBy(F.size(vec).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = common["d"] if common else 0
    return rows.filter(F.size(vec) == d).withColumn("__x", scaled(vec)), d


def fit_whitening(rows: DataFrame, d: int, components: int = 4) -> Whitening:
    """Fit to the distinct vectors of the column ``__x`` of ``rows``, which all have ``d`` entries."""
    fit = cut(rows.select(F.col("__x").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).select("x"))
    n, sums = _sums(fit, d)
    v = _products(fit, d, lambda x: centred(x, n, sums)) / n
    v = (v + v.T) / 2
    values, vectors = leading(v, components)
    out = Whitening(n, sums, float(np.trace(v)), values, vectors, 0.0)
    if len(values):
        # the mean of the whitened list is taken off: its rounding counts as well
        ones = _products(fit, d, lambda x: np.hstack([out.project(x), np.ones((len(x), 1))])) / n
        k = len(values)
        out.identity_error = float(np.abs(ones[:k, :k] - np.outer(ones[k, :k], ones[k, :k]) - np.eye(k)).max())
    return out


def whiten(embeddings: DataFrame, components: int = 4, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each usable row
    and component.

    Rows are dropped whose vector is null or empty, holds null or non-finite entries or
    entries beyond long once scaled, or has another length than most. Repeated rows
    and rows with null or equal ids each give their own rows. Fewer components come
    where the fit list has fewer directions of positive variance (none for a single
    distinct vector); an empty table gives no rows. Other columns aren't looked at."""
    bounded_batches(embeddings.sparkSession)
    rows, d = rows_to_fit(embeddings, vec_col)
    given = rows.select(F.col(f"`{id_col}`").alias("id"), "__x")
    kind = given.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not d:
        return embeddings.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    model = fit_whitening(rows, d, components)
    k = len(model.values)

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), d)
            m, scores = len(x), model.project(x)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.n)), pa.array([v for v in deviations(x, model.n, model.sums) for _ in range(k)], pa.int64()),
                pa.array(scores.ravel()), pa.array(np.tile(model.values / model.trace, m)),
                pa.array(np.full(m * k, model.identity_error))],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return given.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)
