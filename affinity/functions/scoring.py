"""Log-likelihood-ratio scoring as native Column expressions (JVM, codegen)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def xlogx(x) -> Column:
    """0 when x = 0, else x * ln(x) (Spark's ln(0) is NULL, hence the coalesce)."""
    x = _c(x).cast("double")
    return F.coalesce(x * F.ln(x), F.lit(0.0))


def entropy(*xs) -> Column:
    """Unnormalised Shannon entropy: xlogx(sum) - sum(xlogx).

    The two-argument form subtracts term by term, the n-ary form subtracts the
    accumulated sum; both orders are kept so results agree to the last ulp.
    """
    cols = [_c(x) for x in xs]
    total = reduce(lambda a, b: a + b, cols)
    if len(cols) == 2:
        return xlogx(total) - xlogx(cols[0]) - xlogx(cols[1])
    acc = reduce(lambda a, b: a + b, [xlogx(c) for c in cols])
    return xlogx(total) - acc


def row_entropy(k11, k12, k21, k22) -> Column:
    return entropy(_c(k11) + _c(k12), _c(k21) + _c(k22))


def column_entropy(k11, k12, k21, k22) -> Column:
    return entropy(_c(k11) + _c(k21), _c(k12) + _c(k22))


def log_likelihood_ratio(k11, k12, k21, k22) -> Column:
    """2 * (rowH + colH - matH), or 0 when rowH + colH < matH."""
    r = row_entropy(k11, k12, k21, k22)
    c = column_entropy(k11, k12, k21, k22)
    m = entropy(k11, k12, k21, k22)
    return F.when(r + c < m, F.lit(0.0)).otherwise(F.lit(2.0) * (r + c - m))


def llr_similarity(llr) -> Column:
    """1 - 1 / (1 + llr)."""
    return F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + _c(llr))


def max_variant(sim, row_h, col_h) -> Column:
    """sim / (2 * max(rowH, colH)); NULL when both entropies are 0."""
    den = F.lit(2.0) * F.greatest(_c(row_h), _c(col_h))
    return F.when(den == 0, F.lit(None).cast("double")).otherwise(_c(sim) / den)


def continuous_variant(sim) -> Column:
    """sim / (1 + sim)."""
    return _c(sim) / (F.lit(1.0) + _c(sim))


def contingency(k11, n_a, n_b, n_total) -> tuple[Column, Column, Column]:
    """k12 = nA - k11, k21 = nB - k11, k22 = N - nA - nB + k11."""
    k11, n_a, n_b, n_total = map(_c, (k11, n_a, n_b, n_total))
    return n_a - k11, n_b - k11, n_total - n_a - n_b + k11


def llr_exceeds(k11, k12, k21, k22, threshold: float) -> Column:
    """Predicate equivalent to ``llr_similarity(llr) > threshold``.

    sim = llr / (1 + llr) is increasing in llr, so sim > t <=> llr > t / (1 - t)
    for 0 <= t < 1, and llr = 2 * (rowH + colH - matH) when positive. Written on
    the raw cells, each x*ln(x) term appears once, so the predicate stays small
    when Catalyst pushes it below the scoring projections."""
    k11, k12, k21, k22 = map(_c, (k11, k12, k21, k22))
    valid = (k12 >= 0) & (k21 >= 0) & (k22 >= 0)
    if threshold < 0:
        return valid
    if threshold >= 1:
        return F.lit(False)
    n = k11 + k12 + k21 + k22
    g = ((xlogx(n) - xlogx(k11 + k12) - xlogx(k21 + k22))
         + (xlogx(n) - xlogx(k11 + k21) - xlogx(k12 + k22))
         - (xlogx(n) - (xlogx(k11) + xlogx(k12) + xlogx(k21) + xlogx(k22))))
    return valid & (F.lit(2.0) * g > F.lit(threshold / (1.0 - threshold)))
