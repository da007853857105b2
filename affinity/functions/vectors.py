"""Vector and set distances as native higher-order Column expressions.

Dense vectors are ``ARRAY<DOUBLE>``; set vectors are sorted ``ARRAY<INT>`` of
active indices. Everything stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MEASURES = ("cosine", "euclidean", "manhattan", "hamming", "jaccard")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, v: acc + v)


def l2_norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, v: acc + v * v))


def cosine_distance(a, b, norm_a=None, norm_b=None) -> Column:
    """1 - |a.b| / (|a| |b|). Antipodal vectors are at distance 0."""
    na = l2_norm(a) if norm_a is None else _c(norm_a)
    nb = l2_norm(b) if norm_b is None else _c(norm_b)
    return F.lit(1.0) - F.abs(dot(a, b)) / (na * nb)


def euclidean_distance(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)),
                              F.lit(0.0), lambda acc, v: acc + v))


def manhattan_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y)),
                       F.lit(0.0), lambda acc, v: acc + v)


def hamming_distance(a, b) -> Column:
    """|A ∪ B| - |A ∩ B| over active indices."""
    return (F.size(F.array_union(_c(a), _c(b)))
            - F.size(F.array_intersect(_c(a), _c(b)))).cast("double")


def jaccard_distance(a, b) -> Column:
    """1 - |A ∩ B| / |A ∪ B|; NULL when both sets are empty."""
    union = F.size(F.array_union(_c(a), _c(b)))
    inter = F.size(F.array_intersect(_c(a), _c(b)))
    return F.when(union == 0, F.lit(None).cast("double")).otherwise(
        F.lit(1.0) - inter / union.cast("double"))


def distance(a, b, measure: str) -> Column:
    m = measure.lower()
    if m == "cosine":
        return cosine_distance(a, b)
    if m == "euclidean":
        return euclidean_distance(a, b)
    if m == "manhattan":
        return manhattan_distance(a, b)
    if m == "hamming":
        return hamming_distance(a, b)
    if m == "jaccard":
        return jaccard_distance(a, b)
    raise ValueError(f"unknown measure {measure!r}; expected one of {MEASURES}")


def active_indices(vec) -> Column:
    """Dense -> set form: 0-based positions of the non-zero entries."""
    v = _c(vec)
    return F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.element_at(v, i + 1) != 0)
