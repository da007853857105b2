"""Native Column expressions used by the operators."""

from .draws import uniform, weighted_pick
from .scoring import (column_entropy, contingency, continuous_variant, entropy,
                      llr_similarity, log_likelihood_ratio, max_variant, row_entropy, xlogx)
from .vectors import (active_indices, cosine_distance, distance, dot, euclidean_distance,
                      hamming_distance, jaccard_distance, l2_norm, manhattan_distance)

__all__ = [
    "uniform", "weighted_pick",
    "column_entropy", "contingency", "continuous_variant", "entropy", "llr_similarity",
    "log_likelihood_ratio", "max_variant", "row_entropy", "xlogx",
    "active_indices", "cosine_distance", "distance", "dot", "euclidean_distance",
    "hamming_distance", "jaccard_distance", "l2_norm", "manhattan_distance",
]
