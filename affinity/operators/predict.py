"""Neighbour-weighted rating prediction.

Plan: covered test pairs (user has neighbours AND item occurs in train, two
left-semi joins) -> join the user's k neighbours (test x k rows, not
test x raters-of-item, which explodes on popular items) -> left join the
neighbours' train ratings of that item on (nbr, item) -> one aggregate per
test row. For lists of neighbours by k the raters come first where they are fewer than the neighbours, by count. Test rows of a hot user are dealt over salts, its neighbours repeated for
each (``operators.skew``). Train ratings are first reduced to one rating per (user, item);
that aggregate's hash partitioning on (user, item) is the one the rating
join needs, so it costs no extra shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, let_go
from .skew import SALT, split_hot

WEIGHTS = ("distance", "similarity")


def group_ratings(ratings: DataFrame, by: str = "item") -> DataFrame:
    """A10: ratings grouped by item (train view) or by user (test view).
    For inspection APIs only; the joins use the flat form."""
    other = "user" if by == "item" else "item"
    return ratings.groupBy(by).agg(
        F.array_sort(F.collect_list(F.struct(F.col(other), F.col("rating")))).alias("ratings"))


def covered(test: DataFrame, train: DataFrame, neighbors: DataFrame) -> DataFrame:
    """test rows whose user has neighbours and whose item is in train."""
    users = neighbors.select(F.col("id").alias("user")).distinct()
    items = train.select("item").distinct()
    return test.join(users, "user", "left_semi").join(items, "item", "left_semi")


def _unique_train(train: DataFrame) -> DataFrame:
    return train.groupBy("user", "item").agg(F.max("rating").alias("rating"))


def predict(test: DataFrame, train: DataFrame, neighbors: DataFrame, weight: str = "distance",
            drop_uncovered: bool = False, digits: int | None = 6) -> DataFrame:
    """(user, item, rating, predicted).

    predicted = sum(w * r) / sum(w) over the user's neighbours that rated the
    item, w = distance (``weight='distance'``) or 1 - distance. A covered pair
    with no rating neighbour predicts 0.0 (kept unless ``drop_uncovered``);
    a zero weight total has no defined prediction (NULL)."""
    if weight not in WEIGHTS:
        raise ValueError(f"weight must be one of {WEIGHTS}")
    neighbors = cut_lineage(neighbors)  # they are searched for once: for the covered pairs and the weights
    w = F.col("dist") if weight == "distance" else F.lit(1.0) - F.col("dist")
    pairs = covered(test.select("user", "item", "rating"), train, neighbors)
    nbrs = neighbors.select(F.col("id").alias("user"), "nbr", w.alias("w"))
    rated = _unique_train(train).select(F.col("user").alias("nbr"), "item", F.col("rating").alias("r"))
    pairs, nbrs = split_hot(pairs, "user", "item", nbrs)
    joined = pairs.join(nbrs, ["user", SALT]).join(rated, ["nbr", "item"], "left")
    agg = joined.groupBy("user", "item", "rating").agg(
        F.sum(F.when(F.col("r").isNotNull(), F.col("w") * F.col("r"))).alias("num"),
        F.sum(F.when(F.col("r").isNotNull(), F.col("w"))).alias("den"),
        F.count("r").alias("n_rated"))
    if drop_uncovered:
        agg = agg.filter(F.col("n_rated") > 0)
    pred = (F.when(F.col("n_rated") == 0, F.lit(0.0))
            .when(F.col("den") == 0, F.lit(None).cast("double"))
            .otherwise(F.col("num") / F.col("den")))
    if digits is not None:
        pred = F.round(pred, digits)
    return agg.select("user", "item", "rating", pred.alias("predicted"))


def softmax_average(weight: Column | str, value: Column | str) -> Column:
    """A12 aggregate: sum(exp(w) * v) / sum(exp(w))."""
    w = F.col(weight) if isinstance(weight, str) else weight
    v = F.col(value) if isinstance(value, str) else value
    return F.sum(F.exp(w) * v) / F.sum(F.exp(w))


def naive_average(value: Column | str, n: int = 10) -> Column:
    """A13 aggregate: sum(v) / n with a constant n (not the group size)."""
    v = F.col(value) if isinstance(value, str) else value
    return F.sum(v) / F.lit(float(n))


def _matches(pairs: DataFrame, other: DataFrame, key: str) -> int:
    """Rows of the join of both on ``key``."""
    sizes = [df.groupBy(key).agg(F.count(F.lit(1)).alias(n)) for df, n in ((pairs, "_m"), (other, "_n"))]
    return sizes[0].join(sizes[1], key).agg(F.sum(F.col("_m") * F.col("_n"))).first()[0] or 0


def predict_by_k(test: DataFrame, train: DataFrame, neighbors: DataFrame, ks: list[int],
                 weight: str = "distance", digits: int | None = 6) -> DataFrame:
    """A22 for neighbour lists: predictions for every neighbourhood size k from
    one ranked list. Only rating neighbours are expanded per k (the k list is
    a literal array); covered pairs without one predict 0.0."""
    if weight not in WEIGHTS:
        raise ValueError(f"weight must be one of {WEIGHTS}")
    neighbors = cut_lineage(neighbors)  # they are searched for once: for the covered pairs and the weights
    w = F.col("dist") if weight == "distance" else F.lit(1.0) - F.col("dist")
    let_go(test.sparkSession)  # what the search shuffled
    karr = F.array(*[F.lit(int(k)) for k in ks])
    pairs = covered(test.select("user", "item", "rating"), train, neighbors)
    nbrs = (neighbors.filter(F.col("rnk") <= max(ks))
            .select(F.col("id").alias("user"), "nbr", w.alias("w"), "rnk"))
    rated = _unique_train(train).select(F.col("user").alias("nbr"), "item", F.col("rating").alias("r"))
    dealt, nbrs = split_hot(pairs, "user", "item", nbrs)
    # only ratings of neighbours count; whichever of an item's raters and a user's neighbours are fewer are joined first
    raters = rated.join(nbrs.select("nbr").distinct(), "nbr", "left_semi")
    if _matches(pairs, raters, "item") < _matches(pairs, nbrs.filter(F.col(SALT) == 0), "user"):
        hits = dealt.join(raters, "item").join(nbrs, ["user", SALT, "nbr"])
    else:
        hits = dealt.join(nbrs, ["user", SALT]).join(raters, ["nbr", "item"])
    per_k = (hits.withColumn("k", F.explode(karr)).filter(F.col("rnk") <= F.col("k"))
             .groupBy("k", "user", "item", "rating")
             .agg(F.sum(F.col("w") * F.col("r")).alias("num"), F.sum("w").alias("den")))
    base = pairs.withColumn("k", F.explode(karr))
    out = base.join(per_k, ["k", "user", "item", "rating"], "left")
    pred = (F.when(F.col("num").isNull(), F.lit(0.0))
            .when(F.col("den") == 0, F.lit(None).cast("double"))
            .otherwise(F.col("num") / F.col("den")))
    if digits is not None:
        pred = F.round(pred, digits)
    return out.select("k", "user", "item", "rating", pred.alias("predicted"))
