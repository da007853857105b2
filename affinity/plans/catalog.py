"""The query catalogue: every operator exercised over the driver's tables.

Each entry is ``name -> (spark_fn(spark, sf_dir) -> DataFrame, duckdb_sql | None)``.
Queries read whole tables (no id subsets, no row caps); column names and
types are aligned with the SQL so the driver's hash comparison is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import llr as L
from ..sources import tables as T
from ..sources import text as X
from . import sql as Q

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, oracle: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (fn, oracle)
        return fn
    return deco


# Fixed parameters of the catalogue queries.
SUPPLIER_CAP = 600
LLR_CAP = 40
SEED = 12345

# ====================================================================== LLR


@register("q_interactions", Q.B_EVT)
def q_interactions(spark, sf):
    """Interaction lines rendered as ``user::item`` text and parsed back
    with a regex separator."""
    ev = T.table(spark, sf, "events").select(
        F.concat_ws("::", F.col("user_id").cast("string"),
                    F.get_json_object("props", "$.k")).alias("value"))
    parsed = X.parse_interactions(ev, sep="::")
    return parsed.select(F.col("user").cast("bigint").alias("user"),
                         F.col("item").cast("bigint").alias("item"))


@register("q_counts", f"""
WITH src AS ({Q.B_EVT})
SELECT 'user' AS side, user AS key, count(*) AS n FROM src GROUP BY user
UNION ALL SELECT 'item' AS side, item AS key, count(*) AS n FROM src GROUP BY item
UNION ALL SELECT 'total' AS side, CAST(NULL AS BIGINT) AS key, count(*) AS n FROM src""")
def q_counts(spark, sf):
    """A1/A4: interactions per user, per item, and in total."""
    ints = T.event_interactions(spark, sf)
    users = L.interaction_counts(ints, "user").select(F.lit("user").alias("side"),
                                                      F.col("user").alias("key"), "n")
    items = L.interaction_counts(ints, "item").select(F.lit("item").alias("side"),
                                                      F.col("item").alias("key"), "n")
    total = ints.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("total").alias("side"), F.lit(None).cast("bigint").alias("key"), "n")
    return users.unionByName(items).unionByName(total)


@register("q_cap", f"""
WITH ints AS ({Q.B_SUP})
SELECT user, item FROM ints
WHERE user IN (SELECT user FROM ints GROUP BY user HAVING count(*) <= {SUPPLIER_CAP})
  AND item IN (SELECT item FROM ints GROUP BY item HAVING count(*) <= {SUPPLIER_CAP})""")
def q_cap(spark, sf):
    """activity cap over raw (customer, supplier) line items."""
    return L.downsample(T.supplier_lines(spark, sf), SUPPLIER_CAP, mode="cap")


@register("q_downsample", f"""
WITH ints AS ({Q.B_SUP}),
nu AS (SELECT user, count(*) AS n FROM ints GROUP BY user),
ni AS (SELECT item, count(*) AS n FROM ints GROUP BY item),
f AS (SELECT user, item, count(*) AS cnt FROM ints GROUP BY user, item),
r AS (SELECT f.user, f.item, f.cnt,
             least(least({SUPPLIER_CAP}, nu.n) / nu.n, least({SUPPLIER_CAP}, ni.n) / ni.n) AS rate
      FROM f JOIN nu ON f.user = nu.user JOIN ni ON f.item = ni.item),
c AS (SELECT r.user, r.item, r.rate, j FROM r, unnest(range(r.cnt)) AS t(j)),
k AS (SELECT user, item FROM c
      WHERE {Q.uniform_sql(str(SEED), 'user', 'item', 'j')} <= rate)
SELECT user, item FROM k""")
def q_downsample(spark, sf):
    """seeded fractional down-sampling (partition-independent draws)."""
    return L.downsample(T.supplier_lines(spark, sf), SUPPLIER_CAP, mode="sample", seed=SEED)


@register("q_cooc", f"""
WITH w AS (SELECT user, item, count(*) AS cnt FROM ({Q.B_INT}) s GROUP BY user, item)
SELECT x.user AS a, y.user AS b, CAST(sum(x.cnt * y.cnt) AS BIGINT) AS k11
FROM w x JOIN w y ON x.item = y.item GROUP BY 1, 2""")
def q_cooc(spark, sf):
    """Co-occurrence counts over shared items (both directions, self pairs)."""
    from ..session import cut_lineage
    return L.cooccurrence(cut_lineage(L.weighted_interactions(T.purchases(spark, sf))))


@register("q_llr_cells",
          f"WITH {Q.llr_ctes(Q.B_INT)}\nSELECT a, b, k11, k12, k21, k22 FROM scored")
def q_llr_cells(spark, sf):
    """2x2 contingency cells per pair."""
    return L.llr_cells(T.purchases(spark, sf))


@register("q_llr_user", Q.llr_sql(Q.B_INT, "default"))
def q_llr_user(spark, sf):
    """P1 flagship: user-user LLR similarity, default variant, > 0.6."""
    return L.llr_similarity(T.purchases(spark, sf), variant="default", threshold=0.6)


@register("q_llr_item", Q.llr_sql(Q.B_EVT, "default", mode="item"))
def q_llr_item(spark, sf):
    """Item-item LLR over the event stream (duplicates kept)."""
    return L.llr_similarity(T.event_interactions(spark, sf), variant="default", mode="item")


@register("q_llr_capped", Q.llr_sql(Q.B_INT, "default", cap=LLR_CAP))
def q_llr_capped(spark, sf):
    """user-user LLR after the explicit activity cap."""
    return L.llr_similarity(T.purchases(spark, sf), variant="default", max_interactions=LLR_CAP)


@register("q_llr_max", Q.llr_sql(Q.B_INT, "max"))
def q_llr_max(spark, sf):
    """MaxSale variant, unfiltered."""
    return L.llr_similarity(T.purchases(spark, sf), variant="max")


@register("q_llr_continuous", Q.llr_sql(Q.B_INT, "continuous"))
def q_llr_continuous(spark, sf):
    """Continuous variant, unfiltered."""
    return L.llr_similarity(T.purchases(spark, sf), variant="continuous")


@register("q_llr_dupes", f"""
WITH {Q.llr_ctes(Q.B_EVT)}
SELECT a, b, k11, k12, k21, k22, round(sim_continuous, 9) AS similarity FROM scored""")
def q_llr_dupes(spark, sf):
    """Q5 guard: repeated interactions make negative cells; their scores are NULL."""
    cells = L.llr_cells(T.event_interactions(spark, sf))
    return L.score_cells(cells).select("a", "b", "k11", "k12", "k21", "k22",
                                       F.round("sim_continuous", 9).alias("similarity"))


@register("q_positive_llr", Q.llr_sql(f"SELECT user, item FROM ({Q.B_RAT}) r WHERE rating >= 4",
                                      "default"))
def q_positive_llr(spark, sf):
    """LLR over positive ratings only (4 and 5)."""
    pos = T.ratings(spark, sf).filter(F.col("rating") >= 4).select("user", "item")
    return L.llr_similarity(pos, variant="default")

# ====================================================================== neighbours, prediction

from ..functions import vectors as V  # noqa: E402
from ..operators import evaluate as E  # noqa: E402
from ..operators import gram as G  # noqa: E402
from ..operators import knn as K  # noqa: E402
from ..operators import predict as P  # noqa: E402

KNN_K = 10
PRED_K = 100


def _test_users(spark, sf):
    return T.test_ratings(spark, sf).select(F.col("user").alias("id"))


def knn_predictions(spark, sf, k: int = PRED_K, weight: str = "distance") -> DataFrame:
    """B_test predicted from the k nearest embedding neighbours of each test user."""
    train, test = T.split_ratings(T.ratings(spark, sf))
    nbrs = K.exact_neighbors(T.embeddings(spark, sf), test.select(F.col("user").alias("id")), k=k)
    return P.predict(test, train, nbrs, weight=weight)


@register("q_embeddings_header", f"""
WITH lines AS (SELECT vec_id, CAST(vec_id AS VARCHAR) || ' ' ||
                      array_to_string(list_transform(CAST(embedding AS DOUBLE[]),
                                                     lambda x: printf('%.6f', x)), ' ') AS value
               FROM embeddings),
hdr AS (SELECT 'id ' || array_to_string(list_transform(range(1, 65), lambda i: 'v' || i), ' ') AS value)
SELECT vec_id AS id, CAST(len(string_split(value, ' ')) - 1 AS BIGINT) AS dim,
       round(list_sum(list_transform(list_slice(string_split(value, ' '), 2, 65),
                                     lambda x: CAST(x AS DOUBLE))), 6) AS total
FROM lines""")
def q_embeddings_header(spark, sf):
    """Embeddings rendered as ``id v1 ... vd`` text lines behind a header
    line, parsed back with the header dropped."""
    emb = T.table(spark, sf, "embeddings").select("vec_id", "embedding")
    body = emb.select(F.concat_ws(" ", F.col("vec_id").cast("string"), F.array_join(
        F.transform(F.col("embedding").cast("array<double>"), lambda x: F.format_string("%.6f", x)), " "))
        .alias("value"))
    header = spark.range(1).select(F.concat_ws(" ", F.lit("id"), F.array_join(
        F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.concat(F.lit("v"), i.cast("string"))),
        " ")).alias("value"))
    parsed = X.parse_embeddings(header.unionByName(body), header=True)
    return parsed.select("id", F.size("vec").cast("long").alias("dim"),
                         F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@register("q_knn_exact", f"WITH {Q.knn_ctes(Q.B_EMB, None, KNN_K)}\nSELECT * FROM nb")
def q_knn_exact(spark, sf):
    """K nearest (cosine) neighbours of every embedding."""
    return K.exact_neighbors(T.embeddings(spark, sf), k=KNN_K)


@register("q_knn_reference", f"WITH {Q.knn_ctes(Q.B_EMB, None, KNN_K, order='reference')}\nSELECT * FROM nb")
def q_knn_reference(spark, sf):
    """The original ordering — k largest distances per point."""
    return K.exact_neighbors(T.embeddings(spark, sf), k=KNN_K, order="reference")


@register("q_dist_dense", f"""
WITH {Q.knn_ctes(Q.B_EMB, None, 5, measure='euclidean')}
SELECT n.id, n.nbr, n.rnk, n.dist AS d_euclid,
       round({Q.cos_sql('x.vec', 'y.vec')}, 6) AS d_cos,
       round({Q.manhattan_sql('x.vec', 'y.vec')}, 6) AS d_manhattan,
       CAST(len(list_filter(x.vec, lambda v: v <> 0)) AS BIGINT) AS n_active
FROM nb n JOIN nb_p x ON x.id = n.id JOIN nb_p y ON y.id = n.nbr""")
def q_dist_dense(spark, sf):
    """Exact Euclidean 5-NN; cosine and Manhattan distances of the
    same pairs as native expressions; active (non-zero) dimension count."""
    emb = T.embeddings(spark, sf)
    nb = K.exact_neighbors(emb, k=5, measure="euclidean")
    x = emb.select("id", F.col("vec").alias("xv"))
    y = emb.select(F.col("id").alias("nbr"), F.col("vec").alias("yv"))
    j = nb.join(x, "id").join(y, "nbr")
    return j.select("id", "nbr", "rnk", F.col("dist").alias("d_euclid"),
                    F.round(V.cosine_distance("xv", "yv"), 6).alias("d_cos"),
                    F.round(V.manhattan_distance("xv", "yv"), 6).alias("d_manhattan"),
                    F.size(V.active_indices("xv")).cast("long").alias("n_active"))


@register("q_dist_sets", f"""
WITH {Q.knn_ctes(Q.B_SET.replace(' AS idx', ' AS vec'), None, 5, measure='jaccard')}
SELECT n.id, n.nbr, n.rnk, n.dist AS d_jaccard, round({Q.hamming_sql('x.vec', 'y.vec')}, 6) AS d_hamming
FROM nb n JOIN nb_p x ON x.id = n.id JOIN nb_p y ON y.id = n.nbr""")
def q_dist_sets(spark, sf):
    """Exact Jaccard 5-NN over purchase sets, Hamming of the same pairs."""
    sets = T.item_sets(spark, sf).withColumnRenamed("idx", "vec")
    nb = K.exact_neighbors(sets, k=5, measure="jaccard")
    x = sets.select("id", F.col("vec").alias("xv"))
    y = sets.select(F.col("id").alias("nbr"), F.col("vec").alias("yv"))
    return nb.join(x, "id").join(y, "nbr").select(
        "id", "nbr", "rnk", F.col("dist").alias("d_jaccard"),
        F.round(V.hamming_distance("xv", "yv"), 6).alias("d_hamming"))


@register("q_train_by_item", f"""
SELECT item, count(*) AS n_ratings, string_agg(CAST(user AS VARCHAR), ' ' ORDER BY user) AS users,
       round(sum(rating), 6) AS total FROM ({Q.B_TRAIN}) t GROUP BY item""")
def q_train_by_item(spark, sf):
    """Train ratings grouped by item."""
    g = P.group_ratings(T.train_ratings(spark, sf), by="item")
    return g.select("item", F.size("ratings").cast("long").alias("n_ratings"),
                    F.array_join(F.transform("ratings", lambda r: r["user"].cast("string")), " ").alias("users"),
                    F.round(F.aggregate("ratings", F.lit(0.0), lambda a, r: a + r["rating"]), 6).alias("total"))


@register("q_test_by_user", f"""
SELECT user, count(*) AS n_ratings, string_agg(CAST(item AS VARCHAR), ' ' ORDER BY item) AS items,
       round(sum(rating), 6) AS total FROM ({Q.B_TEST}) t GROUP BY user""")
def q_test_by_user(spark, sf):
    """Test ratings grouped by user."""
    g = P.group_ratings(T.test_ratings(spark, sf), by="user")
    return g.select("user", F.size("ratings").cast("long").alias("n_ratings"),
                    F.array_join(F.transform("ratings", lambda r: r["item"].cast("string")), " ").alias("items"),
                    F.round(F.aggregate("ratings", F.lit(0.0), lambda a, r: a + r["rating"]), 6).alias("total"))


@register("q_coverage", f"WITH {Q.PRED_BASE}\nSELECT user, item, rating FROM preds_cov")
def q_coverage(spark, sf):
    """test pairs whose user has neighbours and whose item is in train."""
    train, test = T.split_ratings(T.ratings(spark, sf))
    nbrs = K.exact_neighbors(T.embeddings(spark, sf), test.select(F.col("user").alias("id")), k=PRED_K)
    return P.covered(test.select("user", "item", "rating"), train, nbrs)


@register("q_predict_knn", f"WITH {Q.PRED_BASE}\nSELECT * FROM preds")
def q_predict_knn(spark, sf):
    """Distance-weighted prediction from 100 exact neighbours."""
    return knn_predictions(spark, sf)


@register("q_softmax_avg", f"""
WITH {Q.PRED_BASE},
top AS (SELECT * FROM (SELECT j.user, j.item, j.w, j.r, row_number() OVER (PARTITION BY j.user, j.item
                ORDER BY n.rnk) AS pos FROM preds_j j JOIN nb n ON n.id = j.user AND n.dist = j.w
              JOIN preds_tr tr ON tr.user = n.nbr AND tr.item = j.item AND tr.r = j.r
              WHERE j.r IS NOT NULL) z WHERE pos <= 10)
SELECT user, item, round(sum(exp(w) * r) / sum(exp(w)), 6) AS value FROM top GROUP BY 1, 2""")
def q_softmax_avg(spark, sf):
    """softmax(distance)-weighted rating over the 10 nearest rating neighbours."""
    return _top_rated(spark, sf).groupBy("user", "item").agg(
        F.round(P.softmax_average("w", "r"), 6).alias("value"))


@register("q_naive_avg", f"""
WITH {Q.PRED_BASE},
rn AS (SELECT c.user, c.item, tr.r, row_number() OVER (PARTITION BY c.user, c.item ORDER BY n.rnk) AS pos
       FROM preds_cov c JOIN nb n ON n.id = c.user JOIN preds_tr tr ON tr.user = n.nbr AND tr.item = c.item)
SELECT user, item, round(sum(r) / 10.0, 6) AS value FROM rn WHERE pos <= 10 GROUP BY 1, 2""")
def q_naive_avg(spark, sf):
    """Sum of the 10 nearest neighbours' ratings divided by the constant 10."""
    return _top_rated(spark, sf).groupBy("user", "item").agg(
        F.round(P.naive_average("r", 10), 6).alias("value"))


def _top_rated(spark, sf, n: int = 10) -> DataFrame:
    """(user, item, w, r) for the n nearest neighbours that rated the item."""
    from pyspark.sql import Window

    from ..session import cut_lineage
    train, test = T.split_ratings(T.ratings(spark, sf))
    nbrs = cut_lineage(K.exact_neighbors(T.embeddings(spark, sf), test.select(F.col("user").alias("id")), k=PRED_K))
    cov = P.covered(test.select("user", "item", "rating"), train, nbrs)
    rated = train.groupBy("user", "item").agg(F.max("rating").alias("r")) \
        .select(F.col("user").alias("nbr"), "item", "r")
    j = cov.join(nbrs.select(F.col("id").alias("user"), "nbr", F.col("dist").alias("w"), "rnk"), "user") \
        .join(rated, ["nbr", "item"])
    w = Window.partitionBy("user", "item").orderBy("rnk")
    return j.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n)


# ====================================================================== evaluation

_PRED_EVAL = f"WITH {Q.PRED_BASE},{Q.metrics_ctes()}\n"


@register("q_topn_items", _PRED_EVAL + "SELECT user, item, predicted, rnk FROM topn")
def q_topn_items(spark, sf):
    """Each user's 10 highest predictions."""
    return E.top_n(knn_predictions(spark, sf), 10).select("user", "item", "predicted", "rnk")


@register("q_rmse", _PRED_EVAL + "SELECT metric, round(value, 9) AS value FROM m_rmse")
def q_rmse(spark, sf):
    """RMSE of the KNN predictions, read back from their
    ``(user,item,rating,predicted)`` text form with blank lines skipped."""
    from ..sources import sinks
    lines = sinks.format_predictions(knn_predictions(spark, sf))
    blanks = spark.range(1).select(F.lit("  ").alias("value"))
    parsed = X.parse_predictions(lines.unionByName(blanks))
    return E.rmse(parsed).select("metric", F.round("value", 9).alias("value"))


@register("q_ap", _PRED_EVAL + "SELECT user, round(ap, 9) AS ap FROM ap")
def q_ap(spark, sf):
    """Per-user average precision at 10 (relevance: rating > 3)."""
    return E.average_precision(knn_predictions(spark, sf), 10, 3.0).select(
        "user", F.round("ap", 9).alias("ap"))


@register("q_map", _PRED_EVAL + "SELECT metric, round(value, 9) AS value FROM m_map")
def q_map(spark, sf):
    """MAP@10."""
    return E.map_at_k(knn_predictions(spark, sf)).select("metric", F.round("value", 9).alias("value"))


@register("q_recall", _PRED_EVAL + "SELECT metric, round(value, 9) AS value FROM m_recall")
def q_recall(spark, sf):
    """A18 (extension): recall@10."""
    return E.recall_at_n(knn_predictions(spark, sf)).select("metric", F.round("value", 9).alias("value"))


@register("q_all_metrics", _PRED_EVAL + """SELECT metric, round(value, 9) AS value FROM m_rmse
UNION ALL SELECT metric, round(value, 9) AS value FROM m_map
UNION ALL SELECT metric, round(value, 9) AS value FROM m_recall""")
def q_all_metrics(spark, sf):
    """All metrics in one result."""
    return E.evaluate(knn_predictions(spark, sf), ("rmse", "map", "recall")).select(
        "metric", F.round("value", 9).alias("value"))


# ====================================================================== Gram baseline

GRAM_N = 10
PIVOT_BLOCK = 512
SWEEP_KS = (10, 50, 100, 200, 300, 400, 500, 600, 700, 800, 900, 1000)

_GRAM_BASE = f"""train AS ({Q.B_TRAIN}),
test AS ({Q.B_TEST}),
gram AS (SELECT x.user AS a, y.user AS b, sum(x.rating * y.rating) AS g
         FROM train x JOIN train y ON x.item = y.item GROUP BY 1, 2),
cand AS (SELECT t.user, t.item, t.rating, r.user AS nbr, g.g, r.rating AS r,
                row_number() OVER (PARTITION BY t.user, t.item ORDER BY g.g DESC, r.user ASC) AS rnk
         FROM test t JOIN train r ON r.item = t.item JOIN gram g ON g.a = t.user AND g.b = r.user)"""


def _gram_sql_predict(n: int, test_cte: str = "test") -> str:
    return f"""
SELECT t.user, t.item, t.rating,
       round(coalesce(p.p, 0.0), 6) AS predicted
FROM {test_cte} t LEFT JOIN (SELECT user, item, rating, sum(g * r) / sum(g) AS p FROM cand
                          WHERE rnk <= {n} GROUP BY 1, 2, 3) p
  ON p.user = t.user AND p.item = t.item AND p.rating = t.rating"""


@register("q_gram", f"""
WITH train AS ({Q.B_TRAIN})
SELECT x.user AS a, y.user AS b, round(sum(x.rating * y.rating), 6) AS g
FROM train x JOIN train y ON x.item = y.item GROUP BY 1, 2""")
def q_gram(spark, sf):
    """User x user Gram matrix of the train ratings (sparse)."""
    ratings_text = T.train_ratings(spark, sf).select(F.concat_ws(
        ",", F.col("user").cast("string"), F.col("item").cast("string"),
        F.col("rating").cast("string")).alias("value"))
    g = G.gram_similarity(X.parse_ratings(ratings_text))
    return g.select("a", "b", F.round("g", 6).alias("g"))


@register("q_gram_predict", f"WITH {_GRAM_BASE}" + _gram_sql_predict(GRAM_N))
def q_gram_predict(spark, sf):
    """Gram-weighted rating from the 10 most similar raters."""
    train, test = T.split_ratings(T.ratings(spark, sf))
    return G.gram_predict(test, train, n=GRAM_N)


@register("q_predict_limit", f"WITH {_GRAM_BASE},\nfirst5 AS (SELECT * FROM test ORDER BY user, item LIMIT 5)"
          + _gram_sql_predict(GRAM_N, "first5"))
def q_predict_limit(spark, sf):
    """Predictions for the first five test rows (ordered by user, item)."""
    train, test = T.split_ratings(T.ratings(spark, sf))
    first = test.orderBy("user", "item").limit(5)
    return G.gram_predict(first, train, n=GRAM_N)


@register("q_pivot", f"""
WITH train AS ({Q.B_TRAIN}),
items AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS n FROM (SELECT DISTINCT item FROM train) z),
cells AS (SELECT u.user, i.n, coalesce(max(r.rating), 0.0) AS rating
          FROM (SELECT DISTINCT user FROM train) u CROSS JOIN items i
          LEFT JOIN train r ON r.user = u.user AND r.item = i.item GROUP BY 1, 2)
SELECT user, CAST(n // {PIVOT_BLOCK} AS BIGINT) AS block, CAST(count(*) AS BIGINT) AS items,
       sum(rating) AS total, sum(rating * (1 + n % 997)) AS weighted FROM cells GROUP BY 1, 2""")
def q_pivot(spark, sf):
    """The dense user x item matrix over all items, 0-filled, in blocks of items; a
    row for each (user, block) with the array's length, sum and sum by place."""
    wide = G.dense_rows(T.train_ratings(spark, sf), PIVOT_BLOCK)
    total = F.aggregate("ratings", F.lit(0.0), lambda s, r: s + r)
    by_place = F.aggregate(F.transform("ratings", lambda r, i: r * (1 + (F.col("block") * PIVOT_BLOCK + i) % 997)), F.lit(0.0),
                           lambda s, r: s + r)
    return wide.select("user", "block", F.size("ratings").cast("long").alias("items"), total.alias("total"), by_place.alias("weighted"))


@register("q_sweep_k", f"""
WITH {_GRAM_BASE},
ks AS (SELECT unnest({list(SWEEP_KS)}) AS k),
h AS (SELECT ks.k, c.user, c.item, c.rating, sum(c.g * c.r) / sum(c.g) AS predicted
      FROM cand c JOIN ks ON c.rnk <= ks.k GROUP BY 1, 2, 3, 4),
p AS (SELECT ks.k, t.rating, coalesce(h.predicted, 0.0) AS predicted FROM test t CROSS JOIN ks
      LEFT JOIN h ON h.k = ks.k AND h.user = t.user AND h.item = t.item AND h.rating = t.rating)
SELECT k, round(sqrt(avg(pow(rating - round(predicted, 6), 2))), 9) AS rmse FROM p GROUP BY k""")
def q_sweep_k(spark, sf):
    """Gram-baseline RMSE for every neighbourhood size k (rank once), over
    all test pairs."""
    train, test = T.split_ratings(T.ratings(spark, sf))
    preds = G.gram_predict_by_k(test, train, list(SWEEP_KS))
    return preds.groupBy("k").agg(F.round(F.sqrt(F.avg(F.pow(F.col("rating") - F.col("predicted"), 2))), 9)
                                  .alias("rmse"))


# ====================================================================== LSH

from ..operators.lsh import LSH  # noqa: E402

EMB_DIM = 64
DIM_SQL = "(SELECT CAST(max(p_partkey) + 1 AS INTEGER) FROM part)"
LSH_SPECS = {
    "cos": dict(measure="cosine", tables=2, signature=8, seed=7),
    "multi": dict(measure="cosine", tables=4, signature=10, seed=11),
    "euclid": dict(measure="euclidean", tables=2, signature=3, bucket_width=1.5, seed=13),
    "manhattan": dict(measure="manhattan", tables=2, signature=2, bucket_width=8.0, seed=17),
    "hamming": dict(measure="hamming", tables=1, signature=16, seed=19, block_rows=256),
    "jaccard": dict(measure="jaccard", tables=2, signature=8, prime=2147483647, bands=4, seed=23),
}
LSH_K = 10
SET_POINTS_SQL = Q.B_SET.replace(" AS idx", " AS vec")
# Query points for the bipartite search: every embedding with its components reversed.
REVERSED_SQL = "SELECT vec_id AS id, list_reverse(CAST(embedding AS DOUBLE[])) AS vec FROM embeddings"


def _lsh(name: str, dim=EMB_DIM) -> LSH:
    return LSH(dim=dim, **LSH_SPECS[name])


def _sets(spark, sf):
    return T.item_sets(spark, sf).withColumnRenamed("idx", "vec")


@register("q_lsh_signatures", f"""
SELECT id, tbl, array_to_string(key, ',') AS sig
FROM ({Q.lsh_entries_sql(_lsh('cos'), Q.B_EMB)}) e""")
def q_lsh_signatures(spark, sf):
    """H1/H3/H4: sign-random-projection signatures, one row per (point, table)."""
    sigs = _lsh("cos").signatures(T.embeddings(spark, sf))
    return sigs.select("id", F.col("tbl").cast("int").alias("tbl"), F.array_join("sig", ",").alias("sig"))


@register("q_lsh_cosine", Q.lsh_neighbors_sql(_lsh("cos"), Q.B_EMB, LSH_K))
def q_lsh_cosine(spark, sf):
    """Cosine LSH neighbours (simple collision strategy)."""
    return _lsh("cos").neighbors(T.embeddings(spark, sf), LSH_K)


@register("q_lsh_multi", Q.lsh_neighbors_sql(_lsh("multi"), Q.B_EMB, LSH_K))
def q_lsh_multi(spark, sf):
    """Four tables; a pair colliding in several tables counts once."""
    return _lsh("multi").neighbors(T.embeddings(spark, sf), LSH_K)


@register("q_lsh_euclid", Q.lsh_neighbors_sql(_lsh("euclid"), Q.B_EMB, LSH_K))
def q_lsh_euclid(spark, sf):
    """H5: scalar random projection, Euclidean distance."""
    return _lsh("euclid").neighbors(T.embeddings(spark, sf), LSH_K)


@register("q_lsh_manhattan", Q.lsh_neighbors_sql(_lsh("manhattan"), Q.B_EMB, LSH_K))
def q_lsh_manhattan(spark, sf):
    """H6: Cauchy projections, Manhattan distance."""
    return _lsh("manhattan").neighbors(T.embeddings(spark, sf), LSH_K)


@register("q_lsh_hamming", Q.lsh_neighbors_sql(_lsh("hamming", 1), SET_POINTS_SQL, 5, dim_sql=DIM_SQL))
def q_lsh_hamming(spark, sf):
    """H7: bit sampling over purchase sets. Most sets miss every sampled bit, so
    the empty signature is one hot bucket; it is split into tiles, not capped."""
    return _lsh("hamming", T.part_dim(spark, sf)).neighbors(_sets(spark, sf), 5)


@register("q_lsh_jaccard", Q.lsh_neighbors_sql(_lsh("jaccard", 1), SET_POINTS_SQL, 5, dim_sql=DIM_SQL))
def q_lsh_jaccard(spark, sf):
    """MinHash with banding over purchase sets."""
    return _lsh("jaccard", T.part_dim(spark, sf)).neighbors(_sets(spark, sf), 5)


@register("q_lsh_query", Q.lsh_neighbors_sql(_lsh("cos"), Q.B_EMB, 5, queries=REVERSED_SQL))
def q_lsh_query(spark, sf):
    """Bipartite search of new query points (reversed embeddings)
    against the hashed embeddings; an id may match its own model point."""
    emb = T.embeddings(spark, sf)
    queries = emb.select("id", F.reverse("vec").alias("vec"))
    return _lsh("cos").query(emb, queries, 5)


@register("q_selectivity", f"""
WITH ent AS ({Q.lsh_entries_sql(_lsh('cos'), Q.B_EMB)}),
pairs AS (SELECT DISTINCT a.id AS id1, b.id AS id2 FROM ent a JOIN ent b
          ON a.tbl = b.tbl AND a.band = b.band AND a.key = b.key)
SELECT 'avg_selectivity' AS metric,
       round(CAST((SELECT count(*) FROM pairs) AS DOUBLE) / (SELECT count(*) FROM embeddings)
             / (SELECT count(*) FROM embeddings), 9) AS value""")
def q_selectivity(spark, sf):
    """Average LSH selectivity (exact, by inclusion-exclusion)."""
    sel = _lsh("cos").avg_selectivity(T.embeddings(spark, sf))
    return sel.select("metric", F.round("value", 9).alias("value"))


# ====================================================================== graph and walks

from ..operators import embed as M  # noqa: E402
from ..operators import graph as H  # noqa: E402
from ..sources import sinks as Z  # noqa: E402

DEGREE = 30
WALK_P, WALK_Q = 5.0, 1.0
WALK_SEED = 1
FIRST_WALKS = 10
NUM_WALKS, WALK_LENGTH = 10, 80


def write_llr_triplets(spark, sf) -> str:
    """K1: the user-user LLR similarities as ``(a,b,w)`` lines, each unordered pair once;
    the path of this hand-off file."""
    from ..session import scratch_path
    sims = L.llr_similarity(T.purchases(spark, sf), variant="default", threshold=0.6, half=True)
    path = scratch_path(spark, "llr-triplets")
    # a task of the pair step has a bounded number of pairs, so a file has
    Z.write_text(Z.format_triplets(sims), path, compression="gzip")
    return path


def read_llr_edges(spark, path: str) -> DataFrame:
    """S3/U4: the triplets parsed back, every pair in both directions, self pairs once."""
    return H.expand_edges(X.parse_triplets(X.read_lines(spark, path)), unique=True)


def llr_graph_edges(spark, sf) -> DataFrame:
    """The undirected weighted edge list by way of the hand-off file, which stays, as it
    is read when the result is."""
    return read_llr_edges(spark, write_llr_triplets(spark, sf))


def llr_adjacency(spark, sf) -> DataFrame:
    """The capped adjacency, checkpointed; the hand-off file goes."""
    from ..session import cut_lineage, remove_path
    path = write_llr_triplets(spark, sf)
    try:
        return cut_lineage(H.build_graph(read_llr_edges(spark, path), directed=True, degree=DEGREE, unique=True))
    finally:
        remove_path(spark, path)


_GRAPH_BASE = f"""{Q.llr_ctes(Q.B_INT)},
sims AS (SELECT a, b, round(sim_default, 9) AS w FROM scored WHERE sim_default > 0.6),
ded AS (SELECT src, dst, max(w) AS weight FROM (SELECT a AS src, b AS dst, w FROM sims
        UNION ALL SELECT b AS src, a AS dst, w FROM sims) x GROUP BY 1, 2),
adj AS (SELECT src, dst, weight, rnk FROM (SELECT src, dst, weight, CAST(row_number() OVER (PARTITION BY src
        ORDER BY weight DESC, dst ASC) AS BIGINT) AS rnk FROM ded) z WHERE rnk <= {DEGREE}),
tr AS (SELECT e.src AS prev, e.dst AS cur, n.dst AS nxt, n.weight,
              CASE WHEN n.dst = e.src THEN n.weight / {WALK_P} WHEN k.src IS NOT NULL THEN n.weight
                   ELSE n.weight / {WALK_Q} END AS bias
       FROM adj e JOIN adj n ON n.src = e.dst LEFT JOIN adj k ON k.src = e.src AND k.dst = n.dst),
trc AS (SELECT prev, cur, nxt, bias, hi, coalesce(lag(hi) OVER (PARTITION BY prev, cur ORDER BY nxt), 0.0) AS lo,
               max(hi) OVER (PARTITION BY prev, cur) AS tot
        FROM (SELECT *, sum(bias) OVER (PARTITION BY prev, cur ORDER BY nxt
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM tr) y),
lists AS (SELECT src, nxt, hi, coalesce(lag(hi) OVER (PARTITION BY src ORDER BY nxt), 0.0) AS lo,
                 max(hi) OVER (PARTITION BY src) AS tot
          FROM (SELECT src, dst AS nxt, sum(weight) OVER (PARTITION BY src ORDER BY dst
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM adj) y)"""


def _first_sql(walks: int) -> str:
    u = Q.uniform_sql(str(WALK_SEED), "w.walk", "s.src", "0")
    return f"""
firsts AS (SELECT w.walk, s.src AS start, l.nxt AS first
           FROM (SELECT DISTINCT src FROM adj) s CROSS JOIN range(0, {walks}) w(walk)
           JOIN lists l ON l.src = s.src
           WHERE {u} * l.tot > l.lo AND {u} * l.tot <= l.hi)"""


@register("q_graph_edges", f"WITH {_GRAPH_BASE}\nSELECT src, dst, weight FROM ded")
def q_graph_edges(spark, sf):
    """S3/U4/K1: undirected edge list from the similarity triplets."""
    return llr_graph_edges(spark, sf)


@register("q_adjacency", f"WITH {_GRAPH_BASE}\nSELECT src, dst, weight, rnk FROM adj")
def q_adjacency(spark, sf):
    """Top-30 neighbours per node by weight."""
    return llr_adjacency(spark, sf)


@register("q_transitions", f"""WITH {_GRAPH_BASE}
SELECT prev, cur, nxt, round(bias, 9) AS bias, round(hi, 9) AS hi, round(tot, 9) AS tot FROM trc""")
def q_transitions(spark, sf):
    """p/q-biased transition weights with running sums per edge."""
    rows = H.transition_table(llr_adjacency(spark, sf), WALK_P, WALK_Q)
    return rows.select(
        "prev", "cur", "nxt", F.round("bias", 9).alias("bias"), F.round("hi", 9).alias("hi"),
        F.round("tot", 9).alias("tot"))


@register("q_first_step", f"WITH {_GRAPH_BASE},{_first_sql(FIRST_WALKS)}\n"
          "SELECT CAST(walk AS INTEGER) AS walk, start, first FROM firsts")
def q_first_step(spark, sf):
    """First step of 10 walk rounds from every node, weight-proportional."""
    return H.first_step(llr_adjacency(spark, sf), FIRST_WALKS, WALK_SEED)


def _walks_sql(walks: int, length: int) -> str:
    u = Q.uniform_sql(str(WALK_SEED), "w.walk", "w.start", "w.step + 1")
    return f"""WITH RECURSIVE {_GRAPH_BASE},{_first_sql(walks)},
wk AS (SELECT walk, start, 0 AS step, start AS prev, first AS cur, [start, first] AS path FROM firsts
       UNION ALL
       SELECT w.walk, w.start, w.step + 1, w.cur, t.nxt, list_append(w.path, t.nxt)
       FROM wk w JOIN trc t ON t.prev = w.prev AND t.cur = w.cur
       WHERE w.step < {length} AND {u} * t.tot > t.lo AND {u} * t.tot <= t.hi),
fin AS (SELECT walk, start, path FROM wk QUALIFY step = max(step) OVER (PARTITION BY walk, start))"""


def llr_walks(spark, sf, walks: int = NUM_WALKS, length: int = WALK_LENGTH) -> DataFrame:
    return H.random_walks(llr_adjacency(spark, sf), walks, length, WALK_P, WALK_Q, WALK_SEED,
                          checkpoint_every=10)


@register("q_walks", _walks_sql(NUM_WALKS, WALK_LENGTH) + """
SELECT CAST(walk AS INTEGER) AS walk, start, array_to_string(path, ' ') AS path FROM fin""")
def q_walks(spark, sf):
    """Second-order node2vec walks (p=5, q=1), all rounds at once."""
    return llr_walks(spark, sf).select("walk", "start", F.array_join("path", " ").alias("path"))


@register("q_walk_corpus", _walks_sql(NUM_WALKS, WALK_LENGTH) + """
SELECT array_to_string(path, ' ') AS value, CAST(len(path) AS BIGINT) AS n_tokens FROM fin""")
def q_walk_corpus(spark, sf):
    """Walks written as space-joined lines and read back as token lists."""
    lines = Z.format_walks(llr_walks(spark, sf))
    corpus = X.parse_walks(lines)
    return corpus.select(F.array_join("tokens", " ").alias("value"),
                         F.size("tokens").cast("long").alias("n_tokens"))


SKIP_WINDOW = 10


@register("q_skipgram_pairs", _walks_sql(NUM_WALKS, WALK_LENGTH) + f""",
near AS (SELECT path[i.i] AS a, path[i.i + d.d] AS b, {SKIP_WINDOW} + 1 - d.d AS n
         FROM fin, range(1, {WALK_LENGTH + 2}) i(i), range(1, {SKIP_WINDOW + 1}) d(d) WHERE i.i + d.d <= len(path)),
ways AS (SELECT a, b, n FROM near UNION ALL SELECT b, a, n FROM near)
SELECT a AS center, b AS context, CAST(sum(n) AS BIGINT) AS n FROM ways GROUP BY 1, 2""")
def q_skipgram_pairs(spark, sf):
    """G6 (its pairs): weighted (center, context) pairs of all walks, window 10."""
    pairs = M.skipgram_pairs(H.walk_tokens(llr_walks(spark, sf)), SKIP_WINDOW)
    return pairs.select(F.col("center").cast("long").alias("center"), F.col("context").cast("long").alias("context"), "n")


@register("q_w2v_vectors", None)
def q_w2v_vectors(spark, sf):
    """Skip-gram vectors of every walked node, labelled through the node
    dictionary. The draws are hashes that SQL here lacks: the fit is tested against
    plain loops on a small corpus instead."""
    corpus = H.walk_tokens(llr_walks(spark, sf))
    model = M.fit_embeddings(corpus, window=SKIP_WINDOW, seed=WALK_SEED)  # the original system's settings
    vecs = M.vectors(model)
    names = vecs.select(F.col("id"), F.concat(F.lit("c"), F.col("token")).alias("name"))
    labelled = H.decode_vectors(vecs.select("id", "vec"), names)
    return labelled.select(F.col("id").alias("node"), F.size("vec").cast("long").alias("dim"),
                           F.round(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)), 6)
                           .alias("norm"))


@register("q_index_graph", f"""WITH {_GRAPH_BASE},
lab AS (SELECT 'c' || src AS s, 'c' || dst AS d, weight FROM ded),
names AS (SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS BIGINT) AS id
          FROM (SELECT s AS name FROM lab UNION SELECT d AS name FROM lab) n)
SELECT l.s AS src_name, l.d AS dst_name, a.id AS src, b.id AS dst, l.weight
FROM lab l JOIN names a ON a.name = l.s JOIN names b ON b.name = l.d""")
def q_index_graph(spark, sf):
    """Labelled edges ``(cA,cB,w)`` -> dense node ids; the
    dictionary is written as ``name id`` lines and read back before encoding. Pairs are
    parsed and encoded once, as the triplets list them; both directions are made at the end."""
    edges = X.parse_triplets(X.read_lines(spark, write_llr_triplets(spark, sf)))
    lines = edges.select(F.concat(F.lit("("), F.concat_ws(",", F.concat(F.lit("c"), F.col("src").cast("string")),
                                                          F.concat(F.lit("c"), F.col("dst").cast("string")),
                                                          F.col("weight").cast("string")), F.lit(")")).alias("value"))
    labelled = X.parse_labelled_edges(lines)
    idx = H.node_index(labelled)
    dict_lines = idx.select(F.concat_ws(" ", "name", F.col("id").cast("string")).alias("value"))
    enc, _ = H.index_graph(labelled, X.parse_node_index(dict_lines))
    return H.both_ways(enc)


# ====================================================================== chains and sweeps

SWEEP_THRESHOLDS = (0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


@register("q_predict_lsh", f"""WITH train AS ({Q.B_TRAIN}),
test AS ({Q.B_TEST}),
nb AS (SELECT * FROM ({Q.lsh_neighbors_sql(_lsh('cos'), Q.B_EMB, PRED_K)}) z),{Q.predict_ctes()}
SELECT * FROM preds""")
def q_predict_lsh(spark, sf):
    """Prediction from 100 approximate (cosine LSH) neighbours."""
    train, test = T.split_ratings(T.ratings(spark, sf))
    nbrs = _lsh("cos").neighbors(T.embeddings(spark, sf), PRED_K)
    return P.predict(test, train, nbrs)


@register("q_sweep_threshold", f"""WITH {Q.llr_ctes(Q.B_INT)},
ts AS (SELECT unnest({list(SWEEP_THRESHOLDS)}::DOUBLE[]) AS threshold)
SELECT ts.threshold, count(s.a) AS n_pairs FROM ts LEFT JOIN scored s ON s.sim_default > ts.threshold
GROUP BY ts.threshold""")
def q_sweep_threshold(spark, sf):
    """P6 (re-aimed): LLR similarity-threshold sweep as one job — edges kept
    per threshold, scored once and joined to a literal parameter list."""
    scored = L.score_cells(L.llr_half_cells(T.purchases(spark, sf)))
    # a pair listed once stands for both its directions; one sum for each threshold in a single pass
    ways = F.when(F.col("a") == F.col("b"), 1).otherwise(2)
    sums = [F.sum(F.when(F.col("sim_default") > float(t), ways)).alias(f"n{i}") for i, t in enumerate(SWEEP_THRESHOLDS)]
    kept = scored.select("a", "b", "sim_default").agg(*sums).select(F.explode(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{i}").alias("n_pairs")) for i, t in enumerate(SWEEP_THRESHOLDS)])).alias("k"))
    kept = kept.select("k.threshold", "k.n_pairs")
    params = spark.createDataFrame([(float(t),) for t in SWEEP_THRESHOLDS], "threshold double")
    return params.join(kept, "threshold", "left").select(
        "threshold", F.coalesce("n_pairs", F.lit(0)).cast("long").alias("n_pairs"))


_EMB_SWEEP = f"""{_GRAM_BASE},{Q.knn_ctes(Q.B_EMB, 'SELECT user FROM test', max(SWEEP_KS))},{Q.predict_ctes()},
ks AS (SELECT unnest({list(SWEEP_KS)}) AS k),
hits AS (SELECT c.user, c.item, c.rating, n.rnk, n.dist AS w, tr.r FROM preds_cov c
         JOIN nb n ON n.id = c.user JOIN preds_tr tr ON tr.user = n.nbr AND tr.item = c.item),
pk AS (SELECT ks.k, h.user, h.item, h.rating, sum(h.w * h.r) AS num, sum(h.w) AS den
       FROM hits h JOIN ks ON h.rnk <= ks.k GROUP BY 1, 2, 3, 4),
ep AS (SELECT ks.k, c.user, c.item, c.rating,
              round(CASE WHEN pk.num IS NULL THEN 0.0 WHEN pk.den = 0 THEN NULL ELSE pk.num / pk.den END, 6)
                AS predicted
       FROM preds_cov c CROSS JOIN ks
       LEFT JOIN pk ON pk.k = ks.k AND pk.user = c.user AND pk.item = c.item AND pk.rating = c.rating),
emb AS (SELECT k, sqrt(avg(pow(rating - predicted, 2))) AS rmse FROM ep GROUP BY k),
gh AS (SELECT ks.k, c.user, c.item, c.rating, sum(c.g * c.r) / sum(c.g) AS predicted
       FROM cand c JOIN ks ON c.rnk <= ks.k GROUP BY 1, 2, 3, 4),
gp AS (SELECT ks.k, t.rating, coalesce(gh.predicted, 0.0) AS predicted FROM preds_cov t CROSS JOIN ks
       LEFT JOIN gh ON gh.k = ks.k AND gh.user = t.user AND gh.item = t.item AND gh.rating = t.rating),
grm AS (SELECT k, sqrt(avg(pow(rating - round(predicted, 6), 2))) AS rmse FROM gp GROUP BY k)"""


def _rmse_by_k(preds: DataFrame) -> DataFrame:
    return preds.groupBy("k").agg(F.sqrt(F.avg(F.pow(F.col("rating") - F.col("predicted"), 2))).alias("rmse"))


def embedding_rmse_by_k(spark, sf) -> DataFrame:
    train, test = T.split_ratings(T.ratings(spark, sf))
    # the search is not held here, so that its files can go once its neighbours are checkpointed
    return _rmse_by_k(P.predict_by_k(
        test, train, K.exact_neighbors(T.embeddings(spark, sf), test.select(F.col("user").alias("id")), k=max(SWEEP_KS)), list(SWEEP_KS)))


@register("q_compare", f"""WITH {_EMB_SWEEP}
SELECT g.k, round(g.rmse, 9) AS gram_rmse, round(e.rmse, 9) AS emb_rmse FROM grm g JOIN emb e ON e.k = g.k""")
def q_compare(spark, sf):
    """Gram baseline vs embedding neighbours, RMSE per neighbourhood size."""
    train, test = T.split_ratings(T.ratings(spark, sf))
    # both sides are scored on the test pairs of users that have a vector
    known = T.embeddings(spark, sf).select(F.col("id").alias("user")).distinct()
    g = _rmse_by_k(G.gram_predict_by_k(test.join(known, "user", "left_semi"), train, list(SWEEP_KS)))
    e = embedding_rmse_by_k(spark, sf)
    return g.join(e.withColumnRenamed("rmse", "emb_rmse"), "k").select(
        "k", F.round("rmse", 9).alias("gram_rmse"), F.round("emb_rmse", 9).alias("emb_rmse"))


@register("q_experiments", f"""WITH {_EMB_SWEEP}
SELECT 'knn-' || k AS experimentid, k AS pred_neighbors, round(rmse, 9) AS eval_score FROM emb
WHERE k > 100 AND k < 1100""")
def q_experiments(spark, sf):
    """Experiment results (here: the embedding sweep, derived in
    session) filtered to 100 < neighbours < 1100, ordered by neighbours."""
    e = embedding_rmse_by_k(spark, sf)
    return (e.select(F.concat(F.lit("knn-"), F.col("k").cast("string")).alias("experimentid"),
                     F.col("k").alias("pred_neighbors"), F.round("rmse", 9).alias("eval_score"))
            .filter((F.col("pred_neighbors") > 100) & (F.col("pred_neighbors") < 1100))
            .orderBy("pred_neighbors"))


@register("q_end_to_end", None)
def q_end_to_end(spark, sf):
    """P5: positive ratings -> LLR user graph -> walks -> skip-gram vectors ->
    exact neighbours -> predictions -> RMSE / MAP / recall. The fit has no SQL, so
    this chain gets the rows-only check."""
    from .recommend import recommend_and_evaluate
    return recommend_and_evaluate(T.ratings(spark, sf))
