"""Exact KNN, prediction, metrics and Gram baseline against golden fixtures C2-C4, C6,
and the blocked KNN against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinity.operators import evaluate as E
from affinity.operators import gram as G
from affinity.operators import knn as K
from affinity.operators import predict as P

# Golden fixture C2 vectors, C3 train ratings, C4 predictions, C6 ratings.
C2 = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0]), (4, [-1.0, 0.0])]
C3_TRAIN = [(2, 10, 4.0), (3, 10, 2.0), (4, 10, 5.0), (3, 20, 3.0)]
C4 = [(1, 10, 5.0, 4.5), (1, 11, 2.0, 4.8), (1, 12, 4.0, 3.0), (2, 10, 3.0, 3.0), (3, 10, 4.0, 1.0),
      (3, 11, 1.0, 2.0)]
C6 = [(1, 10, 5.0), (1, 20, 3.0), (2, 10, 4.0), (3, 20, 2.0), (3, 10, 1.0)]


@pytest.fixture
def c2(spark):
    return spark.createDataFrame(C2, "id long, vec array<double>")


def _lists(df):
    out = {}
    for r in df.orderBy("id", "rnk").collect():
        out.setdefault(r.id, []).append((r.nbr, round(r.dist, 6)))
    return out


def test_knn_nearest_and_reference_order(c2):
    near = _lists(K.exact_neighbors(c2, k=2))
    assert near[1] == [(4, 0.0), (2, 0.4)]
    far = _lists(K.exact_neighbors(c2, k=2, order="reference"))
    assert far[1] == [(3, 1.0), (2, 0.4)]


def test_knn_queries_and_both_directions(spark, c2):
    q = spark.createDataFrame([(1,)], "id long")
    only = K.exact_neighbors(c2, q, k=3)
    assert {r.id for r in only.collect()} == {1}
    both = _lists(K.exact_neighbors(c2, q, k=3, both_directions=True))
    assert set(both) == {1, 2, 3, 4} and both[3] == [(1, 1.0)]


@pytest.mark.parametrize("measure", ["cosine", "euclidean", "manhattan"])
def test_blocked_knn_equals_brute_force(spark, measure):
    rng = np.random.default_rng(5)
    vecs = rng.standard_normal((60, 4)).round(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, vec array<double>")
    got = _lists(K.exact_neighbors(df, k=5, measure=measure, block_rows=7))
    d = K.distance_tile(vecs, vecs, measure).round(6)
    for i in range(len(vecs)):
        order = sorted((d[i, j], j) for j in range(len(vecs)) if j != i)[:5]
        assert got[i] == [(j, dist) for dist, j in order]


def test_set_knn_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    sets = [sorted(set(rng.integers(0, 30, size=rng.integers(1, 8)).tolist())) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, vec array<int>")
    got = _lists(K.exact_neighbors(df, k=3, measure="jaccard", block_rows=9))
    for i, a in enumerate(sets):
        cand = []
        for j, b in enumerate(sets):
            if j != i:
                inter, union = len(set(a) & set(b)), len(set(a) | set(b))
                cand.append((round(1 - inter / union, 6), j))
        assert got[i] == [(j, dist) for dist, j in sorted(cand)[:3]]


def test_prediction_fixture(spark, c2):
    train = spark.createDataFrame(C3_TRAIN, "user long, item long, rating double")
    test = spark.createDataFrame([(1, 10, 0.0), (1, 20, 0.0)], "user long, item long, rating double")
    q = spark.createDataFrame([(1,)], "id long")
    near = {r.item: r.predicted for r in P.predict(test, train, K.exact_neighbors(c2, q, k=2)).collect()}
    assert near == {10: 4.0, 20: 0.0}
    ref = {r.item: r.predicted for r in
           P.predict(test, train, K.exact_neighbors(c2, q, k=2, order="reference")).collect()}
    assert ref[10] == pytest.approx(2.571428571, abs=1e-6) and ref[20] == pytest.approx(3.0)


def test_prediction_drop_uncovered_and_zero_weight(spark, c2):
    train = spark.createDataFrame(C3_TRAIN, "user long, item long, rating double")
    test = spark.createDataFrame([(1, 10, 0.0), (1, 20, 0.0), (1, 99, 0.0)], "user long, item long, rating double")
    q = spark.createDataFrame([(1,)], "id long")
    nb = K.exact_neighbors(c2, q, k=1)  # only neighbour 4, at distance 0
    rows = {r.item: r.predicted for r in P.predict(test, train, nb).collect()}
    assert 99 not in rows and rows[10] is None and rows[20] == 0.0
    assert P.predict(test, train, nb, drop_uncovered=True).filter("item = 20").count() == 0


def test_metrics_fixture(spark):
    preds = spark.createDataFrame(C4, "user long, item long, rating double, predicted double")
    assert E.rmse(preds).first().value == pytest.approx(1.783722699, abs=1e-9)
    ap = {r.user: r.ap for r in E.average_precision(preds, 10).collect()}
    assert ap == {1: pytest.approx(0.583333333), 3: pytest.approx(0.5)}
    assert E.map_at_k(preds).first().value == pytest.approx(0.541666667, abs=1e-9)
    metrics = {r.metric: r.value for r in E.evaluate(preds, ("rmse", "map", "recall")).collect()}
    assert set(metrics) == {"rmse", "map", "recall"} and 0 <= metrics["recall"] <= 1
    with pytest.raises(ValueError):
        E.evaluate(preds, ("ndcg",))


def test_gram_fixture(spark):
    ratings = spark.createDataFrame(C6, "user long, item long, rating double")
    g = {(r.a, r.b): r.g for r in G.gram_similarity(ratings).collect()}
    assert g[(1, 1)] == 34 and g[(1, 2)] == 20 and g[(1, 3)] == 11
    assert g[(2, 2)] == 16 and g[(2, 3)] == 4 and g[(3, 3)] == 5 and g[(3, 1)] == 11


def test_gram_predict_weighted_top_n(spark):
    train = spark.createDataFrame(C6, "user long, item long, rating double")
    test = spark.createDataFrame([(2, 20, 1.0), (2, 30, 1.0)], "user long, item long, rating double")
    rows = {r.item: r.predicted for r in G.gram_predict(test, train, n=10).collect()}
    # raters of 20: user 1 (g=20, r=3) and user 3 (g=4, r=2); item 30 has no rater -> 0.0
    assert rows[20] == pytest.approx((20 * 3 + 4 * 2) / 24, abs=1e-6) and rows[30] == 0.0
    one = {r.item: r.predicted for r in G.gram_predict(test, train, n=1).collect()}
    assert one[20] == pytest.approx(3.0)


def test_softmax_and_naive_averages(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0)], "w double, v double")
    r = df.agg(P.softmax_average("w", "v").alias("s"), P.naive_average("v", 10).alias("n")).first()
    e = np.e
    assert r.s == pytest.approx((1 + e * 3) / (1 + e)) and r.n == pytest.approx(0.4)


def test_a_tile_gives_a_bounded_number_of_neighbours(spark, monkeypatch):
    """With many neighbours a tile has fewer queries; results are the same."""
    import numpy as np

    from affinity.operators import knn as K
    rnd = np.random.default_rng(5)
    pts = spark.createDataFrame([(i, [float(x) for x in rnd.random(4)]) for i in range(300)], "id long, vec array<double>")
    whole = sorted(map(tuple, K.exact_neighbors(pts, k=40).collect()))
    monkeypatch.setattr(K, "RESULT_BYTES", 24 * 41 * 20)
    asked, blocks = [], K._blocks

    def seen(n, rows, tasks):
        asked.append(rows)
        return blocks(n, rows, tasks)

    monkeypatch.setattr(K, "_blocks", seen)
    assert sorted(map(tuple, K.exact_neighbors(pts, k=40).collect())) == whole
    assert asked[0] == 20
