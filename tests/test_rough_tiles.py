"""Dense tiles: exact distances only for cells that a rough tile leaves, neighbours searched for once."""

import numpy as np
import pytest
from affinity.operators import evaluate as E
from affinity.operators import knn as K
from affinity.operators import predict as P


def _brute(ids, v, k, measure, order, digits):
    d = K.distance_tile(v, v, measure)
    key = (-1 if order == "reference" else 1) * np.round(d, digits)
    key = np.where(np.isnan(key) | (ids[:, None] == ids[None, :]), np.inf, key)
    rows, cols = K.best_of(key, min(k + 1, len(ids)))
    return ids[rows].tolist(), ids[cols].tolist(), d[rows, cols]


@pytest.mark.parametrize("measure", K.DENSE_MEASURES)
@pytest.mark.parametrize("order", K.ORDERS)
def test_rough_tiles_leave_the_exact_neighbours(measure, order):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((203, 6))
    odd = v.copy()
    odd[::9], odd[4] = 0, np.nan
    two = np.vstack([v[:80] * 1e-4 + 5, v[80:] * 1e-4 - 5])
    for vecs in (v, v.round(1), v + 1000, odd, two, v * 1e20, np.repeat(v[:29], 7, axis=0)):
        for ids in (np.arange(203), np.arange(203) // 3):
            got = K.tile_top_k(ids, vecs, ids, vecs, 8, measure, order, 6, True)
            who, nbr, dist = _brute(ids, vecs, 8, measure, order, 6)
            assert got.id.tolist() == who and got.nbr.tolist() == nbr
            assert np.allclose(got.dist, dist, rtol=1e-9, atol=1e-9)


def test_few_exact_distances(monkeypatch):
    v = np.random.default_rng(6).standard_normal((2000, 16))
    seen, exact = [], K.pair_distances
    monkeypatch.setattr(K, "pair_distances", lambda q, p, rows, *rest: seen.append(len(rows)) or exact(q, p, rows, *rest))
    for measure in K.DENSE_MEASURES:
        K.tile_top_k(np.arange(2000), v, np.arange(2000), v, 10, measure, "nearest", 6, True)
        assert 22_000 <= sum(seen) < 27_000
        seen.clear()


def test_neighbours_and_predictions_are_made_once(spark):
    pts = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "id long, vec array<double>")
    ratings = spark.createDataFrame([(u, i, float(1 + (u + i) % 5)) for u in range(6) for i in range(4)], "user long, item long, rating double")
    preds = P.predict(ratings, ratings, K.exact_neighbors(pts, k=3))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" not in plan(preds) and preds.count() == 24
    for df in (E.average_precision(preds, 10), E.recall_at_n(preds, 10)):
        assert plan(df).count("Join") == 1  # with the counts of relevant items only
