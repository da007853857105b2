"""Predictions by k: the smaller of raters and neighbours is joined first, with equal results; Gram lists are bytes."""

import random

import pytest
from affinity.operators import gram as G
from affinity.operators import predict as P


@pytest.mark.parametrize("crowded", [False, True])
def test_by_k_with_many_neighbours_or_many_raters(spark, crowded):
    """120 neighbours a user: with 3 raters an item test x 120 rows aren't made; with many raters they are the fewer ones."""
    rnd = random.Random(8)
    items, near = (4, 6) if crowded else (80, 120)
    train = {(u, i): float(rnd.randint(1, 5)) for i in range(items) for u in rnd.sample(range(150), 100 if crowded else 3)}
    test = {(u, rnd.randrange(items)): 3.0 for u in range(40)} | {(0, i): 2.0 for i in range(items)}
    nbrs = [(u, n, round(rnd.random() + 0.1, 3), r + 1) for u in range(40) for r, n in enumerate(rnd.sample(range(150), near))]
    want = {}
    for (u, i), rating in test.items():
        if any(j == i for _, j in train):
            for k in (2, 5, 100):
                hits = [(w, train[n, i]) for v, n, w, r in nbrs if v == u and r <= k and (n, i) in train]
                want[k, u, i, rating] = round(sum(w * r for w, r in hits) / sum(w for w, _ in hits), 6) if hits else 0.0
    frame = lambda d: spark.createDataFrame([(*k, v) for k, v in d.items()], "user long, item long, rating double")
    out = P.predict_by_k(frame(test), frame(train), spark.createDataFrame(nbrs, "id long, nbr long, dist double, rnk long"), [2, 5, 100])
    found = {(r.k, r.user, r.item, r.rating): r.predicted for r in out.collect()}
    assert found.keys() == want.keys() and all(abs(found[x] - want[x]) < 1e-6 for x in want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # whether a pair's raters are looked up among its user's neighbours, or the neighbours' ratings are
    assert any("Join Inner" in x and "_salt#" in x and "nbr#" in x for x in plan.splitlines()) != crowded


@pytest.mark.parametrize("raters", [1 << 16, 4])
def test_gram_ranks_in_the_tile(spark, monkeypatch, raters):
    """Where all raters of an item are in one tile nothing is ranked again; else the parts are."""
    monkeypatch.setattr(G, "RATERS", raters)
    rnd = random.Random(2)
    train = {(u, i): rnd.choice([1.0, 2.5, 4.0]) for u in range(30) for i in range(12) if rnd.random() < 0.5}
    test = {(u, rnd.randrange(14)): 3.0 for u in range(30)}
    frame = lambda d: spark.createDataFrame([(*k, v) for k, v in d.items()], "user long, item long, rating double")
    te, tr = frame(test), frame(train)
    ranked = G.ranked_raters(te, tr, 3)
    assert ("Window" in ranked._jdf.queryExecution().optimizedPlan().toString()) == (raters == 4)
    gram = lambda a, b: sum(train[a, i] * train[b, i] for i in range(12) if (a, i) in train and (b, i) in train)
    want, found = {}, {(r.user, r.item, r.rnk): (r.nbr, r.g) for r in ranked.collect()}
    for u, i in test:
        best = sorted((-gram(u, b), b) for b in range(30) if (b, i) in train and gram(u, b) > 0)[:3]
        want |= {(u, i, n): (b, -g) for n, (g, b) in enumerate(best, 1)}
    assert found == want
    every = G.gram_predict_by_k(te.unionByName(te.limit(1)), tr, [1, 3])
    assert every.groupBy("k").count().orderBy("k").collect() == [(1, len(test) + 1), (3, len(test) + 1)]
    for r in every.collect():
        best = [want[r.user, r.item, n] for n in range(1, r.k + 1) if (r.user, r.item, n) in want]
        value = sum(g * train[b, r.item] for b, g in best) / sum(g for _, g in best) if best else 0.0
        assert abs(r.predicted - value) < 1e-6
    assert every.schema["k"].dataType.simpleString() == "int"
