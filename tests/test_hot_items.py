"""Hot items, the missing cap and the completeness of the Gram sweep."""

from collections import Counter, defaultdict

from affinity.operators import gram as G
from affinity.operators import llr as L
from affinity.plans.catalog import REGISTRY, SWEEP_KS
from affinity.sources import tables as T


def _hot(spark):
    """One item holds a third of all rows."""
    rows = [(u, 0) for u in range(60)] + [(u, 1 + (u * 7 + k) % 25) for u in range(60) for k in (0, 3)]
    return spark.createDataFrame(rows, "user long, item long"), rows


def test_split_items_give_the_same_pairs(spark):
    df, rows = _hot(spark)
    members = defaultdict(set)
    for u, i in rows:
        members[i].add(u)
    want = Counter((a, b) for us in members.values() for a in us for b in us)
    weighted = L.weighted_interactions(df)
    for block in (1000, 7, 1):
        got = {(r.a, r.b): r.k11 for r in L.cooccurrence(weighted, block_rows=block).collect()}
        assert got == want
        half = {(r.a, r.b): r.k11 for r in L.cooccurrence(weighted, half=True, block_rows=block).collect()}
        assert half == {k: n for k, n in want.items() if k[0] <= k[1]}


def test_no_item_is_dropped_unless_asked(spark):
    df, _ = _hot(spark)
    assert L.llr_cells(df).filter("k11 > 0").count() > L.llr_cells(df, max_interactions=50).count()


def test_item_mode_has_results_as_data_grow(spark):
    for sf in ("sf0.001", "sf0.01"):
        assert REGISTRY["q_llr_item"][0](spark, f"/root/testdata/{sf}").count() > 0


def test_gram_sweep_counts_every_test_pair(spark):
    for sf in ("sf0.001", "sf0.01"):
        train, test = T.split_ratings(T.ratings(spark, f"/root/testdata/{sf}"))
        n = test.count()
        counts = {r.k: r["count"] for r in G.gram_predict_by_k(test, train, list(SWEEP_KS)).groupBy("k").count().collect()}
        assert counts == {k: n for k in SWEEP_KS}


def test_gram_keeps_both_orientations(spark):
    rat = T.train_ratings(spark, "/root/testdata/sf0.001")
    g = {(r.a, r.b): r.g for r in G.gram_similarity(rat).collect()}
    assert all(g[b, a] == v for (a, b), v in g.items())
    assert not any(r.a == r.b for r in G.gram_similarity(rat, include_self=False).collect())


def test_masked_product_against_the_whole_one(spark):
    """Tiles of one user to all users; a third of all ratings on one item, ties, repeated ratings,
    questions without raters and test users without ratings."""
    import random
    rnd = random.Random(3)
    train = [(u, 0, float(rnd.randint(1, 5))) for u in range(60)]
    train += [(rnd.randint(0, 59), rnd.randint(1, 25), float(rnd.randint(0, 5))) for _ in range(120)] + [(7, 3, 2.0)] * 2
    test = [(u, i, 1.0) for u in (0, 7, 59, 99) for i in (0, 3, 11, 77)]
    tr = spark.createDataFrame(train, "user long, item long, rating double")
    te = spark.createDataFrame(test + test[:1], "user long, item long, rating double")
    want = []
    for u, i, _ in test:
        found = []
        for b, j, r in train:
            both = [x * y for v, k, x in train if v == u for w, m, y in train if w == b and k == m]
            if j == i and both:
                found.append((-sum(both), b, r))
        want += [(u, i, b, -g, r) for g, b, r in sorted(found)[:5]]
    for block in (1, 7, 1000):
        got = G.ranked_raters(te, tr, 5, block).select("user", "item", "nbr", "g", "r").collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert G.ranked_raters(te.filter("user < 0"), tr, 5).count() == 0
    assert G.gram_predict(te, tr.filter("user < 0")).filter("predicted = 0").count() == len(test) + 1


def test_few_questions_read_few_ratings(spark):
    """Ratings of items that no test user has rated or asks for aren't sent to tiles."""
    train = spark.createDataFrame([(u, u % 50, 3.0) for u in range(500)], "user long, item long, rating double")
    test = spark.createDataFrame([(1, 2, 1.0)], "user long, item long, rating double")
    assert {r.nbr % 50 for r in G.ranked_raters(test, train, 100).collect()} <= {1, 2}


def test_dense_rows(spark):
    rows = [(1, 10, 2.0), (1, 30, 4.0), (1, 30, 5.0), (2, 20, 1.0), (3, 40, 3.0)]
    df = spark.createDataFrame(rows, "user long, item long, rating double")
    got = {(r.user, r.block): list(r.ratings) for r in G.dense_rows(df, 3).collect()}
    assert got == {(1, 0): [2.0, 0.0, 5.0], (1, 1): [0.0], (2, 0): [0.0, 1.0, 0.0], (2, 1): [0.0], (3, 0): [0.0] * 3, (3, 1): [3.0]}
    assert G.dense_rows(df.filter("user > 9"), 3).count() == 0
