"""Graph/walk properties (fixtures C5, C8, C9) and LSH against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinity.functions.draws import uniform
from affinity.operators import graph as H
from affinity.operators.lsh import LSH
from affinity.session import cut_lineage


def test_md5_draw_fixture(spark):
    # Fixed value: golden fixture C9, md5 prefix of '1-2-3'.
    u = spark.range(1).select(uniform(F.lit(1), F.lit(2), F.lit(3)).alias("u")).first().u
    assert u == pytest.approx((1161707629 + 0.5) / 2 ** 32)


def test_bias_weights_fixture(spark):
    # p=5, q=2, prev=1, N(prev)={2,3}, current=9 with neighbours 1,3,4 (weight 1)
    adj = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0), (1, 9, 1.0), (9, 1, 1.0), (9, 3, 1.0), (9, 4, 1.0)],
                                "src long, dst long, weight double")
    rows = {r.nxt: r.bias for r in H.transition_rows(adj, p=5.0, q=2.0)
            .filter("prev = 1 AND cur = 9").collect()}
    assert rows == {1: pytest.approx(0.2), 3: pytest.approx(1.0), 4: pytest.approx(0.5)}


def test_edge_keys_never_collide(spark):
    # Edges (1,23) and (12,3) must keep separate transition rows
    adj = spark.createDataFrame([(1, 23, 1.0), (12, 3, 1.0), (23, 5, 1.0), (3, 7, 1.0)],
                                "src long, dst long, weight double")
    t = {(r.prev, r.cur): [e.nxt for e in r.cum] for r in H.transitions(adj).collect()}
    assert t[(1, 23)] == [5] and t[(12, 3)] == [7]


def test_degree_cap_and_dedupe_order(spark):
    edges = spark.createDataFrame([(1, i, float(i)) for i in range(2, 8)] + [(1, 7, 7.0)],
                                  "src long, dst long, weight double")
    adj = H.build_graph(edges, directed=True, degree=3)
    assert [r.dst for r in adj.orderBy("rnk").collect()] == [7, 6, 5]
    ref = H.build_graph(edges, directed=True, degree=3, cap_before_distinct=True)
    assert sorted(r.dst for r in ref.collect()) == [6, 7]  # duplicate 7 used a slot


def test_walk_properties(spark):
    rng = np.random.default_rng(3)
    e = {(int(a), int(b)) for a, b in rng.integers(0, 25, size=(120, 2)) if a != b}
    edges = spark.createDataFrame([(a, b, float(rng.random() + 0.1)) for a, b in e],
                                  "src long, dst long, weight double")
    adj = H.build_graph(edges, degree=6)
    nbrs = {}
    for r in adj.collect():
        nbrs.setdefault(r.src, set()).add(r.dst)
    walks = H.random_walks(adj, num_walks=2, walk_length=7, p=2.0, q=0.5, seed=4, checkpoint_every=3)
    rows = walks.collect()
    assert len(rows) == 2 * len(nbrs)
    for r in rows:
        assert len(r.path) == 9  # undirected graph: no sinks, walk_length + 2 nodes
        assert all(b in nbrs[a] for a, b in zip(r.path, r.path[1:]))
    again = {(r.walk, r.start): list(r.path) for r in
             H.random_walks(adj.repartition(3), 2, 7, 2.0, 0.5, 4, checkpoint_every=5).collect()}
    assert again == {(r.walk, r.start): list(r.path) for r in rows}  # partition-independent


def test_walks_shuffled_and_broadcast_are_equal_with_a_hub(spark):
    # node 0 is a neighbour of every other node: a third of all edge ends or more
    edges = spark.createDataFrame(
        [(0, i, 1.0 + i / 100) for i in range(1, 60)] + [(i, i % 59 + 1, 0.5) for i in range(1, 60)],
        "src long, dst long, weight double")
    adj = H.build_graph(edges, degree=5)
    found = [{(r.walk, r.start): list(r.path) for r in
              H.random_walks(adj, 10, 80, 5.0, 1.0, 1, broadcast_bytes=size).collect()} for size in (64 << 20, 0)]
    assert found[0] == found[1] and len(found[0]) == 600
    # each step follows the transition table's distribution for its draw
    table = {(r.prev, r.cur): r for r in H.transitions(adj, 5.0, 1.0).collect()}
    draws = spark.range(1, 81).select(
        "id", uniform(F.lit(1), F.lit(3), F.lit(7), F.col("id").cast("int")).alias("u")).collect()
    path = found[0][(3, 7)]
    for r in draws:
        t = table[(path[r.id - 1], path[r.id])]
        assert path[r.id + 1] == next(e.nxt for e in t.cum if e.hi >= r.u * t.tot)


def test_walk_stops_at_sink(spark):
    adj = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "src long, dst long, weight double")
    paths = {r.start: list(r.path) for r in H.random_walks(adj, 1, 5, seed=1, checkpoint_every=2).collect()}
    assert paths == {1: [1, 2, 3], 2: [2, 3]}


def test_lsh_validation():
    with pytest.raises(ValueError):
        LSH("chebyshev", 4)
    with pytest.raises(ValueError):
        LSH("euclidean", 4, bucket_width=0.0)
    with pytest.raises(ValueError):
        LSH("jaccard", 10, signature=6, prime=0, bands=2)
    with pytest.raises(ValueError):
        LSH("jaccard", 10, signature=6, prime=7, bands=4)


def _exact(points, measure):
    from affinity.operators.knn import distance_tile, set_distance_tile
    ids = [p[0] for p in points]
    if measure in ("hamming", "jaccard"):
        d = set_distance_tile([p[1] for p in points], [p[1] for p in points], measure)
    else:
        v = np.array([p[1] for p in points])
        d = distance_tile(v, v, measure)
    return {(ids[i], ids[j]): round(float(d[i, j]), 6) for i in range(len(ids)) for j in range(len(ids))}


@pytest.mark.parametrize("spec", [dict(measure="cosine", signature=3, tables=2),
                                  dict(measure="euclidean", signature=2, tables=2, bucket_width=1.0)])
def test_lsh_neighbors_subset_of_exact_and_split_invariant(spark, spec):
    rng = np.random.default_rng(11)
    pts = [(i, rng.standard_normal(5).round(3).tolist()) for i in range(80)]
    df = spark.createDataFrame(pts, "id long, vec array<double>")
    exact = _exact(pts, spec["measure"])
    big = LSH(dim=5, seed=2, block_rows=1024, **spec).neighbors(df, 4).collect()
    small = LSH(dim=5, seed=2, block_rows=3, **spec).neighbors(df, 4).collect()
    assert sorted(map(tuple, big)) == sorted(map(tuple, small))  # hot-bucket tiling is exact
    assert big and all(r.dist == exact[(r.id, r.nbr)] and r.id != r.nbr for r in big)
    pairs = {(r.id1, r.id2) for r in LSH(dim=5, seed=2, **spec).candidate_pairs(df).collect()}
    for r in big:
        assert (min(r.id, r.nbr), max(r.id, r.nbr)) in pairs


def test_selectivity_matches_pair_enumeration(spark):
    rng = np.random.default_rng(13)
    sets = [(i, sorted(set(rng.integers(0, 12, size=4).tolist()))) for i in range(50)]
    df = spark.createDataFrame(sets, "id long, vec array<int>")
    lsh = LSH("jaccard", 12, tables=2, signature=4, prime=10007, bands=2, seed=5)
    sel = lsh.avg_selectivity(df).first().value
    ent = lsh.entries(df).select("id", "tbl", "band", "key").collect()
    buckets = {}
    for r in ent:
        buckets.setdefault((r.tbl, r.band, tuple(r.key)), set()).add(r.id)
    pairs = {(a, b) for members in buckets.values() for a in members for b in members}
    assert sel == pytest.approx(len(pairs) / 50 / 50)


def test_lsh_query_allows_self_matches(spark):
    pts = [(1, [1.0, 0.0]), (2, [0.0, 1.0])]
    df = spark.createDataFrame(pts, "id long, vec array<double>")
    res = LSH("cosine", 2, signature=1, seed=1).query(df, df, 1).collect()
    assert {(r.id, r.nbr) for r in res} <= {(1, 1), (2, 2), (1, 2), (2, 1)}
    assert all(r.dist == 0.0 for r in res if r.id == r.nbr)


def test_running_sums_and_picks_of_ragged_rows(monkeypatch):
    from affinity.operators import steps
    rng = np.random.default_rng(2)
    monkeypatch.setattr(steps, "CELLS", 40)
    lengths = rng.integers(0, 12, 50)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    values = rng.random(offsets[-1])
    u = rng.random(50)
    sums, totals = steps.running_sums(offsets, values)
    places = steps.pick(offsets, values, u)
    for r in range(50):
        own = values[offsets[r]:offsets[r + 1]]
        want, total = [], 0.0
        for v in own:
            total += v
            want.append(total)
        assert sums[offsets[r]:offsets[r + 1]].tolist() == want and totals[r] == total
        assert places[r] == (offsets[r] + next(i for i, h in enumerate(want) if h >= u[r] * total) if len(own) else -1)


def test_bucketed_steps_shuffle_only_the_frontier(spark):
    """A step beyond the held size has no exchange over the adjacency, and walkers of a hub are split."""
    n = 400
    edges = spark.createDataFrame([(0, i, 1.0) for i in range(1, n)] + [(i, i % (n - 1) + 1, 0.3) for i in range(1, n)],
                                  "src long, dst long, weight double")
    rows = H.adjacency_rows(H.build_graph(edges, degree=4))
    way = H.BucketedSteps(rows, 1, 1.0, 1.0)
    try:
        assert {r.hub for r in way.hubs.collect()} >= {0} and way.hubs.count() <= 2 * way.buckets
        frontier = cut_lineage(rows.filter("src > 0").select(
            F.lit(0).alias("walk"), F.col("src").alias("start"), F.col("src").alias("prev"), F.lit(0).cast("long").alias("cur"),
            F.col("nbrs.nxt").alias("ids")).withColumn("seg", F.array().cast("array<long>")))
        step = way.step(frontier, F.lit(0.5))
        plan = step._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(cur") == plan.count("Exchange hashpartitioning") == 1
        moved = spark.table(way.name)
        assert moved.filter("src = 0").count() == way.hubs.filter("hub = 0").first().salts > 1
        assert all(r.cur is not None for r in step.collect())
    finally:
        way.close()
    assert not spark.catalog.tableExists(way.name)


@pytest.mark.parametrize("spec", [dict(measure="cosine", tables=20, signature=5), dict(measure="jaccard", tables=4, signature=10, bands=5, prime=101),
                                  dict(measure="cosine", tables=3, signature=2)])
def test_selectivity_of_many_units(spark, spec, monkeypatch):
    """20 units, more than combined keys reach; large buckets in pairs of blocks; empty sets."""
    from affinity.operators import lsh as S
    rng = np.random.default_rng(6)
    sets = spec["measure"] == "jaccard"
    pts = [(i, sorted(set(rng.integers(0, 30, rng.integers(0, 6)).tolist())) if sets else rng.standard_normal(4).tolist()) for i in range(90)]
    pts += [(100 + i, pts[1][1]) for i in range(40)]  # a third of all points in the same buckets
    df = spark.createDataFrame(pts, "id long, vec array<int>" if sets else "id long, vec array<double>")
    lsh = LSH(dim=30 if sets else 4, seed=3, block_rows=8, **spec)
    keys = {}
    for r in lsh.entries(lsh._vectors(df)).collect():
        keys.setdefault(r.id, set()).add((r.tbl, r.band, tuple(r.key)))
    want = sum(bool(keys[a] & keys[b]) for a in keys for b in keys) / len(pts) ** 2
    monkeypatch.setattr(S, "COMBINED_UNITS", 0)
    assert lsh.avg_selectivity(df).first().value == pytest.approx(want)
    monkeypatch.setattr(S, "COMBINED_UNITS", 6)
    assert lsh.avg_selectivity(df).first().value == pytest.approx(want)


@pytest.mark.parametrize("measure", ["cosine", "euclidean", "manhattan"])
def test_signatures_against_projections(spark, measure):
    rng = np.random.default_rng(8)
    pts = [(i, rng.standard_normal(6).tolist()) for i in range(50)]
    lsh = LSH(measure, 6, tables=3, signature=4, bucket_width=0.7 if measure != "cosine" else 0.0, seed=5)
    sigs = lsh.signatures(spark.createDataFrame(pts, "id long, vec array<double>"))
    got = {(r.id, r.tbl): (list(r.sig), list(r.vec)) for r in sigs.collect()}
    for i, v in pts:
        for t in range(3):
            x = lsh.params["planes"][t] @ np.array(v)
            want = np.flatnonzero(x > 0) if measure == "cosine" else np.floor((x + lsh.params["offsets"][t]) / 0.7)
            assert got[i, t] == (want.astype(int).tolist(), v)
    plan = sigs._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and str(float(lsh.params["planes"][0][0][0]))[:9] not in plan


def test_copies_of_a_vector_do_not_grow_with_the_table(spark):
    """At two sizes, five-fold apart, each vector is sent to equally many tiles."""
    from affinity.operators import knn as K
    rng = np.random.default_rng(9)
    sent = []
    for n in (400, 2000):
        df = spark.createDataFrame([(i, rng.standard_normal(4).tolist()) for i in range(n)], "id long, vec array<double>")
        tasks = spark.sparkContext.defaultParallelism
        blocks = K._blocks(n, K.tile_rows(df), tasks)
        sent.append(blocks)
        assert blocks * blocks >= tasks
        got = {(r.id, r.nbr): r.dist for r in K.exact_neighbors(df, k=3).collect()}
        assert len(got) == 3 * n
    assert sent[0] == sent[1]
    assert K._blocks(10 ** 9, 1 << 16, 64) == -(-10 ** 9 // (1 << 16))
