"""Pairs made from shuffled lists: hot users, null users, and no shuffle of the pairs themselves."""

import re
from collections import Counter, defaultdict

from affinity.operators import llr as L


def _brute(rows):
    members = defaultdict(Counter)
    for u, i in rows:
        if i is not None:
            members[i][u] += 1
    want = Counter()
    for us in members.values():
        for a, x in us.items():
            for b, y in us.items():
                want[a, b] += x * y
    return want


def test_hot_and_null_users_have_all_pairs(spark, monkeypatch):
    """A user with half of all rows is dealt over parts of its lists; null users pair, null items don't."""
    rows = [(0, i) for i in range(40)] + [(u, i) for u in range(1, 25) for i in (u, u + 1)]
    rows += [(None, 3), (None, 4), (5, None), (7, 3), (7, 3)]
    weighted = L.weighted_interactions(spark.createDataFrame(rows, "user long, item long"))
    want = _brute(rows)
    for hot in (3, 1000):
        monkeypatch.setattr(L, "HOT_USERS", hot)
        monkeypatch.setattr(L, "PAIRS_A_TASK", 5)
        for block in (1000, 2):
            found = L.cooccurrence(weighted, block_rows=block).collect()
            assert len(found) == len(want) and {(r.a, r.b): r.k11 for r in found} == want
            half = {(r.a, r.b): r.k11 for r in L.cooccurrence(weighted, half=True, block_rows=block).collect()}
            assert half == {k: n for k, n in want.items() if None not in k and k[0] <= k[1]}


def test_sparse_pairs_are_not_shuffled(spark):
    rows = spark.createDataFrame([(u, u // 3) for u in range(300)], "user long, item long")
    plan = L.cooccurrence(L.weighted_interactions(rows), half=True)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(a#\d+L, b#\d+L", plan)
    # few users that share very much: sums of pairs are shuffled, not the lists
    dense = spark.createDataFrame([(u, i) for u in range(3) for i in range(400)], "user long, item long")
    pairs = L.cooccurrence(L.weighted_interactions(dense), half=True)
    assert re.search(r"hashpartitioning\(a#\d+L, b#\d+L", pairs._jdf.queryExecution().executedPlan().toString())
    assert {(r.a, r.b): r.k11 for r in pairs.collect()} == {(a, b): 400 for a in range(3) for b in range(a, 3)}


def test_threshold_sweep_counts_both_directions_in_one_pass(spark):
    from affinity.plans.catalog import REGISTRY, SWEEP_THRESHOLDS
    from affinity.sources import tables as T
    sf = "/root/testdata/sf0.001"
    sweep = REGISTRY["q_sweep_threshold"][0](spark, sf)
    assert "explode([0.4" not in sweep._jdf.queryExecution().optimizedPlan().toString()
    sims = [r.sim_default for r in L.score_cells(L.llr_cells(T.purchases(spark, sf))).select("sim_default").collect()]
    assert {r.threshold: r.n_pairs for r in sweep.collect()} == {t: sum(s is not None and s > t for s in sims) for t in SWEEP_THRESHOLDS}


def test_walks_hold_a_graph_of_ninety_thousand_nodes():
    import inspect

    from affinity.operators import graph as H
    assert inspect.signature(H.random_walks).parameters["broadcast_bytes"].default >= 90_000 * (48 + 30 * 32)
