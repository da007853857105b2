"""Pairs of users that share much, in tiles of users by users."""

import random
import re
from collections import Counter, defaultdict

import pytest

from affinity.operators import llr as L
from affinity.operators import pair_tiles as P


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


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("cells", [0, 10**9])
def test_users_that_share_much_meet_in_tiles(spark, monkeypatch, kind, cells):
    """Repeats, null users and items, users that share nothing; dense and match by match; blocks of any width."""
    monkeypatch.setattr(P, "MATCH_CELLS", cells)
    monkeypatch.setattr(P, "DENSE_ITEMS", 7)
    monkeypatch.setattr(P, "MATCHES", 50)
    rnd = random.Random(5)
    name = (lambda u: u) if kind == "long" else (lambda u: f"u{u}")
    rows = [(name(u), i) for u in range(90) for i in rnd.choices(range(20), k=25)] + [(name(200), 99), (None, 3), (None, 4), (name(1), None)]
    weighted = L.weighted_interactions(spark.createDataFrame(rows, f"user {kind}, item long"))
    want = _brute(rows)
    monkeypatch.setattr(L, "TILE_GAIN", 0)
    for width in (17, 2048):
        monkeypatch.setattr(P, "TILE_USERS", width)
        pairs = L.cooccurrence(weighted)
        assert "FlatMapCoGroupsInArrow" in _plan(pairs)
        found = pairs.collect()
        assert len(found) == len(want) and {(r.a, r.b): r.k11 for r in found} == want
        half = {(r.a, r.b): r.k11 for r in L.cooccurrence(weighted, half=True).collect()}
        assert half == {k: n for k, n in want.items() if None not in k and k[0] <= k[1]}


def test_shuffle_is_chosen_by_what_is_sent(spark, monkeypatch):
    """Events of many users over few items go by tiles, whatever the shuffle partitions; others don't."""
    rows = spark.range(1500).selectExpr("id AS user", "explode(sequence(0, 99)) AS item")
    full = L.weighted_interactions(rows)
    pairs = L.cooccurrence(full, half=True)
    assert "FlatMapCoGroupsInArrow" in _plan(pairs) and not re.search(r"hashpartitioning\(a#", _plan(pairs))
    assert pairs.count() == 1500 * 1501 // 2 and pairs.filter("k11 = 100").count() == pairs.count()
    few = L.weighted_interactions(spark.range(2000).selectExpr("id AS user", "id div 4 AS item"))
    assert "FlatMapCoGroupsInArrow" not in _plan(L.cooccurrence(few, half=True))
    monkeypatch.setattr(P, "TILE_ROWS", 400)  # blocks that are too large: the other ways
    monkeypatch.setattr(P, "block_users", lambda *_: 500)
    pairs = L.cooccurrence(full, half=True)
    assert "FlatMapCoGroupsInArrow" not in _plan(pairs) and pairs.filter("k11 = 100").count() == 1500 * 1501 // 2


def test_scores_of_tiles(spark, monkeypatch):
    from affinity.plans.catalog import REGISTRY
    want = sorted(REGISTRY["q_llr_dupes"][0](spark, "/root/testdata/sf0.001").collect())
    monkeypatch.setattr(L, "TILE_GAIN", 0)
    assert sorted(REGISTRY["q_llr_dupes"][0](spark, "/root/testdata/sf0.001").collect()) == want
