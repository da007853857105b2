"""Nearest sets by lists of members: the same neighbours as by tiles, and no pairs without a common element."""

import numpy as np
import pytest

from affinity.operators import knn as K
from affinity.operators import set_lists as S
from affinity.operators.lsh import LSH


def _points(spark, n=160, items=60, empty=0):
    rng = np.random.default_rng(8)
    sets = [sorted(set(rng.integers(0, items, size=rng.integers(1, 7)).tolist()) | ({0} if i % 3 == 0 else set())) for i in range(n)]
    sets[5] = list(range(items))
    sets[9:9 + empty] = [[]] * empty
    return spark.createDataFrame([(None if i == 7 else 3 * i, s) for i, s in enumerate(sets)], "id long, vec array<int>")


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def few(monkeypatch):
    """Small blocks and tasks; lists wherever they can be had."""
    monkeypatch.setattr(S, "BLOCK_ROWS", 7)
    monkeypatch.setattr(S, "PAIRS_A_TASK", 500)
    return lambda on: monkeypatch.setattr(S, "CELLS_A_PAIR", 0 if on else 1e18)


@pytest.mark.parametrize("measure", K.SET_MEASURES)
def test_lists_and_tiles_give_equal_neighbours(spark, few, measure):
    pts = _points(spark, empty=3).filter("id IS NOT NULL")
    for queries in (None, pts.filter("id % 5 = 0").select("id")):
        few(False)
        want = _rows(K.exact_neighbors(pts, queries, k=4, measure=measure))
        few(True)
        assert _rows(K.exact_neighbors(pts, queries, k=4, measure=measure)) == want


@pytest.mark.parametrize("spec", [dict(measure="hamming", signature=2), dict(measure="jaccard", tables=2, signature=4, prime=2147483647, bands=2)])
def test_buckets_by_lists(spark, few, spec):
    pts, lsh = _points(spark).filter("id IS NOT NULL"), LSH(dim=60, seed=3, block_rows=4, **spec)
    few(False)
    want, asked = _rows(lsh.neighbors(pts, 3)), _rows(lsh.query(pts, pts.limit(50), 3))
    few(True)
    assert _rows(lsh.neighbors(pts, 3)) == want
    assert _rows(lsh.query(pts, pts.limit(50), 3)) == asked


def test_ids_that_repeat_keep_their_rows(spark, few):
    pts = _points(spark)
    twice = pts.unionByName(pts.filter("id < 60"))
    assert S.unique_ids(pts) and not S.unique_ids(twice)
    few(False)
    want = _rows(K.exact_neighbors(twice, k=3, measure="jaccard"))
    few(True)
    assert _rows(K.exact_neighbors(twice, k=3, measure="jaccard")) == want


def test_pairs_grow_with_the_table(spark):
    """Copies with other elements: pairs by a common element are as many times more, cells the square."""
    def copies(n):
        return spark.createDataFrame([(c * 100 + i, [c * 50 + i % 50, c * 50 + (i + 1) % 50]) for c in range(n) for i in range(100)], "id long, vec array<int>")
    assert S.common_pairs(copies(4), copies(4), []) == 4 * S.common_pairs(copies(1), copies(1), [])
    found = K.exact_neighbors(copies(40), k=2, measure="jaccard")
    assert "FlatMapCoGroups" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.dist for r in found.collect()} == {0.0, round(2 / 3, 6)}
