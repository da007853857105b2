"""LLR operators against the golden fixture C1 and properties."""

import math

import pytest
from pyspark.sql import functions as F

from affinity.operators import llr as L

# Golden fixture C1 (interactions and expected scores).
C1 = [("u1", "a"), ("u1", "b"), ("u2", "a"), ("u2", "b"), ("u2", "c"), ("u3", "c"), ("u4", "d")]
C1_EXPECTED = {  # pair: (k11, k12, k21, k22, llr, default, max, continuous)
    ("u1", "u1"): (2, 0, 0, 2, 5.545177444, 0.847215754, 0.152784246, 0.458644721),
    ("u1", "u2"): (2, 0, 1, 1, 1.726092435, 0.633174581, 0.114184728, 0.387695589),
    ("u2", "u1"): (2, 1, 0, 1, 1.726092435, 0.633174581, 0.114184728, 0.387695589),
    ("u2", "u2"): (3, 0, 0, 1, 4.498681157, 0.818138210, 0.181861790, 0.449986808),
    ("u2", "u3"): (1, 2, 0, 1, 0.679596147, 0.404618782, 0.089941645, 0.288063058),
    ("u3", "u2"): (1, 0, 2, 1, 0.679596147, 0.404618782, 0.089941645, 0.288063058),
    ("u3", "u3"): (1, 0, 0, 3, 4.498681157, 0.818138210, 0.181861790, 0.449986808),
    ("u4", "u4"): (1, 0, 0, 3, 4.498681157, 0.818138210, 0.181861790, 0.449986808),
}


@pytest.fixture
def c1(spark):
    return spark.createDataFrame(C1, "user string, item string")


def test_cells_and_scores_match_fixture(c1):
    rows = L.score_cells(L.llr_cells(c1)).collect()
    got = {(r.a, r.b): r for r in rows}
    assert set(got) == set(C1_EXPECTED)
    for pair, (k11, k12, k21, k22, llr, d, m, c) in C1_EXPECTED.items():
        r = got[pair]
        assert (r.k11, r.k12, r.k21, r.k22) == (k11, k12, k21, k22)
        assert r.llr == pytest.approx(llr, abs=1e-8)
        assert r.sim_default == pytest.approx(d, abs=1e-8)
        assert r.sim_max == pytest.approx(m, abs=1e-8)
        assert r.sim_continuous == pytest.approx(c, abs=1e-8)


def test_default_threshold_is_strict_and_drops_weak_pairs(c1):
    kept = {(r.a, r.b) for r in L.llr_similarity(c1, threshold=0.6).collect()}
    assert kept == set(C1_EXPECTED) - {("u2", "u3"), ("u3", "u2")}


def test_max_and_continuous_are_unfiltered(c1):
    for variant in ("max", "continuous"):
        assert L.llr_similarity(c1, variant=variant, threshold=0.99).count() == len(C1_EXPECTED)


def test_item_mode_swaps_columns(c1):
    pairs = {(r.a, r.b) for r in L.llr_similarity(c1, variant="max", mode="item").collect()}
    assert ("a", "b") in pairs and ("c", "c") in pairs
    with pytest.raises(ValueError):
        L.llr_similarity(c1, mode="both")
    with pytest.raises(ValueError):
        L.llr_similarity(c1, variant="median")


def test_cap_drops_every_row_of_heavy_users_or_items(spark):
    rows = [("u1", "x")] * 3 + [("u2", "y"), ("u3", "y"), ("u3", "z")]
    df = spark.createDataFrame(rows, "user string, item string")
    kept = sorted(tuple(r) for r in L.downsample(df, 2, mode="cap").select("user", "item").collect())
    # u1 has 3 interactions (> 2) and item x 3: all gone; everything else kept
    assert kept == [("u2", "y"), ("u3", "y"), ("u3", "z")]


def test_sample_mode_is_deterministic_and_bounded(spark):
    rows = [(f"u{i % 7}", f"i{i % 3}") for i in range(200)]
    df = spark.createDataFrame(rows, "user string, item string")
    a = sorted(tuple(r) for r in L.downsample(df, 20, mode="sample", seed=3).collect())
    b = sorted(tuple(r) for r in L.downsample(df.repartition(5), 20, mode="sample", seed=3).collect())
    assert a == b and 0 < len(a) < 200


def test_negative_cells_give_null_scores(spark):
    # repeated interactions: k11 counts multiplicity and can exceed a user's total
    rows = [("u1", "a")] * 3 + [("u2", "a"), ("u2", "b")]
    df = spark.createDataFrame(rows, "user string, item string")
    scored = L.score_cells(L.llr_cells(df)).collect()
    bad = [r for r in scored if min(r.k12, r.k21, r.k22) < 0]
    assert bad and all(r.llr is None and r.sim_default is None for r in bad)
    assert all(r.sim_default is None or not math.isnan(r.sim_default) for r in scored)
    assert {(r.a, r.b) for r in L.llr_similarity(df, threshold=0.0).collect()}.isdisjoint(
        {(r.a, r.b) for r in bad})


def test_symmetry_on_purchases(spark):
    from affinity.sources import tables as T
    sims = L.llr_similarity(T.purchases(spark, "/root/testdata/sf0.001"), variant="continuous")
    d = {(r.a, r.b): r.similarity for r in sims.collect()}
    assert d and all(d[(b, a)] == v for (a, b), v in d.items())


def test_exceeds_predicate_matches_threshold(c1):
    from affinity.functions.scoring import llr_exceeds
    cells = L.score_cells(L.llr_cells(c1))
    for t in (0.0, 0.5, 0.62, 0.82):
        rows = cells.select((F.col("sim_default") > t).alias("x"),
                            llr_exceeds("k11", "k12", "k21", "k22", t).alias("y")).collect()
        assert all(r.x == r.y for r in rows)
